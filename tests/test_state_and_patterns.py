"""Features kept between runs, medians that merge, label keys in JSON, and further patterns, against plain versions."""

import json
import random
import statistics
from collections import Counter, defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flowlattice.functions.materialise import shared_dir
from flowlattice.operators import anomaly
from flowlattice.operators import feature_state as fs
from flowlattice.operators import features as fe
from flowlattice.operators.deviation import cusum, deviations
from flowlattice.operators.sketched_median import K, RANK_ERROR, amount_counts, exact_by_sketches, refined_medians, role_sketches, sketched_medians
from flowlattice.plans.queries import _r
from flowlattice.operators.smurfing import smurfing
from flowlattice.operators.structuring import structuring
from flowlattice.plans.evidence import stripped_json, violations, without_label_keys
from flowlattice.sources.annotations import BEGIN, END, read_annotations
from flowlattice.sources.feature_store import FeatureSet, FeatureStore

from moments import START

DAY = 24 * 60


def payments(tx, seed, n=300, accounts=9, minutes=20 * DAY):
    r = random.Random(seed)
    at = sorted(r.randrange(minutes) for _ in range(n))
    return tx(*((m, f"A{r.randrange(accounts)}", f"A{r.randrange(accounts)}", r.choice([9600.0, 50.0, 100.0, 12345.67, 0.1])) for m in at))


# ---- features


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_parts_merge_to_the_whole(spark, tx, parts):
    df = payments(tx, parts).cache()
    want = {r.account_id: r.asDict() for r in fe.features(df).collect()}
    store = FeatureStore(spark, shared_dir(spark, "store"))
    assert store.state_version() == 0 and store.load_state() == {}
    for k in range(parts):
        lo, hi = (START + timedelta(minutes=20 * DAY * j // parts) for j in (k, k + 1))
        fs.advance(store, df.where((F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi))))
    assert store.state_version() == parts
    state = fs.State(**store.load_state())
    got = {r.account_id: r.asDict() for r in fs.features_of(state).collect()}
    assert got == want and list(next(iter(got.values()))) == list(fe.FEATURES)
    assert {(r.account_id, r.event_count, r.laundering_event_count) for r in state.labels.collect()} == {(r.account_id, r.event_count, r.laundering_event_count) for r in fe.label_counts(fe.account_events(df)).collect()}


def test_parts_that_overlap_in_time_are_an_error(spark, tx):
    a, b = fs.folded(tx((0, "A", "B"), (60, "A", "B"))), fs.folded(tx((30, "A", "C")))
    with pytest.raises(Exception, match="overlap in time"):
        fs.merged(a, b).totals.collect()
    assert fs.merged(a, fs.folded(tx((0, "X", "Y")).where("false"))).totals.count() == 2
    assert fs.features_of(fs.folded(tx((0, "X", "Y")).where("false"))).count() == 0


def test_a_hot_accounts_median(spark):
    """100,000 amounts of one account over many tasks: the rank is within the stated error (twice, so as never to fail by chance)."""
    n = 100_000
    e = spark.range(n, numPartitions=16).select(F.lit("hub").alias("account_id"), F.lit(1).alias("out"), F.lit(0).alias("inc"), (F.col("id") * 7919 % n).cast("double").alias("out_amount"), F.lit(0.0).alias("in_amount"))
    (r,) = sketched_medians(e).collect()
    assert abs(r.median_outgoing_amount - n / 2) <= 2 * RANK_ERROR * n + 1 and r.median_incoming_amount == 0.0
    plan = sketched_medians(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("kll_sketch_agg_double") >= 2 and "partial_" in plan  # combined before the shuffle


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_few_amounts_have_exact_medians(spark, n):
    r = random.Random(n)
    values = [r.choice([1.0, 2.5, r.random() * 1000]) for _ in range(n)]
    e = spark.createDataFrame([("a", 1, 1, v, 2 * v) for v in values], "account_id string, out int, inc int, out_amount double, in_amount double").repartition(3)
    (row,) = sketched_medians(e).collect()
    assert n < K and (row.median_outgoing_amount, row.median_incoming_amount) == (statistics.median(values), 2 * statistics.median(values))


def test_sketched_features(tx):
    df = payments(tx, 4)
    exact, sketched = (Counter(map(tuple, fe.features(df, config=fe.FeatureConfig(median=m)).collect())) for m in ("exact", "sketch"))
    assert exact == sketched


def test_a_lookup_reads_few_rows(spark):
    n = 200_000
    rows = spark.range(n).select(F.concat(F.lit("A"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("account_id"), (F.col("id") % 7).alias("x"))
    store = FeatureStore(spark, shared_dir(spark, "store"))
    store.save(FeatureSet(rows.orderBy(F.rand(1)), rows.limit(5), {"n": n}))
    found = store.lookup("A000123456")
    assert [r.x for r in found.collect()] == [123456 % 7]
    plan = found._jdf.queryExecution().executedPlan()
    read = [plan.collectLeaves().apply(i).metrics().get("numOutputRows").get().value() for i in range(plan.collectLeaves().size())]
    assert sum(read) <= n / 5  # pages of 20,000 rows at most


# ---- label keys


def test_label_keys_go_at_any_depth(spark):
    r = random.Random(1)
    keys = ["label", "is_laundering", "x", "y", "a b", 'q"uo', "Is Laundering", "z{", "é"]

    def made(depth):
        c = r.random()
        if depth == 0 or c < 0.3:
            return r.choice([1, -2.5, True, False, None, "s", "label", 'a"b,}{]', "", "\\\\ é\n", [], {}])
        return {k: made(depth - 1) for k in r.sample(keys, r.randrange(5))} if c < 0.65 else [made(depth - 1) for _ in range(r.randrange(4))]

    values = [made(4) for _ in range(300)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 1)) for i, v in enumerate(values)]
    got = {x.i: x.j for x in spark.createDataFrame([*rows, (-1, "{bad"), (-2, None)], "i int, j string").select("i", stripped_json(F.col("j")).alias("j")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    for i, v in enumerate(values):
        want = without_label_keys(v)
        assert json.loads(got[i]) == want
        assert not isinstance(want, dict) or list(json.loads(got[i])) == sorted(want)


# ---- patterns


def plain_structuring(edges, limit, band, total, hours):
    """account: windows (first and last place), each the earliest to end of those that start after the one before."""
    own = defaultdict(list)
    for i, (m, s, _, a) in enumerate(edges):
        if limit * (1 - band) <= a < limit:
            own[s].append((m, i, a))
    out = {}
    for account, ps in own.items():
        ps.sort()
        start, taken = 0, []
        for j in range(len(ps)):
            i = next((i for i in range(j, start - 1, -1) if sum(p[2] for p in ps[i : j + 1]) >= total), None)
            if i is not None and ps[j][0] - ps[i][0] <= hours * 60:
                taken.append((i, j))
                start = j + 1
        if taken:
            out[account] = taken, ps
    return out


@pytest.mark.parametrize("seed", range(3))
def test_structuring_agrees_with_loops(spark, tx, seed):
    r = random.Random(seed)
    edges = [(r.randrange(0, 4000), f"A{r.randrange(4)}", "X", float(r.choice([25, 40, 60, 99, 100, 10]))) for _ in range(150)]
    want = plain_structuring(edges, 100, 0.8, 150, 10)
    df = structuring(tx(*edges), 100.0, 0.8, 150.0, 10)
    got = {x.primary_account_id: x for x in df.collect()}
    assert set(got) == set(want) and len(want) > 1 and violations(df).count() == 0
    for account, (taken, ps) in want.items():
        own = [p for i, j in taken for p in ps[i : j + 1]]
        x = got[account]
        assert (json.loads(x.metadata)["windows"], x.transaction_count, x.total_amount) == (len(taken), len(own), sum(p[2] for p in own))
        assert x.start_time == START + timedelta(minutes=own[0][0]) and len(x.transaction_references) <= 20
    assert structuring(tx(*edges), min_windows=0).count() == 0 and structuring(tx(*edges).where("false"), 100.0, 0.8).count() == 0


def test_smurfing_finds_a_planted_core(tx):
    r = random.Random(2)
    planted = [(5, f"S{i}", f"R{j}", 90.0) for i in range(6) for j in range(4) if (i + j) % 6]
    around = [(6, f"S{i}", f"x{i}", 5.0) for i in range(6)] + [(7, f"y{r.randrange(30)}", f"R{r.randrange(4)}", 5.0) for _ in range(20)] + [(8, f"y{i}", f"y{i + 1}", 1.0) for i in range(29)]
    large = [(9, f"B{i}", f"C{j}", 100.0) for i in range(5) for j in range(5)]
    edges = planted + around + large
    left = {(s, t) for _, s, t, a in edges if a < 100 and s != t}
    while True:
        out, into = Counter(s for s, _ in left), Counter(t for _, t in left)
        keep = {(s, t) for s, t in left if out[s] >= 3 and into[t] >= 3}
        if keep == left:
            break
        left = keep
    df = smurfing(tx(*edges), 100.0, 3, 3)
    got = {x.primary_account_id: set(x.involved_account_ids) for x in df.collect()}
    want = defaultdict(set)
    for s, t in left:
        want[s].add(t)
    assert got == dict(want) and {f"S{i}" for i in range(6)} <= set(got) and violations(df).count() == 0
    assert smurfing(tx(*edges[:3]), 100.0, 3, 3).count() == 0
    assert smurfing(tx(*((m + k * DAY, s, t, a) for k, (m, s, t, a) in enumerate(planted))), 100.0, 3, 3).count() == 0  # not within one span


def test_behaviour_changes(spark, tx):
    steady = [(d * DAY + 60 * k, "A", "B") for d in range(30) for k in range(3)]
    burst = [(d * DAY + 5 * k, "C", f"D{k}") for d in range(30) for k in range(1 if d < 20 else 8)]
    quiet = [(d * DAY + 5 * k, "E", f"F{k}") for d in range(30) for k in range(6 if d < 20 else 1)]
    got = {x.primary_account_id: x for x in deviations(tx(*steady, *burst, *quiet)).collect()}
    assert "A" not in got and "B" not in got
    assert json.loads(got["C"].metadata)["direction"] == "up" and START + timedelta(days=20) <= got["C"].start_time + timedelta(days=1) <= START + timedelta(days=26)
    r = random.Random(3)
    days = [("a", d, r.randrange(9)) for d in range(60)]
    n = [x for *_, x in days]
    mean, spread = statistics.fmean(n), statistics.pstdev(n)
    up = down = 0.0
    want = []
    for x in n:
        z = round((x - mean) / spread, 6)
        up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
        want.append((round(up, 4), round(down, 4)))
    rows = spark.createDataFrame(days, "account string, day long, n long")
    assert [(round(float(x.up), 4), round(float(x.down), 4)) for x in cusum(rows, 0.5).orderBy("day").collect()] == want


def test_anomalies_rank_planted_outliers_first(spark, monkeypatch):
    r = random.Random(7)
    rows = [(f"A{i:03d}", *(float(r.randrange(20, 40)) for _ in anomaly.NUMERIC)) for i in range(400)]
    for i, shift in ((17, 300.0), (230, -250.0), (399, 1e6)):
        rows[i] = (rows[i][0], *(v + shift * (k % 3 == 0) for k, v in enumerate(rows[i][1:])))
    f = spark.createDataFrame(rows, ["account_id", *anomaly.NUMERIC])
    got = {x.account_id: x.anomaly_score for x in anomaly.anomaly_scores(f).collect()}
    assert sorted(sorted(got, key=got.get)[-3:]) == ["A017", "A230", "A399"] and 0.3 < statistics.median(got.values()) < 0.55
    trees = anomaly.forest(f)
    assert len(trees) == anomaly.TREES and trees == anomaly.forest(f.repartition(7))
    for name, *x in rows[::9]:
        paths = []
        for t in trees:
            node = 0
            while t["f"][node] >= 0:
                node = t["left"][node] + (x[t["f"][node]] > t["cut"][node])
            paths.append(t["path"][node])
        assert abs(got[name] - 2 ** (-statistics.fmean(paths) / anomaly.usual_path(256))) < 1e-8
    assert anomaly.anomaly_scores(f.where("false")).count() == 0
    same = spark.createDataFrame([(f"B{i}", *rows[0][1:]) for i in range(5)], ["account_id", *anomaly.NUMERIC]).withColumn("total_outgoing_amount", F.lit(None).cast("double"))
    assert len({x.anomaly_score for x in anomaly.anomaly_scores(same).collect()}) == 1


# ---- annotation files


def test_attempts_across_splits(spark, tmp_path):
    """A file that many tasks read, so that attempts begin, end and break off wherever a split does."""
    r = random.Random(5)
    lines, want, open_, n = [], [], None, 0
    for _ in range(400):
        kind = r.random()
        if kind < 0.25:
            n += 1
            open_ = (n, ["FAN-OUT", "CYCLE"][n % 2], [])
            lines.append(f"{BEGIN} - {['FAN-OUT', 'CYCLE'][n % 2]}: x{n}")
        elif kind < 0.45:
            if open_:
                want.append((*open_[:2], tuple(open_[2])))
            open_ = None
            lines.append(f"{END} - done")
        else:
            k = len(lines)
            lines.append(f"2022/09/01 00:{k % 60:02d},01,S{k},02,R{k},5.0,USD,5.0,USD,Wire,1")
            if open_:
                open_[2].append(f"S{k}")
    (tmp_path / "patterns.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "1k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_annotations(spark, str(tmp_path / "patterns.txt")).collect()
            assert sorted((x.attempt_id, x.typology, tuple(t.sender_account for t in x.transactions)) for x in got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_refined_medians_of_many_amounts_are_exact(spark):
    """More amounts than a sketch holds, on both sides; and with sketches of other amounts, which point to the wrong place."""
    n = 12_001
    e = spark.range(n, numPartitions=8).select(F.lit("hub").alias("account_id"), F.lit(1).alias("out"), (F.col("id") % 2).cast("int").alias("inc"), (F.col("id") * 7919 % n * 0.37).alias("out_amount"), F.col("id").cast("double").alias("in_amount"))
    want = statistics.median([i * 7919 % n * 0.37 for i in range(n)]), statistics.median(range(1, n, 2))
    for shift in (None, 1e6, -1e6):
        own = exact_by_sketches(e) if shift is None else refined_medians(amount_counts(e), role_sketches(e.withColumn("out_amount", F.lit(shift)).withColumn("in_amount", F.lit(shift))))
        (r,) = own.collect()
        assert (r.median_outgoing_amount, r.median_incoming_amount) == want


def test_a_state_keeps_medians_of_many_amounts_exact(spark, tx):
    rows = [(i * 7, "A", f"B{i % 3}", float(i * 7919 % 6007)) for i in range(6007)]
    df = tx(*rows).cache()
    at = F.lit(START + timedelta(minutes=7 * 2500))
    state = fs.merged(fs.folded(df.where(F.col("timestamp") < at)), fs.folded(df.where(F.col("timestamp") >= at)))
    assert fs.features_of(state).where("account_id = 'A'").first().median_outgoing_amount == 3003.0


def test_results_are_rounded_as_sql_does(spark):
    (r,) = spark.range(1).select(_r(F.lit(3118.29) / 56).alias("x"), _r(F.lit(-0.00005)).alias("y"), _r(F.lit(float("nan"))).alias("z")).collect()
    assert (r.x, r.y) == (55.6838, -0.0001) and r.z != r.z
