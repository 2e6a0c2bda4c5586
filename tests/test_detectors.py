import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flowlattice.operators.cycle import cycles
from flowlattice.functions.columns import micros
from flowlattice.operators.fan import best_windows, fan_in, fan_out
from flowlattice.operators.gather_scatter import gather_scatter
from flowlattice.operators.scatter_gather import scatter_gather
from flowlattice.plans.evidence import EVIDENCE, violations

from moments import START

DAY = 24 * 60


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.primary_account_id, r.involved_account_ids))


def star_out(n=5, step=10):
    return [(i * step, "A", f"B{i}") for i in range(n)]


def test_fan_out_finds_a_star(tx):
    (e,) = rows(fan_out(tx(*star_out())))
    assert (e.primary_account_id, e.typology, e.transaction_count, e.total_amount, e.severity) == ("A", "FAN-OUT", 5, 500.0, "low")
    assert e.involved_account_ids == [f"B{i}" for i in range(5)]
    assert e.transaction_references == [f"row-{i}" for i in range(5)]
    assert (e.start_time, e.end_time) == (START, START + timedelta(minutes=40))
    assert e.entity_ids == [] and e.evidence_strength == 1.0


@pytest.mark.parametrize("make", [lambda: star_out(4), lambda: [(i * 10, "A", "B") for i in range(9)], lambda: star_out(5, step=DAY)])
def test_fan_out_leaves_others_alone(tx, make):
    assert rows(fan_out(tx(*make()))) == []


def test_fan_windows_agree_with_loops(tx, spark):
    r = random.Random(12)
    data = [(r.randrange(0, 600), r.choice("AB"), r.choice("RSTUV")) for _ in range(250)]  # many ties in time
    df = tx(*data).select(F.col("sender_account").alias("account"), F.col("receiver_account").alias("party"), micros(F.col("timestamp")).alias("t"), "ord")
    for width in (1, 7, 45, 10_000):
        got = {x.account: (x.d, x.n, x.t_end) for x in best_windows(df, width * 60_000_000, 2, 3).collect()}
        base, want = df.agg(F.min(F.col("t"))).first()[0] - min(m for m, *_ in data) * 60_000_000, {}
        for a in "AB":
            own = [(m, p) for m, s, p in data if s == a]
            seen = [(len({p for m, p in own if e - width <= m <= e}), sum(e - width <= m <= e for m, _ in own), -e) for e in {m for m, _ in own}]
            if best := max((x for x in seen if x[0] >= 2 and x[1] >= 3), default=None):
                want[a] = (best[0], best[1], base - best[2] * 60_000_000)
        assert got == want, width


def test_a_hub_with_very_many_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        n = F.col("id")
        rows = spark.range(300_000).select(F.lit("hub").alias("account"), F.concat(F.lit("p"), (n % 5_000).cast("string")).alias("party"), (n * 250_000).alias("t"), n.alias("ord"))
        (x,) = best_windows(rows, 24 * 3_600_000_000, 5, 5).collect()
        assert (x.account, x.d, x.n) == ("hub", 5_000, 300_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")


def test_fan_window_is_closed(tx):
    edge = star_out(4) + [(DAY, "A", "Z")]
    assert len(rows(fan_out(tx(*edge)))) == 1
    late = star_out(4) + [(DAY + 1, "A", "Z")]
    assert rows(fan_out(tx(*late))) == []


def test_fan_in_mirrors_and_severity_grows(tx):
    (e,) = rows(fan_in(tx(*[(i, f"S{i}", "X") for i in range(10)])))
    assert (e.primary_account_id, e.typology, e.severity, e.transaction_count) == ("X", "FAN-IN", "high", 10)


def test_fan_lists_at_most_twenty(tx):
    (e,) = rows(fan_out(tx(*[(i, "A", f"B{i:03}") for i in range(50)])))
    assert len(e.involved_account_ids) == len(e.transaction_references) == 20 and e.transaction_count == 50


def test_fan_rejects_thresholds_below_one(tx):
    with pytest.raises(ValueError):
        fan_out(tx(*star_out()), min_distinct_receivers=0)
    with pytest.raises(ValueError):
        fan_out(tx(*star_out()).drop("timestamp"))


RING = [(0, "A", "B"), (10, "B", "C"), (20, "C", "D"), (30, "D", "A")]


def test_cycle_found_once_whatever_the_order(tx):
    for order in (RING, RING[::-1], RING[2:] + RING[:2]):
        (e,) = rows(cycles(tx(*order)))
        assert (e.primary_account_id, e.transaction_count, e.total_amount) == ("A", 4, 400.0)
        assert e.involved_account_ids == ["A", "B", "C", "D"]


@pytest.mark.parametrize("edges", [RING[:3], [(30, "A", "B"), (20, "B", "C"), (10, "C", "A")], [(0, "A", "B"), (0, "B", "C"), (0, "C", "A")], [(0, "A", "B"), (1, "B", "A")], [(0, "A", "B"), (10, "B", "C"), (DAY + 1, "C", "A")], [(0, "", "B"), (1, "B", "C"), (2, "C", "")]])
def test_no_cycle(tx, edges):
    assert rows(cycles(tx(*edges))) == []


def test_cycle_guards(tx):
    assert rows(cycles(tx(*RING), min_hops=1)) == rows(cycles(tx(*RING), min_hops=5, max_hops=4)) == []


GATHER = [(0, "S1", "X"), (10, "S2", "X"), (20, "S3", "X"), (30, "X", "D1"), (40, "X", "D2")]


def test_gather_scatter(tx):
    (e,) = rows(gather_scatter(tx(*GATHER)))
    assert (e.primary_account_id, e.transaction_count, e.severity) == ("X", 5, "high")
    assert e.involved_account_ids == ["X", "S1", "S2", "S3", "D1", "D2"]
    assert rows(gather_scatter(tx(*GATHER), min_distinct_incoming_senders=0)) == []
    assert rows(gather_scatter(tx(*GATHER), min_distinct_outgoing_destinations=3)) == []


@pytest.mark.parametrize("edges", [[(5, "X", "D"), *GATHER[:3]], [*GATHER[:2], (30, "X", "D")], [*GATHER[:3], (20, "X", "D")], [*GATHER[:3], (DAY + 1, "X", "D")]])
def test_no_gather_scatter(tx, edges):
    assert rows(gather_scatter(tx(*edges))) == []


SCATTER = [(0, "A", "I1"), (10, "A", "I2"), (20, "I1", "X"), (30, "I2", "X")]


def test_scatter_gather(tx):
    (e,) = rows(scatter_gather(tx(*SCATTER)))
    assert (e.primary_account_id, e.transaction_count, e.severity, e.total_amount) == ("A", 4, "low", 400.0)
    assert e.involved_account_ids == ["A", "I1", "I2", "X"]
    assert rows(scatter_gather(tx(*SCATTER), min_intermediaries=1)) == []


@pytest.mark.parametrize("edges", [SCATTER[:3], [*SCATTER[:2], (20, "I1", "X"), (30, "I2", "Y")], [(0, "A", "I1"), (10, "A", "I2"), (20, "I1", "A"), (30, "I2", "A")], [(0, "A", "I1"), (10, "A", "I2"), (20, "I1", "I2"), (30, "I2", "I1")], [*SCATTER[:3], (DAY + 1, "I2", "X")], [(0, "A", "I1"), (10, "A", "I2"), (0, "I1", "X"), (30, "I2", "X")]])
def test_no_scatter_gather(tx, edges):
    assert rows(scatter_gather(tx(*edges))) == []


def test_an_intermediary_may_pay_before_the_scatter_ends(tx):
    assert len(rows(scatter_gather(tx((0, "A", "I1"), (5, "I1", "X"), (10, "A", "I2"), (30, "I2", "X"))))) == 1


@pytest.mark.parametrize("detect", [fan_out, fan_in, cycles, gather_scatter, scatter_gather])
def test_labels_nulls_empties_and_partitions_change_nothing(spark, tx, detect):
    edges = star_out() + RING + GATHER + [(m, s.replace("A", "O"), r) for m, s, r in SCATTER] + [(i, f"S{i}", "Y") for i in range(6)]
    base = tx(*edges)
    want = rows(detect(base))
    assert want and rows(detect(base.withColumn("is_laundering", F.lit(1)).withColumn("label", F.lit("x")))) == want
    assert rows(detect(base.repartition(7))) == want
    bad = spark.createDataFrame([(99, None, "A", "B", 1.0, 1.0), (98, START, None, "B", 1.0, 1.0)], "ord long, timestamp timestamp_ntz, sender_account string, receiver_account string, amount_paid double, amount_received double")
    assert rows(detect(base.unionByName(bad, allowMissingColumns=True))) == want
    none = detect(base.where("false"))
    assert none.count() == 0 and none.dtypes == [(f.name, f.dataType.simpleString()) for f in EVIDENCE]
    assert violations(detect(base)).count() == 0


def brute(edges, w):
    """Fan-out, cycles, gather-scatter and scatter-gather by plain loops; edges are (t, s, r) with their place as tie-break."""
    e = sorted((t, i, s, r) for i, (t, s, r) in enumerate(edges))
    fan = {}
    for a in {s for _, _, s, _ in e}:
        own = [x for x in e if x[2] == a]
        best = None
        for t in {x[0] for x in own}:
            win = [x for x in own if t - w <= x[0] <= t]
            d, n = len({x[3] for x in win}), len(win)
            if d >= 3 and n >= 3 and (best is None or (d, n, -t) > best):
                best = (d, n, -t)
        if best:
            fan[a] = (best[1], -best[2])
    rings = {}

    def grow(path, seen):
        t0, last = path[0][0], path[-1]
        for x in e:
            if x[2] == last[3] and x[0] > last[0] and x[0] - t0 <= w:
                if x[3] == path[0][2]:
                    if 3 <= len(path) + 1 <= 4:
                        acc = [p[2] for p in path] + [x[2]]
                        k = acc.index(min(acc))
                        rings.setdefault(tuple(acc[k:] + acc[:k]), tuple(acc))
                elif x[3] not in seen and len(path) + 1 < 4:
                    grow([*path, x], seen | {x[3]})

    for x in e:
        if x[2] != x[3]:
            grow([x], {x[2], x[3]})
    gs = {}
    for a in {r for *_, r in e}:
        seen, pre = set(), []
        for x in (x for x in e if x[3] == a):
            pre.append(x)
            seen.add(x[2])
            if len(seen) == 2:
                out = [y for y in e if y[2] == a and pre[-1][0] < y[0] <= pre[0][0] + w]
                if out:
                    gs[a] = len(pre) + len(out)
                break
    sg = {}
    for a in {s for _, _, s, _ in e}:
        met, pre = {}, []
        for x in (x for x in e if x[2] == a):
            pre.append(x)
            met.setdefault(x[3], x[0])
            if len(met) == 2:
                reach = []
                for via, t in met.items():
                    first = {}
                    for y in e:
                        if y[2] == via and t < y[0] <= pre[0][0] + w and y[3] not in {a, *met}:
                            first.setdefault(y[3], y[0])
                    reach.append(first)
                both = set(reach[0]) & set(reach[1])
                if both:
                    sg[a] = (min(both, key=lambda d: (max(f[d] for f in reach), d)), len(pre) + 2)
                break
    return fan, rings, gs, sg


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs_with_many_ties(tx, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(40), f"N{rnd.randrange(6)}", f"N{rnd.randrange(6)}") for _ in range(rnd.randrange(10, 45))]
    w = 12
    fan, rings, gs, sg = brute(edges, w)
    frame, hours = tx(*edges), w / 60
    got = {r.primary_account_id: (r.transaction_count, (r.end_time - START).total_seconds() / 60) for r in fan_out(frame, 3, hours, 3).collect()}
    assert {a: n for a, (n, _) in got.items()} == {a: n for a, (n, _) in fan.items()}
    assert all(got[a][1] <= fan[a][1] for a in fan)
    assert {tuple(r.involved_account_ids) for r in cycles(frame, 3, 4, hours).collect()} == set(rings.values())
    assert {r.primary_account_id: r.transaction_count for r in gather_scatter(frame, 2, 1, hours).collect()} == gs
    assert {r.primary_account_id: (r.involved_account_ids[-1], r.transaction_count) for r in scatter_gather(frame, 2, hours).collect()} == sg


