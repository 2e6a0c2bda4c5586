"""Detectors at accounts with very many counterparties, and their sums under any order of rows."""

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flowlattice.operators import cycle
from flowlattice.operators.cycle import cycles
from flowlattice.operators.fan import fan_in, fan_out
from flowlattice.operators.gather_scatter import gather_scatter
from flowlattice.operators.prepare import prepare
from flowlattice.operators.scatter_gather import scatter_gather
from flowlattice.plans.assessment import aggregate
from flowlattice.plans.evidence import union

from moments import START


def transactions(spark, edges):
    """Of (minutes, sender, receiver), without a row of Python a transaction on the way."""
    cols = list(zip(*edges, strict=True))
    rows = spark.createDataFrame([(list(cols[0]), list(cols[1]), list(cols[2]))], "m array<long>, s array<string>, r array<string>")
    rows = rows.select(F.posexplode(F.arrays_zip("m", "s", "r")).alias("ord", "x"))
    at = F.timestamp_add("MINUTE", F.col("x.m").cast("int"), F.lit(START).cast("timestamp_ntz"))
    return rows.select(F.col("ord").cast("long").alias("ord"), at.alias("timestamp"), F.col("x.s").alias("sender_account"), F.col("x.r").alias("receiver_account"), (F.col("ord") % 97 + 0.1).alias("amount_paid"), (F.col("ord") % 97 + 0.1).alias("amount_received"))


def test_no_path_leads_through_a_hub(spark):
    """10,000 payments in and out within a day, all of accounts that are paid and pay before and after, and two cycles."""
    n = 10_000
    edges = [(i % 300, f"a{i}", "hub") for i in range(n)] + [(400 + i % 300, "hub", f"b{i}") for i in range(n)]
    edges += [(0, f"x{i}", f"a{i}") for i in range(n)] + [(900, f"b{i}", f"y{i}") for i in range(n)]
    edges += [(1000, "b7", "a7")]  # too late for a7 -> hub; hub -> b7 -> a7 ends there
    edges += [(50, "c1", "hub"), (450, "hub", "c2"), (460, "c2", "c1")]  # starts at c1
    edges += [(500, "hub", "d1"), (600, "d1", "d2"), (700, "d2", "d3"), (800, "d3", "hub")]  # starts at the hub
    df = transactions(spark, edges)
    got = sorted(tuple(r.involved_account_ids) for r in cycles(df, 3, 6).collect())
    assert got == [("a7", "hub", "b7"), ("c1", "hub", "c2"), ("hub", "d1", "d2", "d3")]
    width = 24 * 3_600_000_000
    kept = cycle.pruned(prepare(df, "x").select("sender", "receiver", "t", "ord"), width)
    bare = cycle._ranked(kept.select("sender", "receiver", "t", F.struct("t", "ord", F.col("ord").alias("edge")).alias("step")))
    assert sum(x.count() for x in cycle.halves(bare, 3, width, True) + cycle.halves(bare, 3, width, False)) < 8 * n


@pytest.mark.parametrize("seed", range(3))
def test_cycles_of_up_to_six_agree_with_search(spark, seed):
    """Many parallel payments and ties; accounts of all degrees."""
    r = random.Random(seed)
    names = "ABCDEFG"
    edges = [(r.randrange(0, 60), *(r.choice(names[: 3 + k % 5]) for _ in range(2))) for k in range(45)]
    hours = 0.4
    first = {}

    def walk(start, at, path, steps):
        for i, (m, s, t) in enumerate(edges):
            if s != at or s == t or m <= edges[steps[-1]][0] or m - edges[steps[0]][0] > hours * 60:
                continue
            if t == start and len(path) >= 3:
                low = path.index(min(path))
                key, place = tuple(path[low:] + path[:low]), [(edges[k][0], k) for k in [*steps, i]]
                first[key] = min(first.get(key, (place, path)), (place, path))
            elif t not in path and len(path) < 6:
                walk(start, t, [*path, t], [*steps, i])

    for i, (_, s, t) in enumerate(edges):
        if s != t:
            walk(s, t, [s, t], [i])
    df = transactions(spark, edges)
    got = cycles(df, 3, 6, hours).select("involved_account_ids", "transaction_references", "start_time").collect()
    ref = lambda k, s, t: f"{START + timedelta(minutes=k)}|{s}|{t}"
    want = Counter((tuple(path), tuple(ref(*edges[k]) for _, k in place)) for place, path in first.values())
    assert len(first) > 3 and Counter((tuple(g[0]), tuple(g[1])) for g in got) == want


def test_scatter_gather_through_a_hub(spark):
    """5,000 origins pay one hub, which pays 5,000 accounts, and a small intermediary each."""
    n = 5_000
    edges = [(0, f"o{i}", "hub") for i in range(n)] + [(1, f"o{i}", f"v{i}") for i in range(n)]
    edges += [(10 + i % 100, "hub", f"d{i}") for i in range(n)] + [(200, f"v{i}", f"d{i}") for i in range(0, n, 1000)] + [(200, f"v{i}", f"e{i}") for i in range(1, n, 2)]
    df = transactions(spark, edges)
    got = {r.primary_account_id: tuple(r.involved_account_ids) for r in scatter_gather(df).collect()}
    assert got == {f"o{i}": (f"o{i}", "hub", f"v{i}", f"d{i}") for i in range(0, n, 1000)}


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    r = random.Random(1)
    edges = [(r.randrange(0, 3000), f"A{r.randrange(12)}", f"A{r.randrange(12)}") for _ in range(600)]
    df = transactions(spark, edges)
    # doubles whose sums depend on their order
    df = df.withColumn("amount_paid", F.col("ord") * 0.1 + 1e-6 * F.col("ord")).withColumn("amount_received", F.lit(1e9) / (F.col("ord") + 3))
    orders = [df.repartition(5, "ord"), df.orderBy(F.desc("ord")).coalesce(1), df.repartition(3, "sender_account")]
    for detect in (fan_out, fan_in, gather_scatter, scatter_gather):
        found = [Counter((x.primary_account_id, x.total_amount) for x in detect(d).collect()) for d in orders]
        assert found[0] and found[0] == found[1] == found[2], detect
    sums = [Counter((x.primary_account_id, x.total_suspicious_amount) for x in aggregate(union(fan_out(d), fan_in(d), gather_scatter(d))).collect()) for d in orders]
    assert sums[0] and sums[0] == sums[1] == sums[2]
