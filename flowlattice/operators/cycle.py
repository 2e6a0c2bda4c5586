"""Cycles: money that comes back to its start through a chain of later and later transactions.

A cycle is looked for at its busiest account, the anchor: half of it is grown forward from there, half backward, and
halves meet at the account in the middle.  Only accounts less busy than the anchor may stand on a half, so no path leads
through a hub; a hub's own edges are read once for the cycles that it anchors.  Halves have half the hops, so their number
is that of short paths, and every cycle is found once.

Seen from the anchor, times ascend, but for one step down where the cycle ends and begins; a half that has this step in it is
"turned".  After the step, times stay before those of the half's first edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import LISTED, rotated, severity, unique_in_order, window_micros
from flowlattice.functions.materialise import discard, written
from flowlattice.operators.prepare import ENTITIES, prepare
from flowlattice.plans.evidence import empty, evidence, parameters

#: How often edges that lead nowhere are taken out before paths grow.
PRUNINGS = 2


def _near(b: Column) -> Column:
    """The buckets that hold every time within one width of a bucket's times."""
    return F.explode(F.array(b - 1, b, b + 1))


def pruned(edges: DataFrame, width: int) -> DataFrame:
    """Edges (sender, receiver, t, ...) whose receiver also sends and whose sender also receives, about a width away at most; others are on no cycle."""
    bucket = F.floor(F.col("t") / width)
    for _ in range(PRUNINGS):
        sends, gets = (edges.select(F.col(mine).alias(other), bucket.alias("b")).distinct().select(other, _near(F.col("b")).alias("b")).distinct() for mine, other in (("sender", "receiver"), ("receiver", "sender")))
        edges = edges.withColumn("b", bucket).join(sends, ["receiver", "b"], "left_semi").join(gets, ["sender", "b"], "left_semi").drop("b")
    return edges


def _ranked(edges: DataFrame) -> DataFrame:
    """Edges with rs and rr, by which senders and receivers are told busier from less busy; never equal for two accounts."""
    ends = edges.select(F.explode(F.array("sender", "receiver")).alias("account")).groupBy("account").agg(F.count("*").alias("c"))
    for account, rank in (("sender", "rs"), ("receiver", "rr")):
        edges = edges.join(ends.select(F.col("account").alias(account), F.struct("c", "account").alias(rank)), account)
    return edges


def halves(edges: DataFrame, hops: int, width: int, forward: bool) -> list[DataFrame]:
    """Half cycles of 1 to ``hops`` hops: anchor, at (their other end), accounts (between the two), steps, first and last (times, in the order of payment), turned.

    ``edges``: sender, receiver, t, step, rs, rr.
    """
    near, far = ("sender", "receiver") if forward else ("receiver", "sender")
    r_near, r_far = ("rs", "rr") if forward else ("rr", "rs")
    none = F.array().cast("array<string>")
    level = edges.where(F.col(r_far) < F.col(r_near)).select(F.col(near).alias("anchor"), F.col(r_near).alias("r0"), F.col(far).alias("at"), none.alias("accounts"), F.array("step").alias("steps"), F.col("t").alias("first"), F.col("t").alias("last"), F.lit(False).alias("turned"))
    nxt = edges.select(F.col(near).alias("at"), F.floor(F.col("t") / width).alias("b"), F.col(far).alias("to"), F.col(r_far).alias("r"), F.col("t"), F.col("step"))
    out = [level]
    t, first, last, turned = F.col("t"), F.col("first"), F.col("last"), F.col("turned")
    if forward:
        on = (t > last) & F.when(turned, t < first).otherwise(t - first <= width)
        turn = ~turned & (t < first) & (last - t <= width)
        new_first, new_last = first, t
    else:
        on = (t < first) & F.when(turned, t > last).otherwise(last - t <= width)
        turn = ~turned & (t > last) & (t - first <= width)
        new_first, new_last = t, last
    joined = (lambda own, new: F.concat(own, new)) if forward else (lambda own, new: F.concat(new, own))
    for _ in range(hops - 1):
        probe = level.withColumn("b", _near(F.floor((last if forward else first) / width)))
        grown = probe.join(nxt, ["at", "b"]).where((on | turn) & (F.col("r") < F.col("r0")) & (F.col("to") != F.col("at")) & ~F.array_contains("accounts", F.col("to")))
        grown = grown.select("anchor", "r0", F.col("to").alias("at"), joined(F.col("accounts"), F.array("at")).alias("accounts"), joined(F.col("steps"), F.array("step")).alias("steps"), new_first.alias("first"), new_last.alias("last"), (turned | turn).alias("turned"))
        level = written(grown, "halves")
        out.append(level)
    return out


def joined(ahead: DataFrame, back: DataFrame, width: int) -> DataFrame:
    """accounts, steps of the cycles that two halves make, from their first payment on."""
    g = back.select("anchor", "at", F.col("accounts").alias("g_accounts"), F.col("steps").alias("g_steps"), F.col("first").alias("g1"), F.col("last").alias("g2"), F.col("turned").alias("g_turned"), F.floor(F.col("first") / width).alias("b"))
    f = ahead.withColumn("b", _near(F.floor(F.col("first") / width)))
    f1, f2, g1, g2 = (F.col(c) for c in ("first", "last", "g1", "g2"))
    at_anchor = (f2 < g1) & (g2 - f1 <= width)
    at_middle = (f2 > g1) & (g2 < f1) & (f2 - g1 <= width)
    inside = (f2 < g1) & (g2 < f1)
    fits = F.when(F.col("turned") & F.col("g_turned"), False).when(F.col("turned") | F.col("g_turned"), inside).otherwise(at_anchor | at_middle)
    both = f.join(g, ["anchor", "at", "b"]).where(fits & ~F.arrays_overlap("accounts", "g_accounts"))
    both = both.select(F.concat(F.array("anchor"), "accounts", F.array("at"), "g_accounts").alias("accounts"), F.concat("steps", "g_steps").alias("steps"))
    p = F.array_position("steps", F.array_min("steps")).cast("int")
    turned = lambda c: F.concat(F.slice(c, p, F.size(c)), F.slice(c, F.lit(1), p - 1)).alias(c)
    return both.select(turned("accounts"), turned("steps"))


def paths(tx: DataFrame, min_hops: int, max_hops: int, max_elapsed_hours: float) -> DataFrame:
    """Every account cycle once, by its first occurrence: accounts, steps (array of t, ord, ...), hops.

    Each hop is strictly later than the one before, none is later than W after the first, and no account comes twice.
    Halves carry times and numbers of edges alone; what else an edge has is joined to the cycles that are found.
    First: the smallest sequence of (t, ord).
    """
    width = window_micros(max_elapsed_hours)
    edges = prepare(tx, "cycle").where((F.col("sender") != F.col("receiver")) & (F.col("sender") != "") & (F.col("receiver") != ""))
    amount = F.col("paid") if "amount_paid" in tx.columns else F.col("received")
    edges = written(pruned(edges.select("sender", "receiver", "t", "ord", "timestamp", amount.alias("amount"), "ref", *ENTITIES), width).withColumn("edge", F.monotonically_increasing_id()), "edges")
    bare = written(_ranked(edges.select("sender", "receiver", "t", F.struct("t", "ord", "edge").alias("step"))), "ranked")
    ahead, back = halves(bare, -(-max_hops // 2), width, True), halves(bare, max_hops // 2, width, False)
    found = None
    for hops in range(min_hops, max_hops + 1):
        own = joined(ahead[-(-hops // 2) - 1], back[hops // 2 - 1], width)
        found = own if found is None else found.unionByName(own)
    place = F.transform("steps", lambda s: F.struct(s["t"], s["ord"]))
    first = found.groupBy(rotated(F.col("accounts")).alias("key")).agg(F.min_by(F.struct("accounts", "steps"), place).alias("x"))
    first = written(first.select("key", "x.*"), "cycles")
    discard(bare, *ahead[1:], *back[1:])
    steps = first.select("key", F.posexplode("steps").alias("place", "s")).select("key", "place", F.col("s.edge").alias("edge"))
    whole = F.struct("place", "t", "ord", "timestamp", "amount", "ref", *ENTITIES)
    steps = steps.join(edges, "edge").groupBy("key").agg(F.array_sort(F.collect_list(whole)).alias("steps"))  # max_hops steps
    return first.drop("steps").join(steps, "key").select(F.col("accounts")[0].alias("start"), "accounts", "steps", F.size("steps").alias("hops"))


def cycles(tx: DataFrame, min_hops: int = 3, max_hops: int = 6, max_elapsed_hours: float = 24) -> DataFrame:
    """Evidence of cycles of min_hops to max_hops transactions within a time window; one row an account cycle."""
    if min_hops < 2 or max_hops < min_hops:
        return empty(tx.sparkSession)
    c = paths(tx, min_hops, max_hops, max_elapsed_hours)
    start, end = F.col("steps")[0]["timestamp"], F.element_at("steps", -1)["timestamp"]
    elapsed = (F.element_at("steps", -1)["t"] - F.col("steps")[0]["t"]) / F.lit(3.6e9)
    ratio = F.col("hops") / F.lit(float(min_hops))
    whole = F.concat("accounts", F.array("start"))
    entities = F.flatten(F.transform("steps", lambda s: F.array(*(s[e] for e in ENTITIES))))
    return evidence(
        c, detector_name=F.lit("cycle_detector"), typology=F.lit("CYCLE"), primary_account_id="start",
        involved_account_ids=F.slice(unique_in_order(F.col("accounts")), 1, LISTED), entity_ids=F.slice(unique_in_order(entities), 1, LISTED),
        start_time=start, end_time=end, transaction_count="hops", total_amount=F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["amount"]),
        evidence_strength=F.least(F.lit(1.0), ratio), severity=severity(ratio),
        reasons=F.array(F.format_string("Money came back after %d hops in %.2f hours.", "hops", elapsed), F.concat(F.lit("The path is "), F.array_join(whole, " -> "), F.lit("."))),
        detector_parameters=parameters(min_hops=min_hops, max_hops=max_hops, max_elapsed_hours=max_elapsed_hours),
        transaction_references=F.transform("steps", lambda s: s["ref"]),
        metadata=F.struct(whole.alias("cycle_path"), F.col("accounts").alias("ordered_accounts"), F.col("hops").alias("hop_count")),
    )
