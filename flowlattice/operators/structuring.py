"""Structuring: payments kept just below a limit that together pass it, again and again.

An account's near-limit payments, in order of time, are packed into windows: stretches of consecutive such payments within W
whose sum reaches the total.  As many windows are taken as can be without sharing a payment, each time the one that ends first.

For every payment, running sums give the latest payment with which a window that ends there can start; windows then follow
each other by a pointer from each to the first that starts after it.  The chain from the first window is read off by
doubling pointers, so that the number of rounds grows with the logarithm of the windows of an account.

An extension: it goes further than the near-limit counts among the features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlattice.functions.columns import LISTED, exact_sum, severity, window_micros
from flowlattice.functions.materialise import discard, written
from flowlattice.operators.prepare import prepare
from flowlattice.plans.evidence import empty, evidence, parameters

MICRO = 1_000_000


def near_payments(tx: DataFrame, limit: float, band: float) -> DataFrame:
    """account, place (from 1, in order of time), t, ord, timestamp, amount, ref, s (the running sum in millionths) of payments in [limit (1 - band), limit)."""
    rows = prepare(tx, "structuring").where((F.col("paid") >= limit * (1 - band)) & (F.col("paid") < limit) & (F.col("paid") > 0))
    order = Window.partitionBy("account").orderBy("t", "ord")
    rows = rows.select(F.col("sender").alias("account"), "t", "ord", "timestamp", F.col("paid").alias("amount"), "ref", F.round(F.col("paid") * MICRO).cast("long").alias("x"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("account", F.row_number().over(order).cast("long").alias("place"), "t", "ord", "timestamp", "amount", "ref", "x", F.sum("x").over(upto).alias("s"))


def windows(rows: DataFrame, total: float, width: int) -> DataFrame:
    """account, first, last (places): for every payment that can end a window, the window that starts last."""
    need = round(total * MICRO)
    before = Window.partitionBy("account").orderBy("s").rangeBetween(Window.unboundedPreceding, -need)
    ends = rows.withColumn("first", F.count("*").over(before) + 1).where(F.col("s") >= need).select("account", "first", F.col("place").alias("last"), F.col("t").alias("t_last"))
    starts = rows.select("account", F.col("place").alias("first"), F.col("t").alias("t_first"))
    return ends.join(starts, ["account", "first"]).where(F.col("t_last") - F.col("t_first") <= width).select("account", "first", "last")


def packed(found: DataFrame) -> DataFrame:
    """account, first, last of the windows that are taken."""
    found = written(found, "windows")
    asked = found.select("account", (F.col("last") + 1).alias("at"), F.lit(0).alias("kind"), "last", F.lit(None).cast("long").alias("to"))
    there = found.select("account", F.col("first").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("last"), F.col("last").alias("to"))
    # starts and ends rise together, so the next window is the first that starts late enough
    ahead = Window.partitionBy("account").orderBy("at", "kind", "to").rowsBetween(0, Window.unboundedFollowing)
    jump = asked.unionByName(there).withColumn("next", F.first("to", ignorenulls=True).over(ahead)).where("kind = 0 and next is not null")
    jumps = [written(jump.select("account", "last", "next"), "jumps")]
    while True:
        j = jumps[-1]
        further = j.select("account", F.col("last").alias("next"), F.col("next").alias("far"))
        further = written(j.join(further, ["account", "next"]).select("account", "last", F.col("far").alias("next")), "jumps")
        jumps.append(further)
        if further.isEmpty():
            break
    taken = found.groupBy("account").agg(F.min("last").alias("last"))
    for j in reversed(jumps[:-1]):
        taken = written(taken.unionByName(taken.join(j, ["account", "last"]).select("account", F.col("next").alias("last"))), "taken")
    out = written(found.join(taken, ["account", "last"]).select("account", "first", "last"), "packed")
    discard(found, *jumps)
    return out


def structuring(tx: DataFrame, limit: float = 10_000.0, band: float = 0.05, total: float | None = None, max_time_window_hours: float = 72, min_windows: int = 1) -> DataFrame:
    """Evidence of accounts with ``min_windows`` windows or more; ``total`` is the limit unless given.  A window may be one payment if that reaches the total."""
    if limit <= 0 or not 0 < band <= 1 or min_windows < 1:
        return empty(tx.sparkSession)
    total = limit if total is None else total
    rows = written(near_payments(tx, limit, band), "near")
    taken = packed(windows(rows, total, window_micros(max_time_window_hours)))
    own = taken.select("account", "first", F.explode(F.sequence("first", "last")).alias("place")).join(rows, ["account", "place"])
    base = own.groupBy("account").agg(
        F.count_distinct("first").alias("windows"), F.count("*").alias("n"), exact_sum(F.col("amount")).alias("amount"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.max("place").alias("largest"),
    ).where(F.col("windows") >= min_windows)
    nth = F.row_number().over(Window.partitionBy("account").orderBy("place"))
    refs = own.withColumn("nth", nth).where(F.col("nth") <= LISTED).groupBy("account").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "ref"))), lambda x: x["ref"]).alias("refs"))
    base = base.join(refs, "account")
    ratio = F.col("windows") / F.lit(float(min_windows))
    return evidence(
        base, detector_name=F.lit("structuring_detector"), typology=F.lit("STRUCTURING"), primary_account_id="account", involved_account_ids=F.array("account"),
        start_time="start", end_time="end", transaction_count="n", total_amount="amount", evidence_strength=F.least(F.lit(1.0), ratio), severity=severity(ratio),
        reasons=F.array(F.format_string(f"Payments just below {limit:g} reach {total:g} together %d times, each within {max_time_window_hours:g} hours.", "windows")),
        detector_parameters=parameters(limit=limit, band=band, total=total, max_time_window_hours=max_time_window_hours, min_windows=min_windows),
        transaction_references="refs", metadata=F.struct("windows"),
    )
