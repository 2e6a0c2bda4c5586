"""Smurfing: groups in which many accounts pay small amounts to many of the same receivers.

The small payments of a span of time are a graph of senders and receivers.  Its core is what is left when senders with
too few receivers and receivers with too few senders are taken out until nothing changes.  Each round counts degrees by plain
aggregates that combine on the map side and keeps the edges of what stays; rounds go on while edges drop out.

An extension of the typologies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import at_least_one, exact_sum, first_unique, severity, window_micros
from flowlattice.functions.materialise import discard, written
from flowlattice.operators.prepare import prepare
from flowlattice.plans.evidence import evidence, parameters


def core(edges: DataFrame, min_receivers: int, min_senders: int) -> DataFrame:
    """The edges (span, sender, receiver; distinct) of the core of every span."""
    now, n = written(edges, "core"), None
    n = now.count()
    while n:
        out = now.groupBy("span", "sender").agg(F.count("*").alias("c")).where(F.col("c") >= min_receivers).drop("c")
        into = now.groupBy("span", "receiver").agg(F.count("*").alias("c")).where(F.col("c") >= min_senders).drop("c")
        left = written(now.join(out, ["span", "sender"], "left_semi").join(into, ["span", "receiver"], "left_semi"), "core")
        discard(now)
        now, before, n = left, n, left.count()
        if n == before:
            break
    return now


def smurfing(tx: DataFrame, max_amount: float = 10_000.0, min_receivers: int = 3, min_senders: int = 3, time_window_hours: float = 24) -> DataFrame:
    """Evidence of senders in a core of small payments (below ``max_amount``), a row for each of their spans of time.

    Spans are fixed, one after the other; payments to oneself don't count.
    """
    at_least_one(min_receivers=min_receivers, min_senders=min_senders)
    rows = prepare(tx, "smurfing").where((F.col("paid") < max_amount) & (F.col("sender") != F.col("receiver"))).withColumn("span", F.floor(F.col("t") / window_micros(time_window_hours)))
    left = core(rows.select("span", "sender", "receiver").distinct(), min_receivers, min_senders)
    senders = left.groupBy("span").agg(F.count_distinct("sender").alias("senders"), F.count_distinct("receiver").alias("receivers"))
    own = rows.join(left, ["span", "sender", "receiver"]).withColumn("account", F.concat_ws(" ", F.col("span").cast("string"), "sender"))
    base = own.groupBy("account", "span", "sender").agg(F.count("*").alias("n"), F.count_distinct("receiver").alias("d"), exact_sum(F.col("paid")).alias("amount"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    base = base.join(first_unique(own, "account", "receiver", ["t", "ord"], "parties"), "account").join(first_unique(own, "account", "ref", ["t", "ord"], "refs"), "account").join(senders, "span")
    ratio = F.col("d") / F.lit(float(min_receivers))
    return evidence(
        base, detector_name=F.lit("smurfing_detector"), typology=F.lit("SMURFING"), primary_account_id="sender", involved_account_ids="parties", start_time="start", end_time="end",
        transaction_count="n", total_amount="amount", evidence_strength=F.least(F.lit(1.0), ratio), severity=severity(ratio),
        reasons=F.array(F.format_string(f"The account paid %d receivers small amounts; %d senders and %d receivers are tied in this way within {time_window_hours:g} hours.", "d", "senders", "receivers")),
        detector_parameters=parameters(max_amount=max_amount, min_receivers=min_receivers, min_senders=min_senders, time_window_hours=time_window_hours),
        transaction_references="refs", metadata=F.struct("senders", "receivers"),
    )
