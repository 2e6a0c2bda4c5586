"""Gather-scatter: an account first receives from several senders, then pays on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import LISTED, exact_sum, first_unique, severity, unique_in_order, window_micros
from flowlattice.functions.materialise import written
from flowlattice.operators.prefix import prefixes, within
from flowlattice.operators.prepare import prepare
from flowlattice.plans.evidence import empty, evidence, parameters


def gather_scatter(tx: DataFrame, min_distinct_incoming_senders: int = 3, min_distinct_outgoing_destinations: int = 1, max_time_window_hours: float = 24) -> DataFrame:
    """Evidence of accounts whose history starts with K senders and that pay within W of its start.

    Only the first K senders of the whole history count.  Payments must come after the K-th sender's, and by t0 + W.
    More than 20 required destinations can never be met, as 20 are listed.
    """
    if min_distinct_incoming_senders < 1 or min_distinct_outgoing_destinations < 1:
        return empty(tx.sparkSession)
    width = window_micros(max_time_window_hours)
    rows = prepare(tx, "gather-scatter")
    got = rows.select(F.col("receiver").alias("account"), F.col("sender").alias("party"), "timestamp", "t", "ord", F.col("received").alias("amount"), "ref")
    paid = rows.select(F.col("sender").alias("account"), F.col("receiver").alias("party"), "timestamp", "t", "ord", F.col("paid").alias("amount"), "ref")
    ends = written(prefixes(got, min_distinct_incoming_senders)[0], "ends")
    gather = within(got, ends).withColumn("phase", F.lit(0))
    scatter = paid.join(ends, "account").where((F.col("t") > F.col("t1")) & (F.col("t") <= F.col("t0") + width)).withColumn("phase", F.lit(1))
    order = ["t", "ord"]
    targets = first_unique(scatter, "account", "party", order, "targets").where(F.size("targets") >= min_distinct_outgoing_destinations)
    both = gather.unionByName(scatter).join(targets.select("account"), "account", "left_semi")
    at = lambda agg, phase: agg(F.when(F.col("phase") == phase, F.col("timestamp")))
    base = both.groupBy("account").agg(
        F.count("*").alias("n"), exact_sum(F.col("amount")).alias("amount"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", "phase", "ord", "ref"))), lambda x: x["ref"]).alias("refs"),
        at(F.max, 0).alias("gather_end"), at(F.min, 1).alias("scatter_start"), at(F.max, 1).alias("scatter_end"), at(F.min, 0).alias("gather_start"),
    )
    base = base.join(targets, "account").join(first_unique(gather, "account", "party", order, "senders"), "account", "left")
    n_in, n_out = F.size("senders"), F.size("targets")
    ratio = F.greatest(n_in / F.lit(float(min_distinct_incoming_senders)), n_out / F.lit(float(min_distinct_outgoing_destinations)))
    return evidence(
        base, detector_name=F.lit("gather_scatter_detector"), typology=F.lit("GATHER-SCATTER"), primary_account_id="account",
        involved_account_ids=F.slice(unique_in_order(F.concat(F.array("account"), "senders", "targets")), 1, LISTED),
        start_time="start", end_time="end", transaction_count="n", total_amount="amount",
        evidence_strength=F.least(F.lit(1.0), ratio), severity=severity(ratio),
        reasons=F.array(
            F.format_string(f"The account took in money from %d senders, then paid %d accounts, within {max_time_window_hours:g} hours.", n_in, n_out),
            F.lit("All of it came in before any went out."),
        ),
        detector_parameters=parameters(min_distinct_incoming_senders=min_distinct_incoming_senders, min_distinct_outgoing_destinations=min_distinct_outgoing_destinations, max_time_window_hours=max_time_window_hours),
        transaction_references="refs",
        metadata=F.struct(F.col("account").alias("central_account"), F.col("senders").alias("incoming_senders"), F.col("targets").alias("outgoing_destinations"),
                          F.col("gather_start").alias("gather_start_time"), F.col("gather_end").alias("gather_end_time"), F.col("scatter_start").alias("scatter_start_time"), F.col("scatter_end").alias("scatter_end_time")),
    )
