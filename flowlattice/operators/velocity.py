"""Velocity: accounts with many transactions in little time, told from their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import number, require, severity, without_labels
from flowlattice.plans.evidence import evidence, parameters


def velocity(features: DataFrame, min_max_transactions_in_hour: int = 10, min_rapid_gap_count: int = 5, min_transactions_per_active_hour: float = 5.0) -> DataFrame:
    """Evidence of accounts that reach one of three thresholds; severity goes by the largest ratio to a threshold."""
    f = without_labels(features)
    require(f, {"account_id", "max_transactions_in_hour", "rapid_gap_count", "transactions_per_active_hour"}, "velocity")
    entity = F.coalesce(F.col("entity_id").cast("string"), F.lit("")) if "entity_id" in f.columns else F.lit("")
    f = f.select(
        F.col("account_id").cast("string").alias("account"), entity.alias("entity"), number(f, "max_transactions_in_hour").alias("peak"), number(f, "rapid_gap_count").alias("rapid"),
        number(f, "transactions_per_active_hour").alias("rate"), number(f, "transaction_count").alias("n"), (number(f, "total_outgoing_amount") + number(f, "total_incoming_amount")).alias("amount"),
    )
    hits = [F.col("peak") >= min_max_transactions_in_hour, F.col("rapid") >= min_rapid_gap_count, F.col("rate") >= min_transactions_per_active_hour]
    f = f.where(hits[0] | hits[1] | hits[2])
    ratio = F.greatest(F.col("peak") / float(max(min_max_transactions_in_hour, 1)), F.col("rapid") / float(max(min_rapid_gap_count, 1)), F.col("rate") / float(max(min_transactions_per_active_hour, 1e-9)))
    whole = lambda c: F.col(c).cast("long")
    reasons = F.array(
        F.when(hits[0], F.format_string(f"The busiest hour has %d transactions; {min_max_transactions_in_hour} are enough.", whole("peak"))),
        F.when(hits[1], F.format_string(f"%d transactions follow another quickly; {min_rapid_gap_count} are enough.", whole("rapid"))),
        F.when(hits[2], F.format_string(f"An active hour has %.2f transactions on average; {min_transactions_per_active_hour} are enough.", "rate")),
    )
    return evidence(
        f, detector_name=F.lit("velocity_detector"), typology=F.lit("VELOCITY"), primary_account_id="account", involved_account_ids=F.array("account"), entity_ids=F.array("entity"),
        transaction_count=whole("n"), total_amount="amount", evidence_strength=F.least(F.lit(1.0), ratio), severity=severity(ratio, 1.75, 1.25),
        reasons=F.filter(reasons, lambda x: x.isNotNull()), transaction_references=F.array().cast("array<string>"),
        detector_parameters=parameters(min_max_transactions_in_hour=min_max_transactions_in_hour, min_rapid_gap_count=min_rapid_gap_count, min_transactions_per_active_hour=min_transactions_per_active_hour),
        metadata=F.struct(whole("peak").alias("max_transactions_in_hour"), whole("rapid").alias("rapid_gap_count"), F.col("rate").alias("transactions_per_active_hour")),
    )
