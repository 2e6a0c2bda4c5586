"""Evidence to assessments: one row an account, and its risk score.

Evidence that says the same (everything but metadata) counts once.  Evidence is ordered by a signature: its fields as
text in order of their names.  Walking in that order, evidence with references counts for the share of them that no
earlier evidence of the account has; without references it counts in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlattice.functions.columns import LABEL_COLUMNS, iso, unique_in_order
from flowlattice.functions.materialise import written
from flowlattice.plans.evidence import EVIDENCE


@dataclass(frozen=True)
class ScoringConfig:
    """Fixed values of the score; they sum to at most 96."""

    medium_threshold: float = 25.0
    high_threshold: float = 50.0
    critical_threshold: float = 75.0
    strength_weight: float = 32.0
    severity_low: float = 4.0
    severity_medium: float = 10.0
    severity_high: float = 16.0
    typology_diversity_weight: float = 16.0
    repeated_evidence_weight: float = 16.0
    activity_magnitude_weight: float = 16.0
    transaction_scale: float = 25.0
    amount_scale: float = 10_000.0


def _decimal(x: Column) -> Column:
    """A number as text with six places at most and one at least."""
    return F.regexp_replace(F.round(x, 6).cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")


def signature(e: str = "") -> Column:
    """Text by which equal evidence is told, and by which evidence is ordered."""
    c = lambda n: F.col(f"{e}{n}")
    time = lambda n: F.coalesce(iso(c(n)), F.lit(""))
    clean = F.map_filter(c("detector_parameters"), lambda k, v: ~k.isin(*LABEL_COLUMNS))
    params = F.array_sort(F.transform(F.map_entries(clean), lambda x: F.concat(x["key"], F.lit(":"), _decimal(x["value"]))))
    return F.to_json(F.struct(
        c("detector_name"), params.alias("detector_parameters"), time("end_time").alias("end_time"), F.array_sort(c("entity_ids")).alias("entity_ids"), _decimal(c("evidence_strength")).alias("evidence_strength"),
        F.array_sort(c("involved_account_ids")).alias("involved_account_ids"), c("primary_account_id"), c("reasons"), c("severity"), time("start_time").alias("start_time"), _decimal(c("total_amount")).alias("total_amount"),
        c("transaction_count").cast("string").alias("transaction_count"), F.array_sort(c("transaction_references")).alias("transaction_references"), c("typology"),
    ))


def ordered(evidence: DataFrame) -> DataFrame:
    """Evidence without repeats, with ``place`` (from 1, within its account) and ``repeats`` (rows that say it)."""
    names = [f.name for f in EVIDENCE]
    e = evidence.select(*names).withColumn("__sig", signature())
    keep = F.min(F.struct(F.coalesce("metadata", F.lit("")).alias("m"), *(n for n in names if n != "detector_parameters"))).alias("x")
    e = e.groupBy("primary_account_id", "__sig").agg(keep, F.first("detector_parameters").alias("p"), F.count("*").alias("repeats"))
    place = F.row_number().over(Window.partitionBy("primary_account_id").orderBy("__sig"))
    return e.select(place.alias("place"), *(F.col("p").alias(n) if n == "detector_parameters" else F.col(f"x.{n}").alias(n) for n in names), "repeats")


def apportioned(e: DataFrame) -> DataFrame:
    """ordered() evidence with ``share`` (of its references that are new) and ``fresh`` (those references)."""
    refs = e.select("primary_account_id", "place", F.posexplode("transaction_references").alias("i", "ref")).where("ref is not null and ref <> ''")
    first = F.min("place").over(Window.partitionBy("primary_account_id", "ref"))
    refs = refs.withColumn("new", (first == F.col("place")))
    by = refs.groupBy("primary_account_id", "place").agg(F.avg(F.col("new").cast("int")).alias("share"), F.transform(F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("i", "ref")))), lambda x: x["ref"]).alias("fresh"))
    # written evidence compresses so well that its size says little: a side to broadcast could be gigabytes on the driver
    e = e.join(by.hint("merge"), ["primary_account_id", "place"], "left")
    return e.withColumn("share", F.coalesce("share", F.lit(1.0))).withColumn("fresh", F.coalesce("fresh", F.array().cast("array<string>")))


def aggregate(evidence: DataFrame) -> DataFrame:
    """One assessment an account.  The ordered evidence, which is small against what it was found in, is written."""
    e = apportioned(written(ordered(evidence), "evidence"))
    a = e.groupBy("primary_account_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("place"), *((F.to_json(f.name).alias(f.name) if f.name == "detector_parameters" else F.col(f.name)) for f in EVIDENCE), F.col("fresh"), F.col("share")))).alias("e"),
        F.min("start_time").alias("assessment_start_time"), F.max("end_time").alias("assessment_end_time"), F.sum("repeats").alias("raw"),
    )
    each = lambda n: F.transform("e", lambda x: x[n])
    # added in the order of evidence, so that the sum is always the same
    shares = lambda n: F.aggregate("e", F.lit(0.0), lambda total, x: total + x[n] * x["share"])
    a = a.withColumn("transactions", shares("transaction_count")).withColumn("amount", shares("total_amount"))
    a = a.select(
        "primary_account_id", F.size("e").cast("long").alias("evidence_count"), unique_in_order(each("typology")).alias("typologies_detected"), unique_in_order(each("detector_name")).alias("detector_names"),
        unique_in_order(F.flatten(F.transform("e", lambda x: F.concat(F.array(x["primary_account_id"]), x["involved_account_ids"])))).alias("involved_account_ids"),
        unique_in_order(F.flatten(each("entity_ids"))).alias("entity_ids"), "assessment_start_time", "assessment_end_time",
        F.col("amount").alias("total_suspicious_amount"), F.bround("transactions").cast("long").alias("total_suspicious_transactions"),
        F.transform("e", lambda x: x.dropFields("fresh", "share", "place")).alias("contributing_evidence"),
        F.struct(F.col("raw").alias("raw_evidence_count"), F.size("e").cast("long").alias("deduplicated_evidence_count"), F.size(F.flatten(each("fresh"))).cast("long").alias("unique_transaction_reference_count"),
                 F.slice(F.flatten(each("fresh")), 1, 50).alias("unique_transaction_references")).alias("metadata"),
    )
    kinds, names = F.size("typologies_detected"), F.size("detector_names")
    reasons = F.array(
        F.concat(F.format_string("%d different pieces of evidence concern account ", "evidence_count"), F.col("primary_account_id"), F.lit(".")),
        F.when(kinds > 1, F.format_string("They show %d kinds of pattern.", kinds)),
        F.when(names > 1, F.format_string("They come from %d detectors.", names)),
    )
    return a.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))


def level(score: Column, config: ScoringConfig = ScoringConfig()) -> Column:
    return F.when(score >= config.critical_threshold, "CRITICAL").when(score >= config.high_threshold, "HIGH").when(score >= config.medium_threshold, "MEDIUM").otherwise("LOW")


def scored(assessments: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Assessments with risk_score, risk_level and score_breakdown; without evidence the score is 0."""
    e = F.col("contributing_evidence")
    weight = lambda x: F.greatest(x["transaction_count"], F.lit(1)).cast("double")
    total = lambda f: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + f(x))
    some = F.size(e) > 0
    strength = F.when(some, total(lambda x: x["evidence_strength"] * weight(x)) / total(weight)).otherwise(0.0)
    severity = lambda x: F.when(x["severity"] == "high", config.severity_high).when(x["severity"] == "medium", config.severity_medium).when(x["severity"] == "low", config.severity_low).otherwise(0.0)
    kinds = F.size(F.array_distinct(F.transform(e, lambda x: x["typology"])))
    half = config.activity_magnitude_weight / 2
    n, amount = F.col("total_suspicious_transactions"), F.col("total_suspicious_amount")
    by_count = F.when(n > 0, F.least(F.lit(half), half * F.log1p(n.cast("double")) / F.log1p(F.lit(config.transaction_scale)))).otherwise(0.0)
    by_amount = F.when(amount > 0, F.least(F.lit(half), half * F.log1p(amount / config.amount_scale) / F.log1p(F.lit(100.0)))).otherwise(0.0)
    parts = {
        "evidence_strength_score": config.strength_weight * strength,
        "severity_score": F.aggregate(e, F.lit(0.0), lambda acc, x: F.greatest(acc, severity(x))),
        "typology_diversity_score": F.when(kinds <= 0, 0.0).otherwise(F.least(F.lit(config.typology_diversity_weight), 4.0 * kinds)),
        "repeated_evidence_score": F.when(F.size(e) <= 1, 0.0).otherwise(F.least(F.lit(config.repeated_evidence_weight), 5.0 * (F.size(e) - 1))),
        "activity_magnitude_score": F.when(some, F.least(F.lit(config.activity_magnitude_weight), by_count + by_amount)).otherwise(0.0),
    }
    a = assessments.select("*", *(F.round(v, 4).alias(f"__{k}") for k, v in parts.items()), strength.alias("__strength"))
    before = sum((F.col(f"__{k}") for k in parts), F.lit(0.0))
    score = F.round(F.least(F.greatest(before, F.lit(0.0)), F.lit(100.0)), 4)
    p = lambda k: F.col(f"__{k}")
    told = F.array(
        F.format_string("Strength gives %.2f points: it is %.2f on average.", p("evidence_strength_score"), F.col("__strength")),
        F.format_string("Severity gives %.2f points, by the most severe evidence.", p("severity_score")),
        F.format_string("Diversity gives %.2f points for %d kinds of pattern.", p("typology_diversity_score"), kinds),
        F.format_string("Repetition gives %.2f points for %d pieces of evidence.", p("repeated_evidence_score"), F.size(e)),
        F.format_string("Magnitude gives %.2f points for %d transactions of %.2f in all.", p("activity_magnitude_score"), n, amount),
    )
    none = F.array(F.lit("There is no evidence, so the score is zero."))
    told = F.when(some, told).otherwise(none)
    breakdown = F.struct(*(p(k).alias(k) for k in parts), F.round(before, 4).alias("total_before_clamp"), score.alias("total_after_clamp"), told.alias("component_reasons"))
    names = [c for c in assessments.columns if c not in ("risk_score", "risk_level", "score_breakdown", "reasons")]
    return a.select(*names, score.alias("risk_score"), level(score, config).alias("risk_level"), breakdown.alias("score_breakdown"), F.concat("reasons", told).alias("reasons"))
