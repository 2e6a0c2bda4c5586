"""Flat tables of assessments and reports, as a dashboard shows them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import time_range
from flowlattice.plans.parser import parse
from flowlattice.plans.planner import plan
from flowlattice.plans.report import ACCOUNTS, REASONS

#: The parts of a score and what they are called.
PARTS = (
    ("evidence_strength_score", "Evidence strength"), ("severity_score", "Severity"), ("typology_diversity_score", "Typology diversity"),
    ("repeated_evidence_score", "Repeated evidence"), ("activity_magnitude_score", "Activity magnitude"),
)


def breakdown_rows(scored: DataFrame) -> DataFrame:
    """primary_account_id, component, points: five rows an assessment."""
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("component"), F.col(f"score_breakdown.{c}").alias("points")) for i, (c, name) in enumerate(PARTS)))
    return scored.select("primary_account_id", F.inline(parts)).select("primary_account_id", "component", "points")


def evidence_rows(assessments: DataFrame) -> DataFrame:
    """A row for each piece of evidence, the strongest first (``step``)."""
    rows = assessments.select("primary_account_id", F.explode("contributing_evidence").alias("e"))
    return rows.select(
        "primary_account_id", F.col("e.detector_name").alias("detector"), F.col("e.typology").alias("typology"), F.upper("e.severity").alias("severity"), F.round("e.evidence_strength", 3).alias("evidence_strength"),
        time_range(F.col("e.start_time"), F.col("e.end_time")).alias("time_range"), F.col("e.transaction_count").alias("transactions"), F.col("e.total_amount").alias("amount"),
        F.array_join(F.slice("e.involved_account_ids", 1, ACCOUNTS), ", ").alias("involved_accounts"), F.array_join(F.slice("e.reasons", 1, REASONS), " | ").alias("reasons"),
    ).orderBy("primary_account_id", F.desc("evidence_strength"), "detector", "typology", "time_range")


def timeline_rows(reports: DataFrame) -> DataFrame:
    """A row for each entry of the reports' timelines, in order (``step``)."""
    rows = reports.select("primary_account_id", F.posexplode("timeline").alias("step", "e"))
    return rows.select("primary_account_id", (F.col("step") + 1).alias("step"), "e.timestamp", "e.end_time", "e.typology", "e.detector", "e.transaction_count", "e.amount", F.col("e.short_description").alias("description"))


def preview(df: DataFrame, rows: int = 5) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.limit(rows).collect()]


def metric(value: Any) -> str:
    """A number for display: one place for fractions, N/A for nothing."""
    return "N/A" if value is None else f"{value:.1f}" if isinstance(value, float) else str(value)


def shown(x: Column, fraction: bool = False) -> Column:
    """metric() of a column: whole numbers as they are, fractions with one place, N/A for nothing."""
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("%.1f", x.cast("double")) if fraction else x.cast("string"))


def understood(query: str) -> dict[str, Any]:
    """How a question is read and what it would run, without data."""
    r = parse(query)
    p = plan(r)
    return {"query": r.raw_query, "intent": r.intent.value, "pattern": r.pattern.value if r.pattern else None, "requested_output": r.requested_output.value, "tool_names": [s.tool_name for s in p.steps], "summary": p.summary}
