"""Made-up evidence of every typology, for demonstrations without data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlattice.functions.materialise import written
from flowlattice.plans.assessment import aggregate, scored
from flowlattice.plans.evidence import ASSESSMENT_TYPE, EVIDENCE
from flowlattice.plans.report import reports

ACCOUNT = "DEMO-ACCOUNT-1"
START = datetime(2024, 3, 1, 9)
#: typology, detector, counterparties, transactions, amount, strength, severity, hours after START
ROWS = (
    ("FAN-OUT", "fan_out_detector", 6, 7, 42_000.0, 0.9, "high", 0),
    ("FAN-IN", "fan_in_detector", 5, 5, 30_500.0, 0.8, "medium", 5),
    ("CYCLE", "cycle_detector", 4, 4, 18_000.0, 0.95, "high", 9),
    ("GATHER-SCATTER", "gather_scatter_detector", 5, 8, 51_250.0, 0.85, "medium", 14),
    ("SCATTER-GATHER", "scatter_gather_detector", 3, 4, 22_000.0, 0.7, "low", 20),
    ("VELOCITY", "velocity_detector", 0, 31, 64_000.0, 0.75, "medium", None),
)


def demo_evidence(spark: SparkSession, typologies: Sequence[str] | None = None, accounts: DataFrame | None = None) -> DataFrame:
    """Of ACCOUNT, or of every account of ``accounts`` (primary_account_id)."""
    rows = []
    for kind, detector, parties, n, amount, strength, severity, hours in ROWS:
        if typologies is not None and kind not in typologies:
            continue
        start = None if hours is None else START + timedelta(hours=hours)
        refs = [] if hours is None else [f"{kind}-{i}" for i in range(n)]
        rows.append((detector, kind, ACCOUNT, [f"DEMO-PARTY-{i}" for i in range(parties)] or [ACCOUNT], [], start, start and start + timedelta(hours=3), n, amount, strength, severity, [f"A made-up example of {kind}."], {"example": 1.0}, refs, None, ASSESSMENT_TYPE))
    own = spark.createDataFrame(rows, EVIDENCE)
    if accounts is None:
        return own
    nth = own.drop("primary_account_id").withColumn("nth", F.row_number().over(Window.orderBy("detector_name")))  # a row a typology
    each = accounts.select("primary_account_id", F.explode(F.sequence(F.lit(1), F.lit(len(rows)))).alias("nth"))
    return each.join(F.broadcast(nth), "nth").select(*EVIDENCE.names)


def demo_bundle(spark: SparkSession, typologies: Sequence[str] | None = None, generated_at: datetime | None = None, accounts: DataFrame | None = None) -> dict[str, DataFrame]:
    """evidence, assessments and reports of the demonstration."""
    e = demo_evidence(spark, typologies, accounts)
    a = scored(aggregate(e))
    a = a if accounts is None else written(a, "assessments")  # of any number of accounts, and read by the reports too
    return {"evidence": e, "assessments": a, "reports": reports(a, generated_at or START)}
