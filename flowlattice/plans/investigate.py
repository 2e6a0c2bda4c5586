"""An account's investigation: its neighbourhood, all detectors, assessment and report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.materialise import written
from flowlattice.operators.cycle import cycles
from flowlattice.operators.fan import fan_in, fan_out
from flowlattice.operators.gather_scatter import gather_scatter
from flowlattice.operators.scatter_gather import scatter_gather
from flowlattice.operators.velocity import velocity
from flowlattice.plans.assessment import aggregate, scored
from flowlattice.plans.evidence import empty, union
from flowlattice.plans.report import reports

#: The thresholds of an investigation, which differ from the detectors' own.
DETECTORS = {
    "FAN-OUT": lambda tx: fan_out(tx, 4, 24, 4),
    "FAN-IN": lambda tx: fan_in(tx, 4, 24, 4),
    "CYCLE": lambda tx: cycles(tx, 4, 6, 24),
    "GATHER-SCATTER": lambda tx: gather_scatter(tx, 3, 1, 24),
    "SCATTER-GATHER": lambda tx: scatter_gather(tx, 2, 24),
}
#: The detectors' own thresholds.
DEFAULTS = {"FAN-OUT": fan_out, "FAN-IN": fan_in, "CYCLE": cycles, "GATHER-SCATTER": gather_scatter, "SCATTER-GATHER": scatter_gather}


def detect(tx: DataFrame, features: DataFrame | None = None, typologies: Sequence[str] | None = None, detectors=None) -> DataFrame:
    """Evidence of all chosen detectors; velocity needs features."""
    detectors = detectors or DEFAULTS
    chosen = [t for t in detectors if typologies is None or t in typologies]
    parts = [detectors[t](tx) for t in chosen]
    if features is not None and (typologies is None or "VELOCITY" in typologies):
        parts.append(velocity(features))
    return union(*parts) if parts else empty(tx.sparkSession)


def neighbourhood(tx: DataFrame, account_id: str, hops: int = 1) -> DataFrame:
    """The transactions that touch an account, or, with more hops, accounts that so many steps lead to.

    One hop is what an account itself took part in; no cycle of three accounts or scatter-gather fits into that, so
    investigations take more.
    """
    near = tx.sparkSession.createDataFrame([(str(account_id),)], "account_id string")
    for _ in range(hops - 1):
        out = tx.join(near, tx["sender_account"] == near["account_id"], "left_semi").select(F.col("receiver_account").alias("account_id"))
        back = tx.join(near, tx["receiver_account"] == near["account_id"], "left_semi").select(F.col("sender_account").alias("account_id"))
        near = written(near.unionByName(out).unionByName(back).distinct(), "near")
    sent = tx.join(near, tx["sender_account"] == near["account_id"], "left_semi")
    rest = tx.join(near, tx["sender_account"] == near["account_id"], "left_anti")
    return sent.unionByName(rest.join(near, rest["receiver_account"] == near["account_id"], "left_semi"))


def investigation(tx: DataFrame, account_id: str, typologies: Sequence[str] | None = None, features: DataFrame | None = None, hops: int = 3, generated_at: datetime | None = None) -> DataFrame:
    """The account's report: one row, or none without evidence."""
    own = None if features is None else features.where(F.col("account_id") == str(account_id))
    found = detect(written(neighbourhood(tx, account_id, hops), "neighbourhood"), own, typologies, DETECTORS)
    return reports(scored(aggregate(found.where(F.col("primary_account_id") == str(account_id)))), generated_at)
