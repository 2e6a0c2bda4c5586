"""Reports: an analyst's view of each scored assessment, as columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import iso, time_range

#: Most summaries, accounts of a summary, reasons of a summary, and findings.
SUMMARIES, ACCOUNTS, REASONS, FINDINGS = 8, 8, 3, 8
ACTIONS = {
    "CRITICAL": ["Have an analyst look at the account at once.", "Look into linked accounts and entities.", "Secure the evidence in its order of time.", "Escalate as the institution's rules demand.", "Check whether the case must be reported to the authorities."],
    "HIGH": ["Have an analyst look at the account soon.", "Look at its counterparties and linked accounts.", "Compare the course of events with what the customer is expected to do.", "Consider escalating within the institution."],
    "MEDIUM": ["Go through the account's latest activity.", "Check what is known of customer and account.", "Consider closer monitoring."],
    "LOW": ["Put the assessment on file.", "Go on with the usual monitoring."],
}
LIMITATIONS = ["Evidence and score come from fixed rules.", "Only the given transactions and account data are taken into account.", "A score proves no unlawful act.", "Nothing else that is known of the customer is used unless it was given."]
DISCLAIMER = "This report points out patterns that people should review. It finds nobody guilty of anything; decisions are for qualified reviewers under the rules that apply."


def report_id() -> Column:
    parts = F.concat_ws("::", F.col("primary_account_id"), F.coalesce(iso(F.col("assessment_start_time")), F.lit("")), F.coalesce(iso(F.col("assessment_end_time")), F.lit("")), F.format_string("%.4f", "risk_score"), F.array_join(F.array_sort("typologies_detected"), "|"))
    return F.concat(F.lit("IR-"), F.col("primary_account_id"), F.lit("-"), F.upper(F.substring(F.sha1(parts.cast("binary")), 1, 10)))


def findings() -> Column:
    has = lambda *names: F.arrays_overlap("typologies_detected", F.array(*map(F.lit, names)))
    rules = [
        (F.size("typologies_detected") > 1, "Several kinds of pattern were found independently."),
        (F.exists("contributing_evidence", lambda x: x["evidence_strength"] >= 0.8), "One detector at least is sure of its evidence."),
        (F.col("evidence_count") > 1, "The assessment rests on more than one piece of evidence."),
        (has("VELOCITY"), "Transactions followed each other unusually fast."),
        (has("CYCLE"), "Money went round in a circle."),
        (has("FAN-OUT", "FAN-IN"), "Many counterparties meet in the account."),
        (has("GATHER-SCATTER"), "Money was gathered and then scattered."),
        (has("SCATTER-GATHER"), "Money was scattered and then gathered."),
        ((F.size("contributing_evidence") > 0) & (F.col("assessment_start_time").isNotNull() | F.col("assessment_end_time").isNotNull()), "The activity falls into a limited span of time."),
    ]
    return F.slice(F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in rules)), lambda x: x.isNotNull()), 1, FINDINGS)


def summaries() -> Column:
    key = lambda x: F.struct((-x["evidence_strength"]).alias("a"), x["detector_name"].alias("b"), x["typology"].alias("c"), F.coalesce(iso(x["start_time"]), F.lit("")).alias("d"), F.coalesce(iso(x["end_time"]), F.lit("")).alias("e"), x.alias("x"))
    top = F.slice(F.array_sort(F.transform("contributing_evidence", key)), 1, SUMMARIES)
    one = lambda x: F.struct(
        x["detector_name"].alias("detector"), x["typology"].alias("typology"), x["severity"].alias("severity"), x["evidence_strength"].alias("evidence_strength"), time_range(x["start_time"], x["end_time"]).alias("time_window"),
        x["transaction_count"].alias("transaction_count"), x["total_amount"].alias("amount"), F.slice(x["involved_account_ids"], 1, ACCOUNTS).alias("involved_accounts"), F.slice(x["reasons"], 1, REASONS).alias("reasons"),
    )
    return F.transform(top, lambda k: one(k["x"]))


def timeline() -> Column:
    least = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    entry = lambda x: F.struct(
        F.coalesce(x["start_time"], least).alias("a"), F.coalesce(x["end_time"], least).alias("b"), x["typology"].alias("typology"), x["detector_name"].alias("detector"), x["start_time"].alias("timestamp"), x["end_time"].alias("end_time"),
        F.coalesce(F.get(x["reasons"], F.lit(0)), F.concat(x["detector_name"], F.lit(" found "), x["typology"], F.lit("."))).alias("short_description"), x["transaction_count"].alias("transaction_count"), x["total_amount"].alias("amount"),
    )
    return F.transform(F.array_sort(F.transform("contributing_evidence", entry)), lambda e: e.dropFields("a", "b"))


def reports(scored: DataFrame, generated_at: datetime | None = None) -> DataFrame:
    """One report an assessment; its id depends on the assessment alone, not on when it is written."""
    tail = F.when(F.col("risk_score") >= 75, "An analyst should see it at once.").when(F.col("risk_score") >= 50, "An analyst should see it soon.").when(F.col("risk_score") >= 25, "It should be reviewed and watched.").otherwise("It should be put on file and watched as usual.")
    kinds = F.when(F.size("typologies_detected") > 0, F.array_join("typologies_detected", ", ")).otherwise("no particular pattern")
    summary = F.concat(F.lit("Account "), F.col("primary_account_id"), F.lit(" is at risk level "), F.col("risk_level"), F.format_string(" with a score of %.1f, from %d pieces of evidence of ", "risk_score", "evidence_count"), kinds, F.lit(". "), tail)
    texts = lambda xs: F.array(*map(F.lit, xs))
    actions = F.when(F.col("risk_level") == "CRITICAL", texts(ACTIONS["CRITICAL"])).when(F.col("risk_level") == "HIGH", texts(ACTIONS["HIGH"])).when(F.col("risk_level") == "MEDIUM", texts(ACTIONS["MEDIUM"])).otherwise(texts(ACTIONS["LOW"]))
    return scored.select(
        "primary_account_id", report_id().alias("report_id"), (F.lit(generated_at) if generated_at else F.current_timestamp()).cast("timestamp_ntz").alias("generated_at"), "risk_score", "risk_level", summary.alias("executive_summary"),
        "typologies_detected", "detector_names", "evidence_count", "involved_account_ids", "entity_ids", "assessment_start_time", "assessment_end_time",
        F.col("total_suspicious_transactions").alias("suspicious_transaction_count"), F.col("total_suspicious_amount").alias("suspicious_amount"),
        findings().alias("key_findings"), summaries().alias("evidence_summary"), timeline().alias("timeline"), F.col("score_breakdown.component_reasons").alias("score_explanation"),
        actions.alias("recommended_actions"), texts(LIMITATIONS).alias("limitations"), F.lit(DISCLAIMER).alias("compliance_disclaimer"),
        F.struct(F.col("metadata.*"), F.lit("injected" if generated_at else "runtime").alias("generated_at_source")).alias("metadata"),
    )
