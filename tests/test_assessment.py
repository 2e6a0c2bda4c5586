from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowlattice.plans.assessment import aggregate, level, scored
from flowlattice.plans.evidence import EVIDENCE, violations
from flowlattice.plans.investigate import detect, investigation
from flowlattice.plans.queries import queries
from flowlattice.plans.report import ACTIONS, DISCLAIMER, reports
from flowlattice.sources.demo import ACCOUNT, ROWS, demo_bundle, demo_evidence

T = datetime(2024, 1, 1)


@pytest.fixture
def ev(spark):
    def make(*rows):
        base = {f.name: None for f in EVIDENCE} | dict(detector_name="d", typology="CYCLE", primary_account_id="A", involved_account_ids=["B"], entity_ids=[], start_time=T, end_time=T + timedelta(minutes=30), transaction_count=4, total_amount=1000.0, evidence_strength=1.0, severity="low", reasons=["r"], detector_parameters={"k": 1.0}, transaction_references=[], metadata="{}", assessment_type="suspicious_pattern")
        return spark.createDataFrame([tuple((base | r).values()) for r in rows], EVIDENCE)

    return make


def one(df):
    (r,) = df.collect()
    return r


def test_repeats_count_once_but_metadata_is_ignored(ev):
    a = one(aggregate(ev({}, {"metadata": '{"x":1}'}, {"involved_account_ids": ["B"]})))
    assert (a.evidence_count, a.metadata.raw_evidence_count, a.total_suspicious_transactions) == (1, 3, 4)


def test_references_are_apportioned_in_order(ev):
    a = one(aggregate(ev({"detector_name": "a", "transaction_references": ["1", "2", "3", "4"]}, {"detector_name": "b", "transaction_references": ["3", "4", "5", "6", ""]}, {"detector_name": "c", "transaction_references": ["1", "2"]}, {"detector_name": "e", "transaction_count": 1, "total_amount": 7.0})))
    assert a.total_suspicious_transactions == 7 and a.total_suspicious_amount == pytest.approx(1000 + 500 + 0 + 7)
    assert a.metadata.unique_transaction_references == ["1", "2", "3", "4", "5", "6"]
    assert a.detector_names == ["a", "b", "c", "e"] and a.involved_account_ids == ["A", "B"]


def test_counts_round_half_to_even(ev):
    a = one(aggregate(ev({"detector_name": "a", "transaction_count": 0, "transaction_references": ["1"]}, {"detector_name": "b", "transaction_count": 5, "transaction_references": ["1", "2"]})))
    assert a.total_suspicious_transactions == 2


def test_times_ignore_nulls_and_accounts_stay_apart(ev):
    rows = aggregate(ev({"start_time": None, "end_time": None, "detector_name": "v"}, {}, {"primary_account_id": "Z", "start_time": None, "end_time": None})).orderBy("primary_account_id").collect()
    assert rows[0].assessment_start_time == T and rows[1].assessment_start_time is None


def test_score_of_one_piece(ev):
    a = one(scored(aggregate(ev({"severity": "high"}))))
    b = a.score_breakdown
    assert (b.evidence_strength_score, b.severity_score, b.typology_diversity_score, b.repeated_evidence_score) == (32.0, 16.0, 4.0, 0.0)
    assert b.activity_magnitude_score == pytest.approx(8 * 1.6094379 / 3.2580965 + 8 * 0.0953102 / 4.6151205, abs=1e-3)
    assert a.risk_score == b.total_after_clamp and a.risk_level == "HIGH" and len(b.component_reasons) == 5


def test_score_never_passes_its_ceiling(ev):
    many = [{"detector_name": f"d{i}", "typology": f"T{i}", "severity": "high", "transaction_count": 900, "total_amount": 1e9} for i in range(9)]
    a = one(scored(aggregate(ev(*many))))
    assert a.risk_score == 96.0 and a.risk_level == "CRITICAL"


def test_no_evidence_scores_zero(spark, ev):
    a = aggregate(ev({})).withColumn("contributing_evidence", F.slice("contributing_evidence", 1, 0))
    r = one(scored(a))
    assert (r.risk_score, r.risk_level) == (0.0, "LOW")


def test_levels(spark):
    got = spark.createDataFrame([(x,) for x in (24.9999, 25.0, 49.9999, 50.0, 74.9999, 75.0)], "x double").select(level(F.col("x")).alias("l")).collect()
    assert [r.l for r in got] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_evidence_rules(ev):
    bad = ev({"detector_name": " "}, {"transaction_count": -1}, {"total_amount": -1.0}, {"evidence_strength": 1.5}, {"severity": "odd"}, {})
    assert sorted(r.rule for r in violations(bad).collect()) == ["empty id", "negative amount", "negative count", "severity", "strength"]


def test_report(ev):
    s = scored(aggregate(ev({"detector_name": "a", "typology": "FAN-OUT"}, {"detector_name": "v", "typology": "VELOCITY", "start_time": None, "end_time": None, "reasons": []}, *({"detector_name": f"x{i}", "evidence_strength": 0.1} for i in range(9)))))
    r, later = one(reports(s, T)), one(reports(s, T + timedelta(days=1)))
    assert r.report_id == later.report_id and r.report_id.startswith("IR-A-") and len(r.report_id) == 15
    assert len(r.evidence_summary) == 8 and [e.detector for e in r.evidence_summary[:2]] == ["a", "v"]
    assert len(r.timeline) == 11 and r.timeline[0].detector == "v" and r.timeline[0].short_description == "v found VELOCITY."
    assert r.recommended_actions == ACTIONS[r.risk_level] and r.compliance_disclaimer == DISCLAIMER and len(r.limitations) == 4
    assert len(r.key_findings) <= 8 and len(r.score_explanation) == 5 and r.metadata.generated_at_source == "injected"
    assert r.evidence_summary[1].time_window == "not available"


def test_demo(spark):
    d = demo_bundle(spark)
    r = one(d["reports"])
    assert r.primary_account_id == ACCOUNT and r.evidence_count == len(ROWS) and r.risk_level == "CRITICAL"
    assert demo_evidence(spark, ["CYCLE"]).count() == 1 and demo_evidence(spark, []).count() == 0
    assert one(demo_bundle(spark)["reports"]) == r


def test_investigation_sees_beyond_its_own_edges(tx):
    ring = [(0, "A", "B"), (10, "B", "C"), (20, "C", "D"), (30, "D", "A"), (40, "Q", "R")]
    r = one(investigation(tx(*ring), "A", generated_at=T))
    assert r.typologies_detected == ["CYCLE"]
    assert investigation(tx(*ring), "A", hops=1).count() == 0 and investigation(tx(*ring), "Q").count() == 0
    assert detect(tx(*ring), typologies=[]).count() == 0


def test_evidence_of_any_number_of_accounts_is_not_sent_to_the_driver(spark):
    """Written evidence is far smaller than its rows, so its size on disk must not bring a broadcast about."""
    accounts = spark.range(40).select(F.col("id").cast("string").alias("primary_account_id"))
    b = demo_bundle(spark, accounts=accounts)
    for df in (aggregate(b["evidence"]), b["assessments"], queries()["demo_bundle"](spark, "/root/testdata/sf0.001")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert b["reports"].count() == 40
