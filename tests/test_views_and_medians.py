import random
import statistics

import pytest

from flowlattice.operators.features import FeatureConfig, features
from flowlattice.operators.streaming_median import p_square_median
from flowlattice.plans.evidence import from_dicts, without_label_keys
from flowlattice.plans.query_model import Context
from flowlattice.plans.tools import default_registry
from flowlattice.plans.views import breakdown_rows, evidence_rows, metric, preview, timeline_rows, understood
from flowlattice.sources.demo import ROWS, demo_bundle


def test_p_square_is_exact_for_few_and_close_for_many():
    assert p_square_median([]) != p_square_median([]) and p_square_median([3.0]) == 3.0 and p_square_median([4, 1]) == 2.5
    assert p_square_median([5, 1, float("nan"), 3, 2, 4]) == 3.0
    r = random.Random(1)
    for draw in (lambda: r.gauss(100, 10), lambda: r.expovariate(0.1), lambda: float(r.randrange(5))):
        values = [draw() for _ in range(4000)]
        assert p_square_median(values) == pytest.approx(statistics.median(values), rel=0.06, abs=0.6)


def test_streaming_medians_in_features(tx):
    rows = tx(*[(i, "A", "B", i * i % 17) for i in range(4)])
    got = {r.account_id: r for r in features(rows, config=FeatureConfig(median="streaming")).collect()}
    want = {r.account_id: r for r in features(rows).collect()}
    assert got["A"].median_outgoing_amount == want["A"].median_outgoing_amount and got["B"].median_incoming_amount == want["B"].median_incoming_amount


def test_views(spark):
    d = demo_bundle(spark)
    assert [r.component for r in breakdown_rows(d["assessments"]).collect()] == ["Evidence strength", "Severity", "Typology diversity", "Repeated evidence", "Activity magnitude"]
    e = evidence_rows(d["assessments"]).collect()
    assert len(e) == len(ROWS) and e[0].evidence_strength == 0.95 and e[0].severity == "HIGH"
    t = timeline_rows(d["reports"]).collect()
    assert [r.step for r in t] == list(range(1, 7)) and t[0].timestamp is None
    assert len(preview(d["evidence"], 2)) == 2
    assert (metric(None), metric(2.345), metric(7)) == ("N/A", "2.3", "7")
    assert understood("velocity")["tool_names"][1] == "velocity_detector"


def test_dicts_become_evidence(spark):
    assert without_label_keys({"b": [{"is_laundering": 1, "x": 2}], "a": {"expected_typology": 3}}) == {"a": {}, "b": [{"x": 2}]}
    good = {"detector_name": "d", "typology": "fan out", "primary_account_id": "A", "entity_ids": ["", "E"], "metadata": {"Is Laundering": 1, "k": 2}, "transaction_count": 2, "total_amount": 5}
    r = from_dicts(spark, [good]).first()
    assert (r.typology, r.entity_ids, r.metadata, r.severity) == ("FAN-OUT", ["E"], '{"k": 2}', "low")
    for bad in ({"severity": "odd"}, {"evidence_strength": 2.0}, {"total_amount": -1}, {"primary_account_id": ""}, {"more": 1}):
        with pytest.raises(ValueError):
            from_dicts(spark, [good | bad])
    scored = default_registry().get("risk_scorer").execute(Context(), {"evidence": [good]}).data["scored"].first()
    assert scored.risk_level == "LOW" and scored.evidence_count == 1
    with pytest.raises(ValueError):
        default_registry().get("investigation_report").execute(Context())
