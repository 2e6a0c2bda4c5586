from datetime import date

import pytest

from flowlattice.plans.orchestrator import Orchestrator, final_status
from flowlattice.plans.parser import parse
from flowlattice.plans.planner import STEPS, plan
from flowlattice.plans.query_model import Context, DateRange, Intent, Output, Pattern, Plan, Status, Step, Threshold, TraceEntry
from flowlattice.plans.tools import PLACEHOLDERS, FunctionTool, Placeholder, Registry, ToolInfo, default_registry
from flowlattice.streaming.alerts import fan_out_alerts

TODAY = date(2024, 6, 30)


@pytest.mark.parametrize(
    ("query", "intent", "output"),
    [
        ("Why is CUST_9 high risk?", Intent.risk_explanation, Output.explanation),
        ("Is customer CUST_1 fine?", Intent.customer_investigation, Output.case_file),
        ("Show high-risk customers", Intent.high_risk_search, Output.customer_list),
        ("Find fan out accounts", Intent.fan_out_detection, Output.pattern_summary),
        ("Who is receiving money from many different accounts", Intent.fan_in_detection, Output.pattern_summary),
        ("circular flows", Intent.cycle_detection, Output.pattern_summary),
        ("gather-scatter please", Intent.gather_scatter_detection, Output.pattern_summary),
        ("scatter gather please", Intent.scatter_gather_detection, Output.pattern_summary),
        ("velocity of transfers", Intent.velocity_analysis, Output.pattern_summary),
        ("structuring in the last 30 days", Intent.structuring_detection, Output.pattern_summary),
        ("smurfing", Intent.smurfing_detection, Output.pattern_summary),
        ("run eda", Intent.eda_request, Output.eda_summary),
        ("suspicious activity anywhere", Intent.suspicious_activity_search, Output.investigation_summary),
        ("customers with 10 or more transactions under $9,500.50", Intent.threshold_analysis, Output.customer_list),
        ("Analyse this dataset", Intent.broad_analysis, Output.investigation_summary),
        ("hello", Intent.broad_analysis, Output.summary),
    ],
)
def test_intents(query, intent, output):
    r = parse(query, TODAY)
    assert (r.intent, r.requested_output) == (intent, output)
    assert plan(r).steps and [s.tool_name for s in plan(r).steps] == STEPS[intent].split()


def test_constraints():
    r = parse("  customers  cust_12 in DE with 10 or more transactions under $9,500.50 by wire in the last 30 days ", TODAY)
    assert r.customer_id == "CUST_12" and r.country == "DE" and r.transaction_type == "wire"
    assert r.date_range == DateRange(date(2024, 5, 31), TODAY, 30)
    assert r.amount_threshold == Threshold("<", 9500.5, currency="USD") and r.transaction_count_threshold == Threshold(">=", 10.0)
    assert r.raw_query.startswith("customers cust_12") and "date_range" in r.constraints()


def test_more_than_also_sets_an_amount():
    r = parse("more than 10 transactions", TODAY)
    assert r.transaction_count_threshold.operator == ">" and r.amount_threshold == Threshold(">=", 10.0, currency="USD")


def test_patterns_and_limits():
    assert parse("odd behaviour", TODAY).pattern == Pattern.behavior_deviation
    assert parse("suspicious activity", TODAY).pattern == Pattern.suspicious_activity
    with pytest.raises(ValueError):
        parse("last 0 days", TODAY)
    with pytest.raises(ValueError):
        Threshold("~", 1.0)


def test_filter_step_knows_the_days():
    steps = plan(parse("structuring in the last 7 days", TODAY)).steps
    assert steps[0].parameters["relative_days"] == 7 and steps[1].dependencies == ("transaction_filter",)
    broad = plan(parse("hello", TODAY))
    assert all(s.parameters == {"scope": "entire_dataset"} for s in broad.steps) and "transaction_filter" in broad.skipped_tools


def test_registry():
    r = default_registry()
    names = [i.name for i in r.list()]
    assert names == sorted(names) and len(names) == 24 and sum(not i.implemented for i in r.list()) == len(PLACEHOLDERS) == 14
    with pytest.raises(ValueError):
        r.register(Placeholder("eda"))
    r.register(Placeholder("eda"), replace=True)
    with pytest.raises(KeyError):
        r.get("nothing")
    assert r.exists("eda") and not r.exists("nothing")


class Fails:
    info = ToolInfo("bad", "", True)

    def execute(self, context, parameters=None):
        raise RuntimeError("boom")


def tool(name, data):
    t = FunctionTool("eda", lambda c, p: data)
    t.info = ToolInfo(name, "", True)
    return t


def test_failure_blocks_required_steps_only():
    o = Orchestrator(Registry([tool("one", {"a": 1}), Fails(), tool("two", {"b": 2}), tool("three", {"c": 3})]))
    p = Plan(Intent.eda_request, (Step(2, "unknown"), Step(1, "one"), Step(3, "bad"), Step(4, "two"), Step(5, "three", required=False)))
    out = o.execute(p, Context())
    assert [(t.tool_name, t.status) for t in out.trace] == [("one", Status.SUCCESS), ("unknown", Status.NOT_IMPLEMENTED), ("bad", Status.FAILED), ("two", Status.SKIPPED), ("three", Status.SUCCESS)]
    assert "boom" in out.trace[2].error and out.status == Status.FAILED and out.results == {"one": {"a": 1}, "three": {"c": 3}}


def test_final_status_order():
    t = lambda s: TraceEntry(1, "x", s, "")
    assert final_status([t(Status.SUCCESS)]) == Status.SUCCESS
    assert final_status([t(Status.SKIPPED), t(Status.NOT_IMPLEMENTED)]) == Status.NOT_IMPLEMENTED
    assert final_status([t(Status.SKIPPED), t(Status.SUCCESS)]) == Status.SKIPPED


def test_a_question_runs_to_a_report(tx):
    rows = tx(*[(i, "A", f"B{i}") for i in range(6)], *[(i, "Q", f"B{i}", 1) for i in range(6)])
    out = Orchestrator().run("fan-out over $50", Context(transactions=rows), assess=True)
    assert out.status == Status.SUCCESS and [r.primary_account_id for r in out.results["investigation_report"]["reports"].collect()] == ["A"]
    early = Orchestrator().run("fan-out in the last 5 days", Context(transactions=rows), today=TODAY)
    assert early.results["fan_out_detector"]["evidence"].count() == 0


def test_velocity_takes_the_features_of_an_earlier_step(tx):
    rows = tx(*[(i, "A", "B") for i in range(12)])
    out = Orchestrator().run("velocity", Context(transactions=rows), assess=True)
    assert {r.primary_account_id for r in out.results["velocity_detector"]["evidence"].collect()} == {"A", "B"}
    assert out.status == Status.NOT_IMPLEMENTED  # risk_scoring and explanation are known by name only
    assert Orchestrator().run("fan-out", Context()).status == Status.FAILED


def test_streamed_alerts(spark, tx, tmp_path):
    tx(*[(i, "A", f"B{i}") for i in range(6)], (5000, "Z", "Y")).write.parquet(str(tmp_path / "in"))
    stream = fan_out_alerts(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")), slide="24 hours")
    q = stream.writeStream.outputMode("append").format("memory").queryName("alerts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.table("alerts").collect()
    assert [(r.sender_account, r.receivers, r.transactions) for r in got] == [("A", 6, 6)]
