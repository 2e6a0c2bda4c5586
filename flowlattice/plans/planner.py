"""From a Request to the steps that answer it: no more than it needs."""

from __future__ import annotations

from flowlattice.plans.query_model import Intent, Plan, Request, Step

_BROAD = "dataset_profiler eda feature_engineering structuring_detector smurfing_detector velocity_detector behavior_deviation_detector anomaly_detector risk_scoring explanation"
#: The tools of each intent's plan, in order.
STEPS = {
    Intent.broad_analysis: _BROAD,
    Intent.suspicious_activity_search: _BROAD,
    Intent.structuring_detection: "transaction_filter feature_engineering structuring_detector risk_scoring explanation",
    Intent.smurfing_detection: "feature_engineering smurfing_detector risk_scoring explanation",
    Intent.threshold_analysis: "transaction_filter aggregation threshold_rule",
    Intent.customer_investigation: "customer_lookup feature_engineering behavior_deviation_detector anomaly_detector risk_scoring explanation",
    Intent.risk_explanation: "customer_lookup risk_lookup explanation",
    Intent.high_risk_search: "feature_engineering risk_lookup result_filtering",
    Intent.velocity_analysis: "feature_engineering velocity_detector risk_scoring explanation",
    Intent.fan_out_detection: "fan_out_detector",
    Intent.fan_in_detection: "fan_in_detector",
    Intent.cycle_detection: "cycle_detector",
    Intent.gather_scatter_detection: "gather_scatter_detector",
    Intent.scatter_gather_detection: "scatter_gather_detector",
    Intent.eda_request: "dataset_profiler eda",
}
#: Intents whose steps cover everything or have a scope of their own, rather than the request's constraints.
SCOPES = {
    Intent.broad_analysis: "entire_dataset", Intent.suspicious_activity_search: "entire_dataset", Intent.eda_request: "entire_dataset", Intent.high_risk_search: "high_risk_search",
}
#: What each tool is for.
PURPOSES = {
    "dataset_profiler": "shape and quality of the data", "eda": "what the data looks like", "transaction_filter": "the transactions that the constraints leave", "aggregation": "totals by customer",
    "threshold_rule": "customers beyond a threshold", "customer_lookup": "one customer's records", "feature_engineering": "account features", "structuring_detector": "amounts kept below a limit",
    "smurfing_detector": "sums split over many hands", "velocity_detector": "unusually quick transactions", "fan_out_detector": "one account that pays many", "fan_in_detector": "one account that many pay",
    "cycle_detector": "money that returns", "gather_scatter_detector": "gathering, then scattering", "scatter_gather_detector": "scattering, then gathering", "behavior_deviation_detector": "changes of habit",
    "anomaly_detector": "outliers", "risk_scoring": "one score from all signals", "explanation": "why an account was found", "risk_lookup": "evidence on file", "result_filtering": "the part of the result that was asked for",
    "evidence_aggregator": "evidence by account", "risk_scorer": "a score for each assessment", "investigation_report": "a report on each assessment",
}
#: Tools a plan may leave out; detectors on graphs and the tools that sum up evidence are never listed as left out of broad plans.
OPTIONAL = ("dataset_profiler", "eda", "transaction_filter", "aggregation", "threshold_rule", "customer_lookup", "feature_engineering", "structuring_detector", "smurfing_detector", "velocity_detector", "behavior_deviation_detector", "anomaly_detector", "risk_scoring", "explanation", "risk_lookup", "result_filtering")


def plan(request: Request, assess: bool = False) -> Plan:
    """The steps for a request.  With ``assess``, detectors are followed by aggregation, scoring and reports."""
    names = STEPS[request.intent].split()
    if assess and any(n.endswith("_detector") for n in names):
        names += [n for n in ("evidence_aggregator", "risk_scorer", "investigation_report")]
    scope = SCOPES.get(request.intent)
    steps = []
    for i, name in enumerate(names):
        parameters = {"scope": scope} if scope else request.constraints()
        if name == "transaction_filter" and request.date_range and request.date_range.relative_days:
            parameters["relative_days"] = request.date_range.relative_days
        steps.append(Step(i + 1, name, PURPOSES[name][:1].upper() + PURPOSES[name][1:] + ".", parameters=parameters, dependencies=tuple(names[:i])))
    skipped = tuple(n for n in OPTIONAL if n not in names)
    return Plan(request.intent, tuple(steps), skipped, f"{request.intent.value}: {', '.join(names)}.")
