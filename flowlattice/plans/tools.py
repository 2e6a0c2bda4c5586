"""The tools that plans name, and the registry that finds them.

A tool takes a Context and parameters and gives a ToolResult; its data holds lazy DataFrames.  A request's constraints
reach the detectors: date_range, customer_id (an account), thresholds of amount and count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.operators.cycle import cycles
from flowlattice.operators.fan import fan_in, fan_out
from flowlattice.operators.features import feature_set
from flowlattice.operators.gather_scatter import gather_scatter
from flowlattice.operators.scatter_gather import scatter_gather
from flowlattice.operators.velocity import velocity
from flowlattice.plans.assessment import aggregate, scored
from flowlattice.plans.evidence import from_dicts, union
from flowlattice.plans.planner import PURPOSES
from flowlattice.plans.query_model import Context, Status, ToolResult
from flowlattice.plans.report import reports
from flowlattice.sources.transactions import selected

#: Rows that the feature tool takes unless told otherwise.
FEATURE_ROWS = 2_000
#: Tools that are known by name and do nothing yet.
PLACEHOLDERS = (
    "dataset_profiler", "eda", "transaction_filter", "aggregation", "threshold_rule", "customer_lookup", "structuring_detector", "smurfing_detector",
    "behavior_deviation_detector", "anomaly_detector", "risk_scoring", "explanation", "risk_lookup", "result_filtering",
)


@dataclass(frozen=True)
class ToolInfo:
    name: str
    description: str
    implemented: bool


@runtime_checkable
class Tool(Protocol):
    info: ToolInfo

    def execute(self, context: Context, parameters: dict[str, Any] | None = None) -> ToolResult: ...


class Placeholder:
    def __init__(self, name: str) -> None:
        self.info = ToolInfo(name, PURPOSES[name], False)

    def execute(self, context: Context, parameters: dict[str, Any] | None = None) -> ToolResult:
        return ToolResult(Status.NOT_IMPLEMENTED, f"{self.info.name} is known by name only.")


class FunctionTool:
    """A tool made of a function of (context, parameters) that gives what to keep, by name."""

    def __init__(self, name: str, run: Callable[[Context, dict[str, Any]], dict[str, Any]]) -> None:
        self.info, self.run = ToolInfo(name, PURPOSES[name], True), run

    def execute(self, context: Context, parameters: dict[str, Any] | None = None) -> ToolResult:
        data = self.run(context, dict(parameters or {}))
        return ToolResult(Status.SUCCESS, f"{self.info.name}: {', '.join(data)}.", data)


def scoped(context: Context, p: dict[str, Any]) -> DataFrame:
    """The context's transactions under a request's constraints."""
    if context.transactions is None:
        raise ValueError("there are no transactions")
    days = p.get("date_range") or {}
    accounts = p.get("account_ids") or ([p["customer_id"]] if p.get("customer_id") else None)
    tx = selected(context.transactions, p.get("start_date") or days.get("start_date"), p.get("end_date") or days.get("end_date"), accounts, p.get("max_rows"))
    if limit := p.get("amount_threshold"):
        tx = tx.where({"<": F.col("amount_paid") < limit["value"], "<=": F.col("amount_paid") <= limit["value"], ">": F.col("amount_paid") > limit["value"], ">=": F.col("amount_paid") >= limit["value"], "=": F.col("amount_paid") == limit["value"],
                       "between": F.col("amount_paid").between(limit["value"], limit.get("upper_value") or limit["value"])}[limit["operator"]])
    if kind := p.get("transaction_type"):
        if "payment_format" in tx.columns:
            tx = tx.where(F.lower("payment_format").contains(kind))
    return tx


def _detector(detect: Callable[..., DataFrame], names: Iterable[str]) -> Callable[[Context, dict[str, Any]], dict[str, Any]]:
    known = set(names)
    return lambda context, p: {"evidence": detect(scoped(context, p), **{k: v for k, v in p.items() if k in known})}


def _features(context: Context, p: dict[str, Any]) -> dict[str, Any]:
    rows = p.pop("max_rows", FEATURE_ROWS)
    found = feature_set(scoped(context, p | {"max_rows": rows}), context.accounts, max_rows=rows)
    return {"features": found.features, "labels": found.labels, "metadata": found.metadata}


def _velocity(context: Context, p: dict[str, Any]) -> dict[str, Any]:
    """Takes an earlier step's features; without any, the store's."""
    f = context.latest("features")
    if f is None and context.store is not None and context.store.exists():
        f = context.store.load_features()
    if f is None:
        raise ValueError("velocity needs features")
    known = ("min_max_transactions_in_hour", "min_rapid_gap_count", "min_transactions_per_active_hour")
    return {"evidence": velocity(f, **{k: v for k, v in p.items() if k in known})}


def _all_evidence(context: Context, p: dict[str, Any]) -> DataFrame:
    if isinstance(p.get("evidence"), list):  # dicts
        return from_dicts(context.transactions.sparkSession if context.transactions is not None else SparkSession.active(), p["evidence"])
    parts = [p["evidence"]] if "evidence" in p else [r["evidence"] for r in context.results.values() if "evidence" in r]
    if not parts:
        raise ValueError("there is no evidence")
    return union(*parts)


def _score(context: Context, p: dict[str, Any]) -> dict[str, Any]:
    """Scores assessments; raw evidence is aggregated first."""
    a = p.get("assessments") if "assessments" in p else context.latest("assessments")
    return {"scored": scored(aggregate(_all_evidence(context, p)) if a is None else a)}


def _report(context: Context, p: dict[str, Any]) -> dict[str, Any]:
    a = p.get("scored") if "scored" in p else context.latest("scored")
    if a is None:
        raise ValueError("a report needs a scored assessment")
    return {"reports": reports(a, p.get("generated_at"))}


def default_tools() -> list[Tool]:
    # fixed values: the names of tools and of their parameters
    own = [
        FunctionTool("feature_engineering", _features),
        FunctionTool("fan_out_detector", _detector(fan_out, ("min_distinct_receivers", "time_window_hours", "min_transaction_count"))),
        FunctionTool("fan_in_detector", _detector(fan_in, ("min_distinct_senders", "time_window_hours", "min_transaction_count"))),
        FunctionTool("cycle_detector", _detector(cycles, ("min_hops", "max_hops", "max_elapsed_hours"))),
        FunctionTool("gather_scatter_detector", _detector(gather_scatter, ("min_distinct_incoming_senders", "min_distinct_outgoing_destinations", "max_time_window_hours"))),
        FunctionTool("scatter_gather_detector", _detector(scatter_gather, ("min_intermediaries", "max_time_window_hours"))),
        FunctionTool("velocity_detector", _velocity),
        FunctionTool("evidence_aggregator", lambda c, p: {"assessments": aggregate(_all_evidence(c, p))}),
        FunctionTool("risk_scorer", _score),
        FunctionTool("investigation_report", _report),
    ]
    return [*own, *map(Placeholder, PLACEHOLDERS)]


class Registry:
    def __init__(self, tools: Iterable[Tool] = ()) -> None:
        self._tools: dict[str, Tool] = {}
        for t in tools:
            self.register(t)

    def register(self, tool: Tool, replace: bool = False) -> None:
        if tool.info.name in self._tools and not replace:
            raise ValueError(f"there is a tool named {tool.info.name}")
        self._tools[tool.info.name] = tool

    def get(self, name: str) -> Tool:
        return self._tools[name]

    def exists(self, name: str) -> bool:
        return name in self._tools

    def list(self) -> list[ToolInfo]:
        return [self._tools[n].info for n in sorted(self._tools)]


def default_registry() -> Registry:
    return Registry(default_tools())
