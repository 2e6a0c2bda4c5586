"""Runs a plan step by step and keeps a trace."""

from __future__ import annotations

from time import perf_counter

from flowlattice.plans.parser import parse
from flowlattice.plans.planner import plan as make_plan
from flowlattice.plans.query_model import Context, Outcome, Plan, Status, TraceEntry
from flowlattice.plans.tools import Registry, default_registry


def final_status(trace: list[TraceEntry]) -> Status:
    """The worst of all: failed, then not implemented, then skipped."""
    seen = {t.status for t in trace}
    return next((s for s in (Status.FAILED, Status.NOT_IMPLEMENTED, Status.SKIPPED) if s in seen), Status.SUCCESS)


class Orchestrator:
    def __init__(self, registry: Registry | None = None) -> None:
        self.registry = registry or default_registry()

    def execute(self, plan: Plan, context: Context) -> Outcome:
        """After a required step fails, later required steps are skipped; an unknown tool stops nothing."""
        trace: list[TraceEntry] = []
        failed = ""
        for step in sorted(plan.steps, key=lambda s: s.order):
            if failed and step.required:
                trace.append(TraceEntry(step.order, step.tool_name, Status.SKIPPED, f"{failed} failed before."))
                continue
            if not self.registry.exists(step.tool_name):
                trace.append(TraceEntry(step.order, step.tool_name, Status.NOT_IMPLEMENTED, "There is no such tool."))
                continue
            began = perf_counter()
            try:
                result = self.registry.get(step.tool_name).execute(context, step.parameters)
                entry = TraceEntry(step.order, step.tool_name, result.status, result.summary, perf_counter() - began, result.error)
                if result.status == Status.SUCCESS:
                    context.results[step.tool_name] = result.data
            except Exception as e:  # a tool's failure is part of the trace, whatever it is
                entry = TraceEntry(step.order, step.tool_name, Status.FAILED, f"{step.tool_name} failed.", perf_counter() - began, f"{type(e).__name__}: {e}")
            trace.append(entry)
            if entry.status == Status.FAILED and step.required:
                failed = step.tool_name
        counts = {s.value: sum(t.status == s for t in trace) for s in Status}
        summary = ", ".join(f"{n} {k}" for k, n in counts.items() if n) or "no steps"
        return Outcome(context.request, plan, trace, context.results, final_status(trace), summary)

    def run(self, query: str, context: Context, assess: bool = False, today=None) -> Outcome:
        """Parses, plans and executes a question."""
        context.request = parse(query, today)
        return self.execute(make_plan(context.request, assess), context)
