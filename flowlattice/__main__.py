"""python -m flowlattice "question" [folder of tables]: parses, plans and runs a question over the events table."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from flowlattice.plans.orchestrator import Orchestrator
from flowlattice.plans.parser import parse
from flowlattice.plans.planner import plan
from flowlattice.plans.query_model import Context
from flowlattice.sources.transactions import from_events


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__)
        return 2
    request = parse(argv[0])
    print(f"Understood: {request.intent.value}, {request.constraints() or 'no constraints'}, as {request.requested_output.value}")
    for step in plan(request).steps:
        print(f"  {step.order}. {step.tool_name}: {step.reason}")
    if len(argv) > 1:
        spark = SparkSession.builder.getOrCreate()
        outcome = Orchestrator().run(argv[0], Context(transactions=from_events(spark, argv[1])))
        for t in outcome.trace:
            print(f"  {t.tool_name}: {t.status.value} in {t.seconds:.2f} s. {t.summary} {t.error or ''}")
        print(f"{outcome.status.value}: {outcome.summary}")
        for name, data in outcome.results.items():
            if "evidence" in data:
                print(f"{name}:")
                data["evidence"].select("primary_account_id", "typology", "severity", "transaction_count", "total_amount").show(5, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
