"""Fan-out and fan-in: many counterparties of an account within a sliding time window.

A window is closed: [t - W, t], ending at a transaction.  The account's best window has the most counterparties,
then the most transactions, then the earliest end.

A row is the latest of its counterparty for windows that end from its time on, up to that counterparty's next row or to
its own time + W.  So it adds one to the counterparties there, and one to the transactions up to its time + W; running
sums of these changes, within short spans of time and then over spans, give every window's counts in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlattice.functions.columns import at_least_one, exact_sum, first_unique, severity, window_micros
from flowlattice.functions.materialise import written
from flowlattice.operators.prepare import prepare
from flowlattice.plans.evidence import evidence, parameters


#: Spans of a window's width, within which changes are summed first: a busy account's day is dealt to so many tasks.
SPANS = 64


def changes(rows: DataFrame, width: int) -> DataFrame:
    """account, e, d, n, ends: by how much the counts of windows that end at e or later change at e; whether a row stands there."""
    rows = rows.select("account", "party", "t", "ord", F.floor(F.col("t") / F.lit(width)).alias("b"))
    # a counterparty's next row: of the same stretch of time, or the first of the next one; any later one is out of reach
    after = rows.groupBy("account", "party", (F.col("b") - 1).alias("b")).agg(F.min("t").alias("after"))
    inner = F.lead("t").over(Window.partitionBy("account", "party", "b").orderBy("t", "ord"))
    rows = rows.withColumn("inner", inner).join(after, ["account", "party", "b"], "left")
    out = F.col("t") + F.lit(width + 1)
    event = lambda e, d, n, ends: F.struct(e.alias("e"), F.lit(d).alias("d"), F.lit(n).alias("n"), F.lit(ends).alias("ends"))
    three = F.array(event(F.col("t"), 1, 1, 1), event(F.least(F.coalesce("inner", "after"), out), -1, 0, 0), event(out, 0, -1, 0))
    return rows.select("account", F.inline(three)).groupBy("account", "e").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.max("ends").alias("ends"))


def best_windows(rows: DataFrame, width: int, min_distinct: int, min_count: int) -> DataFrame:
    """account, d, n, t_end of each account's best window; ``rows`` has account, party, t and ord."""
    own = changes(rows, width).withColumn("b", F.floor(F.col("e") / F.lit(max(1, width // SPANS))))
    spans = own.groupBy("account", "b").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    before = Window.partitionBy("account").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("account", "b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in ("d", "n")))
    upto = Window.partitionBy("account", "b").orderBy("e")
    got = own.select("account", "b", "e", "ends", F.sum("d").over(upto).alias("d"), F.sum("n").over(upto).alias("n")).where("ends = 1")
    got = got.join(spans, ["account", "b"]).select("account", "e", (F.col("d") + F.col("b_d")).cast("int").alias("d"), (F.col("n") + F.col("b_n")).alias("n"))
    got = got.where((F.col("d") >= min_distinct) & (F.col("n") >= min_count))
    best = got.groupBy("account").agg(F.max(F.struct("d", "n", (-F.col("e")).alias("m"))).alias("x"))
    return best.select("account", "x.d", "x.n", (-F.col("x.m")).alias("t_end"))


def slices(tx: DataFrame, outgoing: bool, min_distinct: int = 5, hours: float = 24, min_count: int = 5) -> DataFrame:
    """The transactions of every account's best window: account, party, amount and prepare()'s columns."""
    at_least_one(min_distinct=min_distinct, min_count=min_count)
    width = window_micros(hours)
    account, party, amount = ("sender", "receiver", "paid") if outgoing else ("receiver", "sender", "received")
    rows = prepare(tx, "fan-out" if outgoing else "fan-in", row_references=True)
    rows = rows.withColumn("account", F.col(account)).withColumn("party", F.col(party)).withColumn("amount", F.col(amount))
    best = written(best_windows(rows, width, min_distinct, min_count), "windows")  # a row an account, used by all that follows
    return rows.join(best, "account").where(F.col("t").between(F.col("t_end") - width, F.col("t_end")))


def _fan(tx: DataFrame, outgoing: bool, min_distinct: int, hours: float, min_count: int) -> DataFrame:
    # a window an account is little against all rows, and four steps read it
    entity = "receiver_entity_id" if outgoing else "sender_entity_id"
    own = slices(tx, outgoing, min_distinct, hours, min_count)
    own = written(own.select("account", "party", "t", "ord", "timestamp", "amount", "ref", "d", entity), "slices")
    order = ["t", "ord"]
    base = own.groupBy("account").agg(F.count("*").alias("n"), exact_sum(F.col("amount")).alias("amount"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.first("d").alias("d"))
    base = base.join(first_unique(own, "account", "party", order, "parties"), "account", "left")
    base = base.join(first_unique(own, "account", "ref", order, "refs"), "account", "left")
    base = base.join(first_unique(own, "account", entity, order, "entities"), "account", "left")
    ratio = F.col("d") / F.lit(float(min_distinct))
    side, verb = ("receivers", "paid") if outgoing else ("senders", "was paid by")
    word = "receivers" if outgoing else "senders"
    return evidence(
        base, detector_name=F.lit("fan_out_detector" if outgoing else "fan_in_detector"), typology=F.lit("FAN-OUT" if outgoing else "FAN-IN"),
        primary_account_id="account", involved_account_ids="parties", entity_ids="entities", start_time="start", end_time="end",
        transaction_count="n", total_amount="amount", evidence_strength=F.least(F.lit(1.0), ratio), severity=severity(ratio),
        reasons=F.array(
            F.format_string(f"The account {verb} %d different {word} within {hours:g} hours; {min_distinct} are enough.", "d"),
            F.format_string("These are %d transactions of %.2f in all.", "n", "amount"),
        ),
        detector_parameters=parameters(**{f"min_distinct_{side}": min_distinct, "time_window_hours": hours, "min_transaction_count": min_count}),
        transaction_references="refs", metadata=F.struct(F.col("d").alias("receiver_count" if outgoing else "sender_count")),
    )


def fan_out(tx: DataFrame, min_distinct_receivers: int = 5, time_window_hours: float = 24, min_transaction_count: int = 5) -> DataFrame:
    """Evidence of accounts that pay many receivers; payments to oneself count."""
    return _fan(tx, True, min_distinct_receivers, time_window_hours, min_transaction_count)


def fan_in(tx: DataFrame, min_distinct_senders: int = 5, time_window_hours: float = 24, min_transaction_count: int = 5) -> DataFrame:
    """Evidence of accounts that many senders pay."""
    return _fan(tx, False, min_distinct_senders, time_window_hours, min_transaction_count)
