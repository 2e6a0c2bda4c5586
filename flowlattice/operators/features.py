"""Account features: 42 columns a row, from both roles of every transaction; labels apart.

All measures are plain aggregates that combine on the map side.  Distinct counts group the values first; gaps between
transactions are taken within days and then between them; so an account of any size is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlattice.functions.columns import MICROS_PER_HOUR, exact_sum, micros, number, require
from flowlattice.operators.sketched_median import sketched_medians
from flowlattice.operators.streaming_median import streaming_medians
from flowlattice.sources.feature_store import FeatureSet

#: The order of the feature table's columns.
FEATURES = (
    "account_id", "transaction_count", "outgoing_count", "incoming_count", "total_outgoing_amount", "total_incoming_amount",
    "mean_outgoing_amount", "mean_incoming_amount", "median_outgoing_amount", "median_incoming_amount", "max_outgoing_amount", "max_incoming_amount",
    "unique_outgoing_counterparties", "unique_incoming_counterparties", "unique_counterparties", "unique_outgoing_banks", "unique_incoming_banks",
    "fan_out_ratio", "fan_in_ratio", "active_hours", "active_days", "max_transactions_in_hour", "max_transactions_in_day",
    "average_transactions_per_active_day", "transactions_per_active_hour", "mean_time_between_transactions_minutes",
    "payment_format_count", "payment_currency_count", "receiving_currency_count", "low_value_outgoing_count", "low_value_outgoing_amount",
    "near_threshold_outgoing_count", "near_threshold_outgoing_value", "round_amount_count", "cross_bank_transaction_count", "self_transfer_count",
    "rapid_gap_count", "rapid_gap_ratio", "bank_name", "bank_id", "entity_id", "entity_name",
)


@dataclass(frozen=True)
class FeatureConfig:
    low_value_threshold: float = 10_000.0
    near_threshold_band_ratio: float = 0.05
    round_amount_multiple: float = 100.0
    round_amount_tolerance: float = 0.01
    rapid_gap_minutes: float = 60.0
    sample_rows: int = 2_000
    #: "exact", "approximate" (bounded memory however many amounts an account has), "sketch" (that too, mergeable, with a stated
    #: error of rank), "streaming" (in order of arrival) or "none".
    median: str = "exact"


def account_events(tx: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One row for each transaction and role; a payment to oneself is one row that is both.

    account_id, party, bank, t, ord, out, inc (0 or 1), out_amount, in_amount, format, paid_in, got_in, and the flags.
    """
    require(tx, {"timestamp", "sender_account", "receiver_account"}, "feature engineering")
    text = lambda c: F.col(c) if c in tx.columns else F.lit(None).cast("string")
    paid, got, limit = number(tx, "amount_paid"), number(tx, "amount_received"), config.low_value_threshold
    own = F.col("sender_account") == F.col("receiver_account")
    rest = F.pmod(paid, F.lit(config.round_amount_multiple))
    tolerance = config.round_amount_tolerance
    # the upper tolerance also has 1e-5 of the multiple
    round_ = (rest <= tolerance) | (config.round_amount_multiple - rest <= tolerance + 1e-5 * config.round_amount_multiple)
    near = (paid >= limit * (1 - config.near_threshold_band_ratio)) & (paid < limit)
    order = F.col("ord") if "ord" in tx.columns else F.monotonically_increasing_id()
    shared = [micros(F.col("timestamp")).alias("t"), order.alias("ord"), text("payment_format").alias("format"), text("payment_currency").alias("paid_in"), text("receiving_currency").alias("got_in"),
              (~text("from_bank").eqNullSafe(text("to_bank"))).cast("int").alias("cross"), (F.col("is_laundering") if "is_laundering" in tx.columns else F.lit(None)).cast("long").alias("laundering")]
    flag = lambda c, name: c.cast("int").alias(name)
    out = tx.select(
        F.col("sender_account").alias("account_id"), F.col("receiver_account").alias("party"), text("to_bank").alias("bank"), *shared, F.lit(1).alias("out"), flag(own, "inc"),
        paid.alias("out_amount"), F.when(own, paid).otherwise(0.0).alias("in_amount"), flag(own, "self"), flag(paid < limit, "low"), flag(near, "near"), flag(round_, "round"),
    )
    zero = [F.lit(0).alias(c) for c in ("self", "low", "near", "round")]
    inc = tx.where(~own).select(
        F.col("receiver_account").alias("account_id"), F.col("sender_account").alias("party"), text("from_bank").alias("bank"), *shared, F.lit(0).alias("out"), F.lit(1).alias("inc"),
        F.lit(0.0).alias("out_amount"), got.alias("in_amount"), *zero,
    )
    return out.unionByName(inc)


def counts_and_amounts(e: DataFrame, median: str = "exact") -> DataFrame:
    """Counts, totals, means, medians and largest amounts, and the conditional counts and sums."""
    total = lambda c: F.sum(c).cast("long")
    middle = {"exact": F.median, "approximate": lambda c: F.percentile_approx(c, 0.5, 10_000), "none": lambda c: F.max(F.lit(None).cast("double"))}[median]
    return e.groupBy("account_id").agg(
        F.count("*").alias("transaction_count"), total("out").alias("outgoing_count"), total("inc").alias("incoming_count"),
        exact_sum(F.col("out_amount")).alias("total_outgoing_amount"), exact_sum(F.col("in_amount")).alias("total_incoming_amount"),
        F.coalesce(middle(F.when(F.col("out") == 1, F.col("out_amount"))), F.lit(0.0) if median != "none" else F.lit(None)).cast("double").alias("median_outgoing_amount"),
        F.coalesce(middle(F.when(F.col("inc") == 1, F.col("in_amount"))), F.lit(0.0) if median != "none" else F.lit(None)).cast("double").alias("median_incoming_amount"),
        F.greatest(F.max("out_amount"), F.lit(0.0)).alias("max_outgoing_amount"), F.greatest(F.max("in_amount"), F.lit(0.0)).alias("max_incoming_amount"),
        total("low").alias("low_value_outgoing_count"), exact_sum(F.when(F.col("low") == 1, F.col("out_amount")).otherwise(0.0)).alias("low_value_outgoing_amount"),
        total("near").alias("near_threshold_outgoing_count"), exact_sum(F.when(F.col("near") == 1, F.col("out_amount")).otherwise(0.0)).alias("near_threshold_outgoing_value"),
        total("round").alias("round_amount_count"), total("cross").alias("cross_bank_transaction_count"), total("self").alias("self_transfer_count"),
    )


def distinct_values(e: DataFrame) -> DataFrame:
    """account_id, kind, value, out, inc: an account's counterparties, banks, formats and currencies, and the roles it met them in."""
    kinds = [("party", "party"), ("bank", "bank"), ("format", "format"), ("paid_in", "paid_in"), ("got_in", "got_in")]
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds))).alias("x")
    values = e.select("account_id", "out", "inc", one).select("account_id", "out", "inc", "x.*").where(F.col("value").isNotNull())
    return values.groupBy("account_id", "kind", "value").agg(F.max("out").alias("out"), F.max("inc").alias("inc"))


def value_counts(values: DataFrame) -> DataFrame:
    """Different counterparties (not oneself), banks, formats and currencies of every account, from distinct_values()."""
    count = lambda kind, c: F.count_if((F.col("kind") == kind) & c)
    other, out, inc = F.col("value") != F.col("account_id"), F.col("out") == 1, F.col("inc") == 1
    return values.groupBy("account_id").agg(
        count("party", other & out).alias("unique_outgoing_counterparties"), count("party", other & inc).alias("unique_incoming_counterparties"), count("party", other).alias("unique_counterparties"),
        count("bank", out).alias("unique_outgoing_banks"), count("bank", inc).alias("unique_incoming_banks"),
        count("format", F.lit(True)).alias("payment_format_count"), count("paid_in", F.lit(True)).alias("payment_currency_count"), count("got_in", F.lit(True)).alias("receiving_currency_count"),
    )


def distinct_counts(e: DataFrame) -> DataFrame:
    return value_counts(distinct_values(e))


def hour_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("account_id", F.floor(F.col("t") / MICROS_PER_HOUR).alias("hour")).agg(F.count("*").alias("n"))


def active_counts(hours: DataFrame) -> DataFrame:
    """Active hours and days, and the most transactions in one of them, from hour_counts()."""
    days = hours.groupBy("account_id", F.floor(F.col("hour") / 24).alias("day")).agg(F.sum("n").alias("n"), F.count("*").alias("hours"), F.max("n").alias("most"))
    return days.groupBy("account_id").agg(F.sum("hours").alias("active_hours"), F.count("*").alias("active_days"), F.max("most").alias("max_transactions_in_hour"), F.max("n").alias("max_transactions_in_day"))


def bucket_counts(e: DataFrame) -> DataFrame:
    return active_counts(hour_counts(e))


def gaps(e: DataFrame, rapid_minutes: float = 60.0) -> DataFrame:
    """Total, number and rapid number of the positive gaps between an account's transactions, in order of time."""
    day = F.floor(F.col("t") / (24 * MICROS_PER_HOUR)).alias("day")
    inside = e.select("account_id", "t", "ord", day)
    inside = inside.select("account_id", (F.col("t") - F.lag("t").over(Window.partitionBy("account_id", "day").orderBy("t", "ord"))).alias("gap"))
    days = e.groupBy("account_id", day).agg(F.min("t").alias("a"), F.max("t").alias("z"))
    between = days.select("account_id", (F.col("a") - F.lag("z").over(Window.partitionBy("account_id").orderBy("day"))).alias("gap"))
    rows = inside.unionByName(between).where("gap > 0")
    return rows.groupBy("account_id").agg(F.sum("gap").alias("gap_micros"), F.count("*").alias("gap_count"), F.count_if(F.col("gap") <= round(rapid_minutes * 60e6)).alias("rapid_gap_count"))


def label_totals(e: DataFrame) -> DataFrame:
    return e.groupBy("account_id").agg(F.count("*").alias("event_count"), F.coalesce(F.sum("laundering"), F.lit(0)).alias("laundering_event_count"))


def label_counts(e: DataFrame) -> DataFrame:
    """What labels say of accounts; kept apart from features."""
    hits = F.col("laundering_event_count")
    return label_totals(e).select("account_id", "event_count", hits, (hits / F.col("event_count")).alias("laundering_event_rate"), (hits > 0).alias("has_laundering_label"))


def _share(x: Column, n: Column) -> Column:
    return F.when(n > 0, x / n).otherwise(0.0)


def features(tx: DataFrame, accounts: DataFrame | None = None, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The feature table; ``accounts`` (account_number, bank_name, bank_id, entity_id, entity_name) fills the last columns."""
    e = account_events(tx, config)
    apart = {"streaming": streaming_medians, "sketch": sketched_medians}.get(config.median)
    f = counts_and_amounts(e, "none" if apart else config.median)
    if apart:
        f = f.drop("median_outgoing_amount", "median_incoming_amount").join(apart(e), "account_id", "left")
    f = f.join(gaps(e, config.rapid_gap_minutes), "account_id", "left")
    return made_features(f, distinct_values(e), hour_counts(e), accounts)


def made_features(f: DataFrame, values: DataFrame, hours: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The feature table from an account's counts, amounts and gaps, distinct_values() and hour_counts()."""
    f = f.join(value_counts(values), "account_id", "left").join(active_counts(hours), "account_id", "left")
    names = ("bank_name", "bank_id", "entity_id", "entity_name")
    if accounts is None:
        f = f.select("*", *(F.lit(None).cast("string").alias(c) for c in names))
    else:
        f = f.join(accounts.select(F.col("account_number").alias("account_id"), *names), "account_id", "left")
    c = F.col
    made = {
        "mean_outgoing_amount": _share(c("total_outgoing_amount"), c("outgoing_count")), "mean_incoming_amount": _share(c("total_incoming_amount"), c("incoming_count")),
        "fan_out_ratio": _share(c("unique_outgoing_counterparties"), c("outgoing_count")), "fan_in_ratio": _share(c("unique_incoming_counterparties"), c("incoming_count")),
        "average_transactions_per_active_day": _share(c("transaction_count"), c("active_days")), "transactions_per_active_hour": _share(c("transaction_count"), c("active_hours")),
        "mean_time_between_transactions_minutes": F.when(c("gap_count") > 0, c("gap_micros") / c("gap_count") / 60e6).otherwise(F.lit(float("nan"))),
        "rapid_gap_ratio": F.coalesce(c("rapid_gap_count"), F.lit(0)) / F.greatest(c("transaction_count") - 1, F.lit(1)),
    }
    whole = {n for n in FEATURES if n.startswith("unique_") or n.endswith(("_count", "_hours", "_days", "_in_hour", "_in_day"))} - set(made)
    return f.select(*(made[n].alias(n) if n in made else F.coalesce(c(n), F.lit(0)).cast("long").alias(n) if n in whole else c(n) for n in FEATURES))


def feature_set(tx: DataFrame, accounts: DataFrame | None = None, config: FeatureConfig = FeatureConfig(), max_rows: int | None = None, source: str = "transactions") -> FeatureSet:
    """Features and labels in order of account, with a note on how they were made."""
    f = features(tx, accounts, config).orderBy("account_id")
    labels = label_counts(account_events(tx, config)).orderBy("account_id")
    note = {"source": source, "feature_count": len(FEATURES), "label_policy": "labels are kept apart and never enter a feature", "max_rows": max_rows}
    return FeatureSet(f, labels, note)
