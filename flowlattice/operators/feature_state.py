"""Account features as a state that parts are merged into, so that a new day is added without reading the history.

A state is five tables.  ``totals`` has a row an account: counts, sums (decimals, and doubles where those don't fit), largest
amounts, mergeable quantile sketches of amounts, first and last time, and gaps.  ``values`` has each account's
counterparties, banks, formats and currencies; ``hours`` its transactions by hour; ``labels`` the counts of labels; ``amounts``
how often it paid and received an amount.
All combine on the map side, so a busy account spreads over tasks.

Parts follow each other in time for every account: merging adds the gap between the last time of one and the first of the
next, and an account whose parts overlap is an error, as gaps inside the overlap can't be known any more.

Medians are exact: the sketches tell where among the amounts they lie (see sketched_median).
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlattice.operators.features import FEATURES, FeatureConfig, account_events, distinct_values, gaps, hour_counts, label_totals, made_features
from flowlattice.operators.sketched_median import K, amount_counts, refined_medians, sketched_medians  # noqa: F401
from flowlattice.sources.feature_store import FeatureStore

_SUMS = {"total_outgoing_amount": "out_amount", "total_incoming_amount": "in_amount", "low_value_outgoing_amount": "low_amount", "near_threshold_outgoing_value": "near_amount"}
_COUNTS = ("transaction_count", "outgoing_count", "incoming_count", "low_value_outgoing_count", "near_threshold_outgoing_count", "round_amount_count", "cross_bank_transaction_count", "self_transfer_count")
_GAPS = ("gap_micros", "gap_count", "rapid_gap_count")


@dataclass(frozen=True)
class State:
    totals: DataFrame
    values: DataFrame
    hours: DataFrame
    labels: DataFrame
    amounts: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def folded(tx: DataFrame, config: FeatureConfig = FeatureConfig()) -> State:
    """The state of one part."""
    e = account_events(tx, config).where("account_id is not null")
    counts = dict(zip(_COUNTS, (F.lit(1), *(F.col(c) for c in ("out", "inc", "low", "near", "round", "cross", "self"))), strict=True))
    amounts = {"out_amount": F.col("out_amount"), "in_amount": F.col("in_amount"), "low_amount": F.when(F.col("low") == 1, F.col("out_amount")), "near_amount": F.when(F.col("near") == 1, F.col("out_amount"))}
    whole = {n: amounts[c].try_cast("decimal(28,6)") for n, c in _SUMS.items()}
    totals = e.groupBy("account_id").agg(
        *(F.sum(c).cast("long").alias(n) for n, c in counts.items()),
        *(F.sum(c).cast("decimal(38,6)").alias(n) for n, c in whole.items()), *(F.sum(F.when(whole[n].isNull(), amounts[c])).alias(f"{n}_rest") for n, c in _SUMS.items()),
        F.max("out_amount").alias("max_outgoing_amount"), F.max("in_amount").alias("max_incoming_amount"),
        F.kll_sketch_agg_double(F.when(F.col("out") == 1, F.col("out_amount")), K).alias("outgoing_sketch"), F.kll_sketch_agg_double(F.when(F.col("inc") == 1, F.col("in_amount")), K).alias("incoming_sketch"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )
    totals = totals.join(gaps(e, config.rapid_gap_minutes), "account_id", "left").fillna(0, list(_GAPS))
    return State(totals, distinct_values(e), hour_counts(e), label_totals(e), amount_counts(e))


def merged(*parts: State, rapid_minutes: float = 60.0) -> State:
    """The state of several parts together; each account's parts follow each other in time."""
    all_ = {n: reduce(DataFrame.unionByName, (p.tables()[n] for p in parts)) for n in parts[0].tables()}
    before = F.lag("last_t").over(Window.partitionBy("account_id").orderBy("first_t", "last_t"))
    t = all_["totals"].withColumn("before", before)
    gap = F.when(F.col("first_t") < F.col("before"), F.raise_error(F.concat(F.lit("parts of this account overlap in time: "), "account_id")).cast("long")).otherwise(F.col("first_t") - F.col("before"))
    t = t.withColumn("gap", gap)
    between = {"gap_micros": F.coalesce("gap", F.lit(0)), "gap_count": F.when(F.col("gap") > 0, 1).otherwise(0), "rapid_gap_count": F.when((F.col("gap") > 0) & (F.col("gap") <= round(rapid_minutes * 60e6)), 1).otherwise(0)}
    totals = t.groupBy("account_id").agg(
        *(F.sum(n).alias(n) for n in _COUNTS), *(F.sum(n).cast("decimal(38,6)").alias(n) for n in _SUMS), *(F.sum(f"{n}_rest").alias(f"{n}_rest") for n in _SUMS),
        F.max("max_outgoing_amount").alias("max_outgoing_amount"), F.max("max_incoming_amount").alias("max_incoming_amount"),
        F.kll_merge_agg_double("outgoing_sketch", K).alias("outgoing_sketch"), F.kll_merge_agg_double("incoming_sketch", K).alias("incoming_sketch"),
        F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), *(F.sum(F.col(n) + between[n]).alias(n) for n in _GAPS),
    )
    values = all_["values"].groupBy("account_id", "kind", "value").agg(F.max("out").alias("out"), F.max("inc").alias("inc"))
    hours = all_["hours"].groupBy("account_id", "hour").agg(F.sum("n").alias("n"))
    labels = all_["labels"].groupBy("account_id").agg(F.sum("event_count").alias("event_count"), F.sum("laundering_event_count").alias("laundering_event_count"))
    amounts = all_["amounts"].groupBy("account_id", "role", "x").agg(F.sum("n").alias("n"))
    return State(totals, values, hours, labels, amounts)


def features_of(state: State, accounts: DataFrame | None = None) -> DataFrame:
    """The feature table of a state."""
    t = state.totals
    exact = {n: F.coalesce(F.col(n).cast("double") + F.col(f"{n}_rest"), F.col(n).cast("double"), F.col(f"{n}_rest"), F.lit(0.0)) for n in _SUMS}
    t = t.select(
        "account_id", *_COUNTS, *(v.alias(n) for n, v in exact.items()), *(F.greatest(c, F.lit(0.0)).alias(c) for c in ("max_outgoing_amount", "max_incoming_amount")), *_GAPS,
    )
    sketches = state.totals.select("account_id", F.col("outgoing_sketch").alias("os"), F.col("outgoing_count").alias("o"), F.col("incoming_sketch").alias("is"), F.col("incoming_count").alias("i"))
    t = t.join(refined_medians(state.amounts, sketches), "account_id", "left")
    return made_features(t, state.values, state.hours, accounts).select(*FEATURES)


def advance(store: FeatureStore, tx: DataFrame, config: FeatureConfig = FeatureConfig()) -> None:
    """Merges one more part into the state that a store keeps; only the state and the part are read."""
    own = folded(tx, config)
    before = store.load_state()
    store.save_state((merged(State(**before), own, rapid_minutes=config.rapid_gap_minutes) if before else own).tables())
