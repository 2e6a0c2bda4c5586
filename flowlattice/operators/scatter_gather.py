"""Scatter-gather: an account pays several intermediaries, who all pay one destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import LISTED, exact_sum, severity, unique_in_order, window_micros
from flowlattice.functions.materialise import written
from flowlattice.operators.prefix import prefixes, within
from flowlattice.operators.prepare import ENTITIES, prepare
from flowlattice.plans.evidence import empty, evidence, parameters


def scatter_gather(tx: DataFrame, min_intermediaries: int = 2, max_time_window_hours: float = 24) -> DataFrame:
    """Evidence of accounts whose first K receivers all pay a common account, each after its own receipt and by t0 + W.

    The destination is neither the origin nor an intermediary; of several, the one reached first by all, then the
    smallest id.

    Of an origin's legs, the one whose intermediary pays least brings up the destinations; the payments of the others, hubs
    mostly, are looked up for these alone, by intermediary, destination and time bucket.
    """
    if min_intermediaries < 2:
        return empty(tx.sparkSession)
    width = window_micros(max_time_window_hours)
    rows = prepare(tx, "scatter-gather")
    paid = rows.withColumn("account", F.col("sender")).withColumn("party", F.col("receiver"))
    ends, parties = (written(x, "prefixes") for x in prefixes(paid, min_intermediaries))
    legs = parties.join(ends, "account").select(F.col("account").alias("origin"), F.col("party").alias("via"), "met", "r", (F.col("t0") + width).alias("until"))
    others = legs.groupBy("origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "via", "met"))), lambda x: F.struct(x["via"].alias("via"), x["met"].alias("met"))).alias("legs"))
    onward = rows.select(F.col("sender").alias("via"), F.col("receiver").alias("dest"), "t", "ord", F.col("paid").alias("amount"), "ref", "timestamp", *ENTITIES).withColumn("b", F.floor(F.col("t") / width))
    onward = onward.where(F.col("dest") != "")
    # a leg's payments lie in the bucket of the receipt or the next
    buckets = lambda df: df.withColumn("b", F.explode(F.array(F.floor(F.col("met") / width), F.floor(F.col("met") / width) + 1)))
    load = onward.groupBy("via", "b").agg(F.count("*").alias("load"))
    loads = buckets(legs).join(load, ["via", "b"], "left").groupBy("origin", "r").agg(F.coalesce(F.sum("load"), F.lit(0)).alias("load"))
    seed = loads.groupBy("origin").agg(F.min(F.struct("load", "r")).alias("x")).select("origin", F.col("x.r").alias("seed"))
    legs = written(legs.join(seed, "origin").withColumn("seed", F.col("r") == F.col("seed")), "legs")
    inside = (F.col("t") > F.col("met")) & (F.col("t") <= F.col("until"))
    payment = F.min(F.struct("t", "ord", "amount", "ref", "timestamp", *ENTITIES)).alias("f")
    hits = buckets(legs.where("seed")).join(onward, ["via", "b"]).where(inside & (F.col("dest") != F.col("origin")))
    hits = hits.join(legs.select("origin", F.col("via").alias("dest")), ["origin", "dest"], "left_anti")
    first = written(hits.groupBy("origin", "via", "dest").agg(payment), "seeds")
    asked = first.select("origin", "dest").join(legs.where("not seed").select("origin", "via", "met", "until"), "origin")
    first = first.unionByName(buckets(asked).join(onward, ["via", "dest", "b"]).where(inside).groupBy("origin", "via", "dest").agg(payment))
    first = written(first, "first")
    common = first.groupBy("origin", "dest").agg(F.count("*").alias("c"), F.max("f.t").alias("latest")).where(F.col("c") == min_intermediaries)
    best = common.groupBy("origin").agg(F.min(F.struct("latest", "dest")).alias("x")).select("origin", F.col("x.dest").alias("dest"))
    last = first.join(best, ["origin", "dest"]).select(F.col("origin").alias("account"), "dest", "via", "f.*").withColumn("phase", F.lit(1))
    start = within(paid, ends).join(best.select(F.col("origin").alias("account"), "dest"), "account")
    cols = ["account", "dest", "t", "ord", "timestamp", F.col("amount"), "ref", "phase", *ENTITIES]
    both = start.withColumn("amount", F.col("paid")).withColumn("phase", F.lit(0)).select(*cols).unionByName(last.select(*cols))
    base = both.groupBy("account", "dest").agg(
        F.count("*").alias("n"), exact_sum(F.col("amount")).alias("amount"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.max(F.when(F.col("phase") == 0, F.col("timestamp"))).alias("scatter_end"),
        F.array_sort(F.collect_list(F.struct("t", "phase", "ord", "ref", *ENTITIES))).alias("rows"),
    )
    times = last.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("via", F.col("timestamp").alias("downstream_time")))).alias("downstream"))
    base = base.join(others.withColumnRenamed("origin", "account"), "account").join(times, "account")
    vias = F.transform("legs", lambda x: x["via"])
    field = lambda c: lambda x: x[c]
    names = F.concat(*(F.transform("rows", field(c)) for c in ENTITIES))
    ratio = F.lit(min_intermediaries) / F.lit(float(min_intermediaries))
    return evidence(
        base, detector_name=F.lit("scatter_gather_detector"), typology=F.lit("SCATTER-GATHER"), primary_account_id="account",
        involved_account_ids=F.slice(unique_in_order(F.concat(F.array("account"), vias, F.array("dest"))), 1, LISTED),
        entity_ids=F.slice(unique_in_order(names), 1, LISTED), start_time="start", end_time="end", transaction_count="n", total_amount="amount",
        evidence_strength=F.least(F.lit(1.0), ratio), severity=severity(ratio),
        reasons=F.array(
            F.concat(F.format_string("The account paid %d intermediaries, who all paid ", F.size("legs")), F.col("dest"), F.lit(f" within {max_time_window_hours:g} hours.")),
            F.lit("Every intermediary was paid before it paid on."),
        ),
        detector_parameters=parameters(min_intermediaries=min_intermediaries, max_time_window_hours=max_time_window_hours),
        transaction_references=F.transform("rows", lambda x: x["ref"]),
        metadata=F.struct(F.col("account").alias("origin_account"), vias.alias("intermediate_accounts"), F.col("dest").alias("common_destination"),
                          F.col("start").alias("scatter_start_time"), F.col("scatter_end").alias("scatter_end_time"), F.col("end").alias("gather_end_time"),
                          F.map_from_entries(F.transform("legs", lambda x: F.struct(x["via"], F.struct(
                              F.timestamp_add("MICROSECOND", x["met"], F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("receipt_time"),
                              F.filter("downstream", lambda d: d["via"] == x["via"])[0]["downstream_time"].alias("downstream_time"))))).alias("intermediate_paths")),
    )
