"""Changes of behaviour: where an account's daily activity leaves its usual level and stays away, by CUSUM.

A day's deviation is its number of transactions less the account's mean, in standard deviations, less a slack.  The CUSUM
adds deviations up and starts again at zero whenever it would fall below; that is the running sum less its smallest value so far
(zero included), two running aggregates that need no loop.  The downward one takes deviations with the sign turned.

Days are counted first, so an account has a row a day whatever its traffic; days without any count as zero.  An extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlattice.functions.columns import severity
from flowlattice.functions.materialise import written
from flowlattice.operators.prepare import prepare
from flowlattice.plans.evidence import evidence, parameters

DAY = 24 * 3_600_000_000


def daily_counts(tx: DataFrame) -> DataFrame:
    """account, day (since 1970), n, amount for every day from the first to the last of the input, of every account that sends or receives."""
    rows = prepare(tx, "behaviour").withColumn("day", F.floor(F.col("t") / DAY))
    both = F.explode(F.array_distinct(F.array("sender", "receiver"))).alias("account")
    seen = written(rows.select(both, "day", "paid").groupBy("account", "day").agg(F.count("*").alias("n"), F.sum(F.col("paid").try_cast("decimal(28,6)")).cast("double").alias("amount")), "daily")
    lo, hi = seen.agg(F.min("day"), F.max("day")).first()
    if lo is None:
        return seen
    every = seen.select("account").distinct().select("account", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("day"))
    return every.join(seen, ["account", "day"], "left").fillna(0, ["n", "amount"])


def cusum(days: DataFrame, slack: float) -> DataFrame:
    """``days`` with up and down (the CUSUM of either side), rounded to six places so that sums in any order agree."""
    own = Window.partitionBy("account")
    upto = own.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    mean, spread = F.avg("n").over(own), F.stddev_pop("n").over(own)
    z = F.when(spread > 0, (F.col("n") - mean) / spread).otherwise(0.0)
    days = days.withColumn("z", F.round(z, 6).cast("decimal(20,6)"))
    for name, sign in (("up", 1), ("down", -1)):
        days = days.withColumn(f"p_{name}", F.sum(F.col("z") * sign - F.lit(slack).cast("decimal(20,6)")).over(upto))
        days = days.withColumn(name, F.col(f"p_{name}") - F.least(F.lit(0), F.min(f"p_{name}").over(upto)))
    return days.drop("z", "p_up", "p_down")


def deviations(tx: DataFrame, threshold: float = 4.0, slack: float = 0.5) -> DataFrame:
    """Evidence of accounts whose CUSUM reaches ``threshold``, by the side that rises higher; from the first day at the threshold to the day of the peak."""
    days = cusum(daily_counts(tx), slack)
    peaks = days.groupBy("account").agg(F.max("up").alias("up"), F.max("down").alias("down"), F.sum("n").alias("total"))
    peaks = peaks.withColumn("rises", F.col("up") >= F.col("down")).withColumn("peak", F.greatest("up", "down")).where(F.col("peak") >= threshold)
    side = F.when(F.col("rises"), F.col("up")).otherwise(F.col("down"))
    own = days.join(peaks.select("account", "rises", "peak"), "account").withColumn("c", side)
    base = own.groupBy("account", "rises", "peak").agg(F.min(F.when(F.col("c") >= threshold, F.col("day"))).alias("first"), F.min(F.when(F.col("c") == F.col("peak"), F.col("day"))).alias("last"))
    during = own.join(base.select("account", "first", "last"), "account").where(F.col("day").between(F.col("first"), F.greatest("first", "last")))
    sums = during.groupBy("account").agg(F.sum("n").alias("n"), F.sum(F.col("amount").cast("decimal(28,6)")).cast("double").alias("amount"))
    base = base.join(sums, "account")
    time = lambda d: F.timestamp_add("DAY", F.col(d).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    ratio = F.col("peak").cast("double") / F.lit(float(threshold))
    return evidence(
        base, detector_name=F.lit("behavior_deviation_detector"), typology=F.lit("BEHAVIOR-CHANGE"), primary_account_id="account", involved_account_ids=F.array("account"),
        start_time=time("first"), end_time=time("last"), transaction_count="n", total_amount="amount", evidence_strength=F.least(F.lit(1.0), ratio), severity=severity(ratio),
        reasons=F.array(F.format_string("The account's daily activity %s and stays away from its usual level.", F.when(F.col("rises"), "rises").otherwise("falls"))),
        detector_parameters=parameters(threshold=threshold, slack=slack), transaction_references=F.array().cast("array<string>"),
        metadata=F.struct(F.col("peak").cast("double").alias("peak"), F.when(F.col("rises"), "up").otherwise("down").alias("direction")),
    )
