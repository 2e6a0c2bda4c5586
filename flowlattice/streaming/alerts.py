"""Alerts on streams of transactions: an extension, as batch detectors have no counterpart for late data.

Fixed windows that slide by a part of their width count an account's transactions and counterparties as they come.
Distinct counterparties are counted approximately, with bounded state; windows close at the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import at_least_one, without_labels


def fan_out_alerts(tx: DataFrame, min_distinct_receivers: int = 5, min_transaction_count: int = 5, window: str = "24 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """sender_account, window_start, window_end, receivers, transactions, amount: windows that reach both minimums."""
    at_least_one(min_distinct_receivers=min_distinct_receivers, min_transaction_count=min_transaction_count)
    tx = without_labels(tx).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    by = tx.groupBy("sender_account", F.window("timestamp", window, slide)).agg(F.approx_count_distinct("receiver_account", 0.01).alias("receivers"), F.count("*").alias("transactions"), F.sum("amount_paid").alias("amount"))
    by = by.where((F.col("receivers") >= min_distinct_receivers) & (F.col("transactions") >= min_transaction_count))
    return by.select("sender_account", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "receivers", "transactions", "amount")
