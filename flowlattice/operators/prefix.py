"""The shortest start of an account's history that reaches K different counterparties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (account, party, t, ord): the ends (account, t0, t1, o1), and the parties met (account, party, met).

    An account's parties are grouped before they are ranked, so only K rows an account are ever sorted out.
    t0: the first time; (t1, o1): the row that brings the K-th party; met: when a party was first met.
    """
    seen = rows.groupBy("account", "party").agg(F.min(F.struct("t", "ord")).alias("s"))
    seen = seen.withColumn("r", F.row_number().over(Window.partitionBy("account").orderBy("s"))).where(F.col("r") <= k)
    ends = seen.groupBy("account").agg(F.count("*").alias("c"), F.min("s.t").alias("t0"), F.max("s").alias("e")).where(F.col("c") == k)
    ends = ends.select("account", "t0", F.col("e.t").alias("t1"), F.col("e.ord").alias("o1"))
    return ends, seen.select("account", "party", F.col("s.t").alias("met"), "r")


def within(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of the prefixes, with the ends' columns."""
    return rows.join(ends, "account").where((F.col("t") < F.col("t1")) | ((F.col("t") == F.col("t1")) & (F.col("ord") <= F.col("o1"))))
