"""Transactions and account metadata as DataFrames of a fixed schema.

Raw files are read as text in explicit, positional schemas: headers may repeat a name, and bank
ids keep their leading zeros.  ``ord`` gives a row's place in the input, files in order of their
paths; it breaks all ties.  Timestamps have no zone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlattice.functions.columns import require
from flowlattice.functions.materialise import written

#: Canonical columns in file order, and default file names.
RAW_COLUMNS = (
    "timestamp", "from_bank", "sender_account", "to_bank", "receiver_account", "amount_received",
    "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering",
)
ACCOUNT_COLUMNS = ("bank_name", "bank_id", "account_number", "entity_id", "entity_name")
TRANSACTION_FILE, ACCOUNT_FILE = "HI-Small_Trans.csv", "HI-Small_accounts.csv"
GENERIC_COLUMNS = ("transaction_id", "customer_id", "amount", "timestamp", "transaction_type", "counterparty", "country")
TIME_FORMATS = ("yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd")
#: Splits whose paths may be broadcast.
BROADCAST_SPLITS = 100_000
#: Columns taken as text, and as numbers.
_TEXT = ("from_bank", "sender_account", "to_bank", "receiver_account", "receiving_currency", "payment_currency", "payment_format")


def resolve(spark: SparkSession, path: str, default: str) -> str:
    """A file or a pattern as it is; of a folder its default file, or, if it has none, the folder with all its parts."""
    if any(c in path for c in "*?[{") or path.lower().endswith((".csv", ".csv.gz", ".txt")):
        return path
    inner = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{default}")
    return inner.toString() if inner.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(inner) else path


def in_order(raw: DataFrame) -> DataFrame:
    """``raw``, just read from files, with ord: rising within a split as rows are read, and splits by path and place in the file.

    Spark deals splits to tasks by size, so a task's rows alone say nothing of the order of files.
    """
    own = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    splits = raw.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")).distinct()
    splits = written(splits.withColumn("__nth", F.row_number().over(Window.orderBy("__file", "__start")) - 1), "splits")  # a row a split
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    ord_ = (F.shiftleft(F.col("__nth").cast("long"), 33) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord")
    return own.join(splits, ["__file", "__start"]).select(*raw.columns, ord_)


def numbered(df: DataFrame, by: str, name: str, rows: int = 100_000) -> DataFrame:
    """``df`` with ``name``: each row's place (from 0) in order of the number ``by``, nulls last; no task sees more than about ``rows``.

    Quantiles part the rows into ranges; places are counted within ranges, and ranges are added up.
    """
    parts = min(10_000, df.count() // rows + 1)
    bounds = sorted(set(df.approxQuantile(by, [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    ranges = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol=by, outputCol="__range", handleInvalid="keep")
    own = ranges.transform(df).withColumn("__range", F.coalesce("__range", F.lit(math.inf)))  # of a null there is no range
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = own.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(F.asc_nulls_last(by))) - 1
    return own.withColumn("__place", place).join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__start") + F.col("__place")).alias(name))


def parsed_time(x: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in TIME_FORMATS)).cast("timestamp_ntz")


def normalise(raw: DataFrame) -> DataFrame:
    """Raw text columns (and ``ord``) in canonical order and types; rows without time, sender or receiver go.

    An empty field is an empty text, not a null: such an account stays.
    """
    cols = [F.col("ord"), parsed_time(F.trim("timestamp")).alias("timestamp")]
    for c in RAW_COLUMNS[1:]:
        if c in _TEXT:
            cols.append(F.trim(F.coalesce(c, F.lit(""))).alias(c))
        else:
            cols.append(F.col(c).try_cast("bigint" if c == "is_laundering" else "double").alias(c))
    return raw.select(*cols).na.drop(subset=["timestamp", "sender_account", "receiver_account"])


def selected(tx: DataFrame, start: str | None = None, end: str | None = None, accounts: Sequence[str] | DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows of a time range (both ends count), that touch given accounts, and of those the first ``max_rows``.

    A date stands for its midnight.  A DataFrame of accounts (column account_id) is joined instead of listed.
    """
    if start is not None:
        tx = tx.where(F.col("timestamp") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        tx = tx.where(F.col("timestamp") <= F.lit(str(end)).cast("timestamp_ntz"))
    if isinstance(accounts, DataFrame):
        ids = accounts.select(F.col("account_id").alias("__id")).distinct()
        sent = tx.join(ids, tx["sender_account"] == ids["__id"], "left_semi")
        got = tx.join(ids, tx["sender_account"] == ids["__id"], "left_anti").join(ids, F.col("receiver_account") == ids["__id"], "left_semi")
        tx = sent.unionByName(got)
    elif accounts is not None:
        tx = tx.where(F.col("sender_account").isin(*accounts) | F.col("receiver_account").isin(*accounts)) if accounts else tx.where(F.lit(False))
    if max_rows is not None:
        tx = tx.orderBy("ord").limit(max_rows)
    return tx


def read_transactions(spark: SparkSession, path: str, *, chunksize: int | None = None, **select) -> DataFrame:
    """The canonical transactions of CSV files; ``select`` as in selected().

    Splits stand for chunks, so a chunksize changes nothing; one that is not positive is an error all the same.
    """
    if chunksize is not None and chunksize <= 0:
        raise ValueError("chunksize must be positive")
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(resolve(spark, path, TRANSACTION_FILE))
    return selected(normalise(in_order(raw)), **select)


def sample_transactions(spark: SparkSession, path: str, max_rows: int = 1000) -> DataFrame:
    return read_transactions(spark, path, max_rows=max_rows)


def first_per_account(accounts: DataFrame) -> DataFrame:
    """One row an account_number: the first by ``ord``."""
    first = F.row_number().over(Window.partitionBy("account_number").orderBy("ord"))
    return accounts.withColumn("__r", first).where("__r = 1").drop("__r", "ord")


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in ACCOUNT_COLUMNS)).option("header", True).option("enforceSchema", True).csv(resolve(spark, path, ACCOUNT_FILE))
    raw = in_order(raw).select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ACCOUNT_COLUMNS), "ord")
    return first_per_account(raw)


def read_generic(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of customer transactions, in order of time; rows without a time go."""
    df = spark.read.option("header", True).csv(path)
    require(df, set(GENERIC_COLUMNS), "a transaction file")
    df = df.withColumn("timestamp", parsed_time(F.col("timestamp"))).withColumn("amount", F.col("amount").try_cast("double"))
    return df.na.drop(subset=["timestamp"]).orderBy("timestamp", "transaction_id")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as canonical transactions: user_id sends ``value`` to the account in props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    to = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("ord"), F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        (F.col("user_id") % 10).cast("string").alias("from_bank"), F.col("user_id").cast("string").alias("sender_account"),
        (to.try_cast("bigint") % 10).cast("string").alias("to_bank"), to.alias("receiver_account"),
        F.col("value").alias("amount_received"), F.lit("USD").alias("receiving_currency"), F.col("value").alias("amount_paid"),
        F.when(F.col("user_id") % 2 == 0, "USD").otherwise("EUR").alias("payment_currency"), F.col("event_type").alias("payment_format"),
        (F.col("event_id") % 50 == 0).cast("long").alias("is_laundering"),
    )


def accounts_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as account metadata, each account twice, so that keeping the first matters."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    row = lambda copy: c.select(
        F.concat(F.lit("Bank "), F.col("c_nationkey").cast("string")).alias("bank_name"), (F.col("c_custkey") % 10).cast("string").alias("bank_id"),
        F.col("c_custkey").cast("string").alias("account_number"), F.concat(F.lit("E"), F.col("c_nationkey").cast("string")).alias("entity_id"),
        F.concat(F.col("c_name"), F.lit(copy)).alias("entity_name"), (2 * F.col("c_custkey") + (1 if copy else 0)).alias("ord"),
    )
    return row("").unionByName(row(" copy"))
