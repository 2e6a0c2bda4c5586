"""Pattern annotations: text blocks of transactions between BEGIN and END lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlattice.sources.transactions import RAW_COLUMNS, in_order

#: How a block's lines start.
BEGIN, END = "BEGIN LAUNDERING ATTEMPT", "END LAUNDERING ATTEMPT"
#: Bits of a line's order below the number of its split (see transactions.in_order).
SPLIT = 33


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """attempts() of text files; a block never spans files."""
    raw = spark.read.text(path)
    return attempts(in_order(raw.select("value", F.col("_metadata"))).select("value", F.col("_metadata.file_path").alias("file"), F.col("ord").alias("line")))


def attempts(lines: DataFrame) -> DataFrame:
    """One row a finished attempt: attempt_id, typology, description, transactions (array of structs).

    ``lines`` has value, line (the order; its bits from ``SPLIT`` on number the file's splits) and file.  Attempts are numbered
    within splits first and then over splits, so that many tasks read a large file, wherever its splits begin.  A BEGIN inside an attempt discards what is open but uses up a
    number; rows outside an attempt are passed over; a BEGIN line without a typology is an error.
    """
    lines = lines.withColumn("value", F.trim("value"))
    begin, end = F.upper("value").startswith(BEGIN), F.upper("value").startswith(END)
    lines = lines.withColumn("begin", begin).withColumn("end", end).withColumn("split", F.shiftright(F.col("line").cast("long"), SPLIT))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.sum(F.col("begin").cast("long")).alias("n")).select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.sum(F.col("begin").cast("long")).over(Window.partitionBy("file", "split").orderBy("line"))
    lines = lines.withColumn("inside", inside).join(splits, ["file", "split"]).withColumn("n", F.col("inside") + F.col("before"))
    own = Window.partitionBy("file", "n").orderBy("line")
    lines = lines.where("n > 0").withColumn("ends", F.sum(F.col("end").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.where(F.coalesce("ends", F.lit(0)) == 0)
    head = F.regexp_extract("value", r"(?i)^BEGIN LAUNDERING ATTEMPT\s*-\s*([^:]+)", 1)
    typology = F.replace(F.upper(F.trim(head)), F.lit(" "), F.lit("-"))
    typology = F.when(F.length(F.trim(head)) > 0, typology).otherwise(F.raise_error(F.concat(F.lit("no typology in: "), F.col("value"))))
    is_row = ~F.col("begin") & ~F.col("end") & (F.size(F.split("value", ",")) >= 10) & F.col("value").rlike(r"^[0-9]{4}")
    fields = F.from_csv("value", F.lit(", ".join(f"{c} string" for c in RAW_COLUMNS)))
    groups = lines.groupBy("file", "n").agg(
        F.max(F.when(F.col("begin"), typology)).alias("typology"),
        F.max(F.when(F.col("begin"), F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1)))).alias("description"),
        F.array_sort(F.collect_list(F.when(is_row, F.struct("line", fields.alias("t"))))).alias("rows"),
        F.max(F.col("end").cast("int")).alias("closed"),
    )
    out = groups.where("closed = 1")
    return out.select("file", F.col("n").alias("attempt_id"), "typology", F.coalesce("description", F.lit("")).alias("description"), F.transform("rows", lambda r: r["t"]).alias("transactions"))


def typology_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("typology").agg(F.count("*").alias("attempts"), F.sum(F.size("transactions")).alias("transactions"))
