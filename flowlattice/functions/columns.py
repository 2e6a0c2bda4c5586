"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that carry labels; no operator but the label aggregate may see them.
LABEL_COLUMNS = (
    "is_laundering", "Is Laundering", "label", "expected_typology", "annotation_typology", "expected_ground_truth",
    "laundering_event_count", "laundering_event_rate", "has_laundering_label",
)
MICROS_PER_HOUR = 3_600_000_000
#: Ids and references that an evidence row lists at most.
LISTED = 20


def require(df: DataFrame, names: set[str], what: str) -> None:
    missing = sorted(names - set(df.columns))
    if missing:
        raise ValueError(f"{what} needs the columns {missing}")


def without_labels(df: DataFrame) -> DataFrame:
    return df.drop(*LABEL_COLUMNS)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone; the session's zone plays no part."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def window_micros(hours: float) -> int:
    if hours <= 0:
        raise ValueError("a time window must be positive")
    return round(hours * MICROS_PER_HOUR)


def at_least_one(**values: float) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} must be at least 1")


def number(df: DataFrame, name: str) -> Column:
    """A column as double; missing, bad, null and NaN become 0."""
    if name not in df.columns:
        return F.lit(0.0)
    x = F.col(name).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def exact_sum(x: Column) -> Column:
    """The sum of doubles, the same in whatever order rows come.

    Values are added as decimals of six places; those that don't fit (beyond 10^22, or not finite) as doubles.
    """
    whole = x.try_cast("decimal(28,6)")
    rest = F.sum(F.when(whole.isNull(), x))
    return F.coalesce(F.sum(whole).cast("double") + rest, F.sum(whole).cast("double"), rest)


def iso(ts: Column) -> Column:
    """ISO 8601, with a fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def severity(ratio: Column, high: float = 2.0, medium: float = 1.25) -> Column:
    return F.when(ratio >= high, "high").when(ratio >= medium, "medium").otherwise("low")


def rotated(accounts: Column) -> Column:
    """An array turned so that its smallest element comes first."""
    at = F.array_position(accounts, F.array_min(accounts)).cast("int")
    return F.concat(F.slice(accounts, at, F.size(accounts)), F.slice(accounts, F.lit(1), at - 1))


def first_unique(df: DataFrame, key: str, value: str, order: list[str], name: str, n: int = LISTED) -> DataFrame:
    """key, and under ``name`` its first ``n`` distinct values in order of first sight; nulls and empty texts don't count.

    Values are grouped before they are ranked, and no list is longer than n.
    """
    seen = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.min(F.struct(*order)).alias("o"))
    seen = seen.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("o", value))).where(F.col("r") <= n)
    own = F.array_sort(F.collect_list(F.struct("r", value)))
    return seen.groupBy(key).agg(F.transform(own, lambda x: x[value]).alias(name))


def unique_in_order(values: Column) -> Column:
    """An array without repeats, nulls and empty texts."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def money(x: Column, compact: bool = False) -> Column:
    """$1,234.50, or $1.2K and $3.4M."""
    full = F.concat(F.lit("$"), F.format_number(x, 2))
    if not compact:
        return full
    return (
        F.when(F.abs(x) >= 1e6, F.concat(F.lit("$"), F.format_number(x / 1e6, 1), F.lit("M")))
        .when(F.abs(x) >= 1e3, F.concat(F.lit("$"), F.format_number(x / 1e3, 1), F.lit("K")))
        .otherwise(full)
    )


def one_place(x: Column) -> Column:
    return F.format_string("%.1f", x)


def time_range(start: Column, end: Column) -> Column:
    both = F.concat(iso(start), F.lit(" -> "), iso(end))
    return F.when(start.isNotNull() & end.isNotNull(), both).when(start.isNotNull(), F.concat(F.lit("from "), iso(start))).when(end.isNotNull(), F.concat(F.lit("through "), iso(end))).otherwise("not available")
