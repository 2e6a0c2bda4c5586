"""Evidence: what a detector says of an account."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlattice.functions.columns import LABEL_COLUMNS

_texts = T.ArrayType(T.StringType())
EVIDENCE = T.StructType([
    T.StructField("detector_name", T.StringType()), T.StructField("typology", T.StringType()), T.StructField("primary_account_id", T.StringType()),
    T.StructField("involved_account_ids", _texts), T.StructField("entity_ids", _texts),
    T.StructField("start_time", T.TimestampNTZType()), T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("transaction_count", T.LongType()), T.StructField("total_amount", T.DoubleType()), T.StructField("evidence_strength", T.DoubleType()),
    T.StructField("severity", T.StringType()), T.StructField("reasons", _texts),
    T.StructField("detector_parameters", T.MapType(T.StringType(), T.DoubleType())), T.StructField("transaction_references", _texts),
    T.StructField("metadata", T.StringType()), T.StructField("assessment_type", T.StringType()),
])
ASSESSMENT_TYPE = "suspicious_pattern"
SEVERITIES = ("low", "medium", "high")


def parameters(**values: float) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))))


def _clean(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def evidence(df: DataFrame, **cols: Column | str) -> DataFrame:
    """Rows of the EVIDENCE schema; columns that aren't given are null or empty. metadata may be a struct."""
    out = []
    for f in EVIDENCE:
        x = cols.get(f.name)
        c = F.col(x) if isinstance(x, str) else x if x is not None else F.lit(None)
        if f.name in ("involved_account_ids", "entity_ids", "transaction_references"):
            c = _clean(c)
        elif f.name == "typology":
            c = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("-"))
        elif f.name == "assessment_type":
            c = F.lit(ASSESSMENT_TYPE)
        elif f.name == "metadata" and x is not None:
            c = F.to_json(c)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def violations(rows: DataFrame) -> DataFrame:
    """Evidence rows that break the schema's rules, with the rule's name."""
    rules = {
        "empty id": (F.coalesce(F.trim("detector_name"), F.lit("")) == "") | (F.coalesce(F.trim("typology"), F.lit("")) == "") | (F.coalesce(F.trim("primary_account_id"), F.lit("")) == ""),
        "negative count": F.coalesce("transaction_count", F.lit(-1)) < 0,
        "negative amount": F.coalesce("total_amount", F.lit(-1.0)) < 0,
        "strength": ~F.coalesce(F.col("evidence_strength").between(0, 1), F.lit(False)),
        "severity": ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(broken))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVIDENCE)


#: A JSON text's strings (escapes and all), marks, and what lies between: numbers, true, false and null.
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^{}\[\],:"\s]+'


def stripped_json(text: Column, keys: Sequence[str] = LABEL_COLUMNS) -> Column:
    """JSON without the members of these names, at any depth and whatever the schema: keys sorted, without blanks; null for what is no JSON.

    The text's tokens are folded from left to right.  A member to leave out is passed over to the comma or bracket that ends it;
    commas are set before what follows them, so none is left behind.
    """
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(text)), F.lit(_TOKEN), F.lit(0))
    pairs = F.arrays_zip(tokens.alias("t"), F.slice(tokens, 2, F.size(tokens)).alias("next"))  # a string before a colon is a name
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"), F.lit(0).alias("depth"), F.lit(False).alias("comma"))
    opens, closes = ("{", "["), ("}", "]")

    def step(s: Column, x: Column) -> Column:
        t = x["t"]
        named = (x["next"] == ":") & t.isin(*(json.dumps(k) for k in keys))
        ends = (s["depth"] == 0) & (t.isin(*closes) | (t == ","))
        # while members are passed over, depth counts the brackets opened inside them
        depth = F.when(t.isin(*opens), s["depth"] + 1).when(t.isin(*closes), s["depth"] - 1).otherwise(s["depth"])
        skipping = F.struct(s["out"].alias("out"), F.lit(True).alias("skip"), depth.alias("depth"), s["comma"].alias("comma"))
        over = F.struct(s["out"].alias("out"), F.lit(False).alias("skip"), F.lit(0).alias("depth"), s["comma"].alias("comma"))
        closed = F.struct(F.concat(s["out"], F.array(t)).alias("out"), F.lit(False).alias("skip"), F.lit(0).alias("depth"), F.lit(False).alias("comma"))
        comma = F.struct(s["out"].alias("out"), F.lit(False).alias("skip"), F.lit(0).alias("depth"), F.lit(True).alias("comma"))
        kept = F.struct(F.concat(s["out"], F.when(s["comma"], F.array(F.lit(","), t)).otherwise(F.array(t))).alias("out"), F.lit(False).alias("skip"), F.lit(0).alias("depth"), F.lit(False).alias("comma"))
        passing = F.when(~ends, skipping).when(t == ",", over).otherwise(closed)
        return F.when(s["skip"], passing).when(named, skipping).when(t == ",", comma).when(t.isin(*closes), closed).otherwise(kept)

    return F.aggregate(pairs, start, step, lambda s: F.array_join(s["out"], ""))


def without_label_keys(value: Any) -> Any:
    """Nested dicts and lists without the keys that carry labels."""
    if isinstance(value, dict):
        return {k: without_label_keys(v) for k, v in sorted(value.items()) if k not in LABEL_COLUMNS}
    return [without_label_keys(v) for v in value] if isinstance(value, list) else value


def from_dicts(spark: SparkSession, items: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Evidence given as dicts, checked by the schema's rules; a broken one is a ValueError."""
    rows = []
    for item in items:
        if unknown := set(item) - {f.name for f in EVIDENCE}:
            raise ValueError(f"evidence has no {sorted(unknown)}")
        e = {"severity": "low", "evidence_strength": 0.0, "transaction_count": 0, "total_amount": 0.0} | dict(item)
        if not all(str(e.get(k) or "").strip() for k in ("detector_name", "typology", "primary_account_id")):
            raise ValueError("evidence names its detector, typology and account")
        if e["transaction_count"] < 0 or e["total_amount"] < 0 or not 0 <= e["evidence_strength"] <= 1 or e["severity"] not in SEVERITIES:
            raise ValueError(f"evidence of {e['detector_name']} breaks a rule")
        e["typology"] = e["typology"].strip().upper().replace(" ", "-")
        for k in ("involved_account_ids", "entity_ids", "reasons", "transaction_references"):
            e[k] = [str(x) for x in e.get(k) or [] if k == "reasons" or str(x)]
        e["detector_parameters"] = {k: float(v) for k, v in without_label_keys(e.get("detector_parameters") or {}).items()}
        e["metadata"] = json.dumps(without_label_keys(e.get("metadata") or {}), default=str)
        rows.append(tuple(ASSESSMENT_TYPE if f.name == "assessment_type" else float(e[f.name]) if f.name in ("total_amount", "evidence_strength") else e.get(f.name) for f in EVIDENCE))
    return spark.createDataFrame(rows, EVIDENCE)
