"""More registered queries: files read back, detectors on odd columns, stores, tools, questions.

Files are written from the tables first, in the layouts that users bring, to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlattice.functions.materialise import shared_dir
from flowlattice.operators import features as fe
from flowlattice.operators.fan import fan_out
from flowlattice.operators.velocity import velocity
from flowlattice.plans.evidence import stripped_json
from flowlattice.plans.investigate import investigation
from flowlattice.plans.orchestrator import Orchestrator
from flowlattice.plans.parser import parse
from flowlattice.plans.planner import plan
from flowlattice.plans.queries import ACCOUNTS, ASSESS, FEATURES, TX, _cycle_sql, _fan_sql, _features, _GS, _PATTERN, _query, _r, _scored, _sg_sql, _tx
from flowlattice.plans.query_model import Context
from flowlattice.plans.tools import default_registry
from flowlattice.plans.views import breakdown_rows, evidence_rows, shown
from flowlattice.sources import demo
from flowlattice.sources import transactions as src
from flowlattice.sources.annotations import BEGIN, END, read_annotations, typology_counts
from flowlattice.sources.feature_store import FeatureStore

# ---- CSV files


def _raw_csv(spark: SparkSession, d: str) -> str:
    """The events as raw CSV files in order of event_id, with blanks, bad times and numbers, and empty fields; gives their folder."""
    every = lambda n: F.col("event_id") % n == 0
    e = spark.read.parquet(f"{d}/events.parquet")
    to = F.get_json_object("props", "$.k")
    bank = lambda x: F.concat(F.lit(" 0"), (x.cast("bigint") % 10).cast("string"))
    columns = [
        F.when(every(29), "no time").otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm")), bank(F.col("user_id")), F.when(every(23), "").otherwise(F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" "))), bank(to), to,
        F.when(every(17), "n/a").otherwise(F.col("value").cast("string")), F.lit("USD "), F.when(every(19), "").otherwise(F.col("value").cast("string")), F.lit("EUR"), F.initcap("event_type"), F.when(every(31), "x").otherwise("1"),
    ]
    path = shared_dir(spark, "raw")
    rows = e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(*(x.alias(c) for x, c in zip(columns, src.RAW_COLUMNS, strict=True)))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


_RAW = """raw AS (SELECT event_id, date_trunc('minute', ts) AS timestamp, '0' || user_id % 10 AS from_bank, CASE WHEN event_id % 23 = 0 THEN '' ELSE user_id::VARCHAR END AS sender_account,
  '0' || json_extract_string(props, '$.k')::BIGINT % 10 AS to_bank, json_extract_string(props, '$.k') AS receiver_account, CASE WHEN event_id % 17 <> 0 THEN value END AS amount_received, 'USD' AS receiving_currency,
  CASE WHEN event_id % 19 <> 0 THEN value END AS amount_paid, 'EUR' AS payment_currency, upper(event_type[1]) || lower(event_type[2:]) AS payment_format, CASE WHEN event_id % 31 <> 0 THEN 1 END::BIGINT AS is_laundering FROM events WHERE event_id % 29 <> 0)"""
_COLUMNS = ", ".join(src.RAW_COLUMNS)


@_query(f"WITH {_RAW} SELECT {_COLUMNS} FROM raw")
def csv_transactions(spark: SparkSession, d: str) -> DataFrame:
    return src.read_transactions(spark, _raw_csv(spark, d)).drop("ord")


@_query(f"WITH {_RAW} SELECT {_COLUMNS} FROM raw ORDER BY event_id LIMIT 70")
def csv_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return src.sample_transactions(spark, _raw_csv(spark, d), 70).drop("ord")


@_query(f"WITH {_RAW} SELECT {_COLUMNS} FROM raw WHERE timestamp >= TIMESTAMP '2024-01-08' AND (sender_account IN ('', '7') OR receiver_account IN ('', '7')) ORDER BY event_id LIMIT 40")
def csv_selected(spark: SparkSession, d: str) -> DataFrame:
    return src.read_transactions(spark, _raw_csv(spark, d), chunksize=1000, start="2024-01-08", accounts=["", "7"], max_rows=40).drop("ord")


@_query(f"WITH {ACCOUNTS} SELECT bank_name, bank_id, account_id AS account_number, entity_id, entity_name FROM ac")
def csv_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Every account twice in the file: the first row counts."""
    path = shared_dir(spark, "accounts")
    rows = src.accounts_from_customers(spark, d).repartitionByRange(4, "ord").sortWithinPartitions("ord").select(*src.ACCOUNT_COLUMNS)
    rows.write.option("header", True).csv(f"{path}/{src.ACCOUNT_FILE}")
    return src.read_accounts(spark, path)


@_query("SELECT event_id::VARCHAR AS transaction_id, user_id::VARCHAR AS customer_id, CASE WHEN event_id % 17 <> 0 THEN value END AS amount, date_trunc('second', ts) AS timestamp, event_type AS transaction_type, json_extract_string(props, '$.k') AS counterparty, 'US' AS country FROM events WHERE event_id % 29 <> 0")
def csv_generic(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    bad = lambda n, x, other: F.when(F.col("event_id") % n == 0, other).otherwise(x)
    rows = e.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("customer_id"), bad(17, F.col("value").cast("string"), "?").alias("amount"), bad(29, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "never").alias("timestamp"), F.col("event_type").alias("transaction_type"), F.get_json_object("props", "$.k").alias("counterparty"), F.lit("US").alias("country"))
    path = shared_dir(spark, "generic")
    rows.write.option("header", True).csv(path)
    return src.read_generic(spark, path).select(*src.GENERIC_COLUMNS)


@_query(f"SELECT typology, count(*) AS attempts, sum(transactions)::BIGINT AS transactions FROM ({_PATTERN}) GROUP BY typology")
def annotation_files(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of seven events each, as lines of text files that end between attempts; every fifth attempt is never ended."""
    tx = _tx(spark, d)
    first = tx.agg(F.min("ord")).first()[0] or 0  # event ids have no gaps
    tx = tx.withColumn("i", F.col("ord") - F.lit(first)).withColumn("g", F.floor(F.col("i") / 7))
    row = F.concat_ws(",", F.date_format("timestamp", "yyyy/MM/dd HH:mm"), *(F.col(c).cast("string") for c in src.RAW_COLUMNS[1:]))
    kind = F.when(F.col("g") % 2 == 0, "FAN-OUT").otherwise("GATHER SCATTER")
    head = F.when(F.col("i") % 7 == 0, F.concat(F.lit(f"{BEGIN} - "), kind, F.lit(":  Max "), F.col("g").cast("string"), F.lit("-degree Fan-Out")))
    last = F.coalesce(F.lead("g").over(Window.partitionBy("g").orderBy("ord")) != F.col("g"), F.lit(True))
    tail = F.when(last & (F.col("g") % 5 != 4), F.concat(F.lit(f"{END} - "), kind))
    lines = tx.withColumn("tail", tail).select("g", "ord", F.posexplode(F.array_compact(F.array(head, row, "tail"))).alias("p", "value"))
    path = shared_dir(spark, "patterns")
    lines.repartitionByRange(3, "g").sortWithinPartitions("ord", "p").select("value").write.text(path)
    return typology_counts(read_annotations(spark, path))


# ---- columns that detectors must not see, or miss


_LABELLED = f"{_fan_sql('sender_account', 'receiver_account', 'amount_paid')} SELECT account AS primary_account_id, parties AS involved, n AS transaction_count, 0.0::DOUBLE AS total_amount FROM e JOIN l USING (account)"


@_query(_LABELLED)
def labels_and_missing_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Fan-out with label columns of every name, and without amounts."""
    tx = _tx(spark, d).drop("amount_paid", "amount_received").withColumn("Is Laundering", F.lit(1)).withColumn("label", F.lit("x")).withColumn("expected_typology", F.lit("y"))
    e = fan_out(tx)
    if {"label", "is_laundering"} & set(e.columns):
        raise ValueError("labels reached the evidence")
    return e.select("primary_account_id", F.array_join("involved_account_ids", ",").alias("involved"), "transaction_count", "total_amount")


@_query(f"""{FEATURES}, v AS (SELECT account_id, max_transactions_in_hour AS peak, CASE WHEN transaction_count % 2 = 0 THEN rapid_gap_count ELSE 0 END AS rapid, CASE WHEN transaction_count % 3 <> 0 THEN transaction_count / active_hours ELSE 0 END AS rate FROM f)
SELECT account_id AS primary_account_id, 0::BIGINT AS transaction_count, 0.0::DOUBLE AS total_amount, round(least(1, greatest(peak / 10, rapid / 5, rate / 5)), 4)::DOUBLE AS evidence_strength,
  CASE WHEN greatest(peak / 10, rapid / 5, rate / 5) >= 1.75 THEN 'high' WHEN greatest(peak / 10, rapid / 5, rate / 5) >= 1.25 THEN 'medium' ELSE 'low' END AS severity FROM v WHERE peak >= 10 OR rapid >= 5 OR rate >= 5""")
def velocity_of_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Features that are null, NaN or missing count as 0."""
    f = _features(spark, d)
    n = F.col("transaction_count")
    f = f.withColumn("rapid_gap_count", F.when(n % 2 == 0, F.col("rapid_gap_count"))).withColumn("transactions_per_active_hour", F.when(n % 3 == 0, float("nan")).otherwise(F.col("transactions_per_active_hour")))
    e = velocity(f.drop("transaction_count", "total_outgoing_amount", "total_incoming_amount").withColumn("has_laundering_label", F.lit(True)))
    return e.select("primary_account_id", "transaction_count", "total_amount", _r("evidence_strength"), "severity")


@_query("""SELECT event_id AS ord, '{"event":{"list":[{"kind":"' || event_type || '"},[],null,' || user_id % 7 || ']},"user":' || user_id || '}' AS metadata FROM events""")
def label_keys_stripped(spark: SparkSession, d: str) -> DataFrame:
    """JSON of every event, without the keys that carry labels, at any depth."""
    e = spark.read.parquet(f"{d}/events.parquet")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    text = said('{"is_laundering":1,"user":', F.col("user_id"), ',"event":{"label":["x"],"list":[{"kind":"', F.col("event_type"), '","expected_typology":{"deep":[1,{"label":2}]}},[],null,', F.col("user_id") % 7, '],"Is Laundering":null}}')
    return e.select(F.col("event_id").alias("ord"), stripped_json(text).alias("metadata"))


# ---- stores, demonstration, views


@_query(f"{FEATURES} SELECT account_id, transaction_count, unique_counterparties, bank_name, entity_name FROM f WHERE account_id = '42'")
def feature_store_lookup(spark: SparkSession, d: str) -> DataFrame:
    store = FeatureStore(spark, shared_dir(spark, "store"))
    store.save(fe.feature_set(_tx(spark, d), src.first_per_account(src.accounts_from_customers(spark, d))))
    return store.lookup("42").select("account_id", "transaction_count", "unique_counterparties", "bank_name", "entity_name")


@_query(f"{FEATURES} SELECT account_id, event_count, laundering_event_count FROM (SELECT account_id, count(*) AS event_count, sum(is_laundering)::BIGINT AS laundering_event_count FROM ev GROUP BY account_id)")
def feature_store_labels(spark: SparkSession, d: str) -> DataFrame:
    store = FeatureStore(spark, shared_dir(spark, "store"))
    store.save(fe.feature_set(_tx(spark, d)))
    found = store.load()
    if not store.exists() or found.metadata["feature_count"] != len(fe.FEATURES):
        raise ValueError("the store has lost its note")
    return found.labels.select("account_id", "event_count", "laundering_event_count")


@_query("SELECT c_custkey::VARCHAR AS primary_account_id, 'CYCLE|FAN-IN|FAN-OUT|GATHER-SCATTER|SCATTER-GATHER|VELOCITY' AS typologies, 6::BIGINT AS evidence_count, 227750.0::DOUBLE AS total_amount, TIMESTAMP '2024-03-01 09:00:00' AS first_seen, TIMESTAMP '2024-03-02 08:00:00' AS last_seen, 1::BIGINT AS reports FROM customer")
def demo_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The demonstration's evidence, assessed and reported for every customer."""
    accounts = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("primary_account_id"))
    b = demo.demo_bundle(spark, accounts=accounts)
    a = b["assessments"].select("primary_account_id", F.array_join(F.array_sort("typologies_detected"), "|").alias("typologies"), "evidence_count", _r("total_suspicious_amount").alias("total_amount"), F.col("assessment_start_time").alias("first_seen"), F.col("assessment_end_time").alias("last_seen"))
    return a.join(b["reports"].groupBy("primary_account_id").agg(F.count("*").alias("reports")).hint("merge"), "primary_account_id")


@_query(f"""{ASSESS} SELECT account AS primary_account_id, component, points FROM (SELECT account, unnest(['Evidence strength', 'Severity', 'Typology diversity', 'Repeated evidence', 'Activity magnitude']) AS component,
  unnest([round(s1, 3), s2, s3, s4, round(s5, 3)]) AS points FROM fin)""")
def view_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return breakdown_rows(_scored(spark, d)).withColumn("points", F.round("points", 3))


@_query(f"{ASSESS} SELECT account AS primary_account_id, detector, kind AS typology, upper(severity) AS severity, round(strength, 3) AS evidence_strength, n AS transactions, round(amount, 4) AS amount FROM al")
def view_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence_rows(_scored(spark, d)).select("primary_account_id", "detector", "typology", "severity", "evidence_strength", "transactions", _r("amount"))


@_query("SELECT c_custkey, c_custkey::VARCHAR AS whole, CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE printf('%.1f', c_custkey / 3) END AS part FROM customer")
def view_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as a dashboard shows them."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k, shown(k).alias("whole"), shown(F.when(k % 5 != 0, k / 3), fraction=True).alias("part"))


# ---- investigations and tools


@_query(f"{_fan_sql('sender_account', 'receiver_account', 'amount_paid', 4, 24, 4)} SELECT account AS primary_account_id, 1::BIGINT AS evidence_count, n AS suspicious_transaction_count, start_time AS first_seen, end_time AS last_seen FROM e WHERE account = '42'")
def investigation_of_an_account(spark: SparkSession, d: str) -> DataFrame:
    r = investigation(_tx(spark, d), "42", ["FAN-OUT"])
    return r.select("primary_account_id", "evidence_count", "suspicious_transaction_count", F.col("timeline")[0]["timestamp"].alias("first_seen"), F.col("timeline")[0]["end_time"].alias("last_seen"))


@_query(f"{_fan_sql('sender_account', 'receiver_account', 'amount_paid', 7, 48, 5)} SELECT account AS primary_account_id, parties AS involved, n AS transaction_count FROM e JOIN l USING (account)")
def tool_fan_out(spark: SparkSession, d: str) -> DataFrame:
    tool = default_registry().get("fan_out_detector")
    e = tool.execute(Context(transactions=_tx(spark, d)), {"min_distinct_receivers": 7, "time_window_hours": 48}).data["evidence"]
    return e.select("primary_account_id", F.array_join("involved_account_ids", ",").alias("involved"), "transaction_count")


@_query(f"{ASSESS.split(', al AS')[0].split('al AS')[0].rstrip().rstrip(',')} SELECT account AS primary_account_id, 1::BIGINT AS evidence_count, 'FAN-OUT' AS typologies FROM fo")
def tool_chain(spark: SparkSession, d: str) -> DataFrame:
    """A detector, then what sums its evidence up, each from what the tool before left in the context."""
    context, registry = Context(transactions=_tx(spark, d)), default_registry()
    for name in ("fan_out_detector", "evidence_aggregator", "risk_scorer", "investigation_report"):
        result = registry.get(name).execute(context, {})
        if result.status.value != "SUCCESS":
            raise ValueError(f"{name}: {result.error}")
        context.results[name] = result.data
    return context.latest("scored").select("primary_account_id", "evidence_count", F.array_join("typologies_detected", "|").alias("typologies"))


_TOOLS = (
    "aggregation", "anomaly_detector", "behavior_deviation_detector", "customer_lookup", "cycle_detector", "dataset_profiler", "eda", "evidence_aggregator", "explanation", "fan_in_detector", "fan_out_detector",
    "feature_engineering", "gather_scatter_detector", "investigation_report", "result_filtering", "risk_lookup", "risk_scorer", "risk_scoring", "scatter_gather_detector", "smurfing_detector", "structuring_detector",
    "threshold_rule", "transaction_filter", "velocity_detector",
)
_REAL = ("cycle_detector", "evidence_aggregator", "fan_in_detector", "fan_out_detector", "feature_engineering", "gather_scatter_detector", "investigation_report", "risk_scorer", "scatter_gather_detector", "velocity_detector")


#: Detectors that look at transactions, and the SQL of what they find with their usual thresholds.
_FINDS = {
    "fan_out_detector": _fan_sql("sender_account", "receiver_account", "amount_paid") + " SELECT * FROM e", "fan_in_detector": _fan_sql("receiver_account", "sender_account", "amount_received") + " SELECT * FROM e",
    "gather_scatter_detector": _GS, "scatter_gather_detector": _sg_sql(24), "cycle_detector": _cycle_sql(3, 6),
}


@_query(" UNION ALL ".join(f"SELECT '{n}' AS tool, '{'SUCCESS' if n in _REAL else 'NOT_IMPLEMENTED'}' AS status, {f'(SELECT count(*) FROM ({_FINDS[n]}))' if n in _FINDS else 'NULL::BIGINT'} AS found" for n in _TOOLS))
def tool_registry(spark: SparkSession, d: str) -> DataFrame:
    """What every tool says of itself, and how much evidence the detectors find in all transactions; those that do nothing yet are asked."""
    registry, context, out = default_registry(), Context(transactions=_tx(spark, d)), None
    for t in registry.list():
        status = "SUCCESS" if t.implemented else registry.get(t.name).execute(context).status.value
        told = [F.lit(t.name).alias("tool"), F.lit(status).alias("status")]
        if t.name in _FINDS:
            own = registry.get(t.name).execute(context, {}).data["evidence"].agg(F.count("*").alias("found")).select(*told, "found")
        else:
            own = spark.range(1).select(*told, F.lit(None).cast("long").alias("found"))
        out = own if out is None else out.unionByName(own)
    return out


# ---- questions

TODAY = date(2024, 6, 30)
#: Questions about a customer k, in turn; {k}: the key, {n}: k % 90 + 1, {amount}: 1,000 to 999,000.  Then SQL: intent, pattern, output, customer, days, type, country, amount limit, count limit, number of steps.
_ASKED = (
    ("Show accounts sending money to many different accounts", "'fan_out_detection'", "'fan_out'", "'pattern_summary'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 1),
    ("Find fan-in over the last {n} days", "'fan_in_detection'", "'fan_in'", "'pattern_summary'", "NULL", "n", "NULL", "NULL", "NULL", "NULL", 1),
    ("Detect circular transfers", "'cycle_detection'", "'cycle'", "'pattern_summary'", "NULL", "NULL", "'transfer'", "NULL", "NULL", "NULL", 1),
    ("any gather-scatter?", "'gather_scatter_detection'", "'gather_scatter'", "'pattern_summary'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 1),
    ("any scatter gather?", "'scatter_gather_detection'", "'scatter_gather'", "'pattern_summary'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 1),
    ("Why is CUST_A{k} high risk", "'risk_explanation'", "NULL", "'explanation'", "'CUST_A' || k", "NULL", "NULL", "NULL", "NULL", "NULL", 3),
    ("Investigate customer CUST_{k} in US", "'customer_investigation'", "NULL", "'case_file'", "'CUST_' || k", "NULL", "NULL", "'US'", "NULL", "NULL", 6),
    ("Find structuring under ${amount}", "'structuring_detection'", "'structuring'", "'pattern_summary'", "NULL", "NULL", "NULL", "NULL", "'< ' || (k % 999 + 1) * 1000", "NULL", 5),
    ("Run EDA", "'eda_request'", "NULL", "'eda_summary'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 2),
    ("Show high-risk customers", "'high_risk_search'", "NULL", "'customer_list'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 3),
    ("Analyse this dataset", "'broad_analysis'", "NULL", "'investigation_summary'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 10),
)
_READ = "intent, pattern, output, customer, days, kind, country, amount, count"


def _limit(t) -> str | None:
    return t and f"{t.operator} {t.value:.0f}"


def _case(i: int, kind: str) -> str:
    return f"(CASE k % {len(_ASKED)} " + " ".join(f"WHEN {j} THEN {q[i]}" for j, q in enumerate(_ASKED)) + f" END)::{kind}"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for k, question in zip(b["k"], b["question"], strict=True):
            r = parse(question, TODAY)
            out.append((k, r.intent.value, r.pattern and r.pattern.value, r.requested_output.value, r.customer_id, r.date_range and r.date_range.relative_days, r.transaction_type, r.country, _limit(r.amount_threshold), _limit(r.transaction_count_threshold), len(plan(r).steps)))
        yield pd.DataFrame(out, columns=["k", *_READ.split(", "), "steps"]).astype({"days": "Int64"})


@_query("SELECT k, " + ", ".join(f"{_case(i + 1, 'BIGINT' if c in ('days', 'steps') else 'VARCHAR')} AS {c}" for i, c in enumerate([*_READ.split(", "), "steps"])) + " FROM (SELECT c_custkey AS k, c_custkey % 90 + 1 AS n FROM customer)")
def questions_understood(spark: SparkSession, d: str) -> DataFrame:
    """A question about every customer, read in batches."""
    k = F.col("c_custkey")
    said = F.element_at(F.array(*(F.lit(q[0]) for q in _ASKED)), (k % len(_ASKED) + 1).cast("int"))
    for name, value in (("k", k.cast("string")), ("n", (k % 90 + 1).cast("string")), ("amount", F.concat((k % 999 + 1).cast("string"), F.lit(",000")))):
        said = F.replace(said, F.lit("{" + name + "}"), value)
    kinds = ", ".join(f"{c} {'long' if c == 'days' else 'string'}" for c in _READ.split(", "))
    kind = spark.read.parquet(f"{d}/customer.parquet").schema["c_custkey"].dataType.simpleString()
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), said.alias("question")).mapInPandas(_read, f"k {kind}, {kinds}, steps long")


@_query(" UNION ALL ".join(f"SELECT '{q}' AS question, account AS primary_account_id, n AS transaction_count FROM ({_fan_sql(*c)} SELECT * FROM e)" for q, c in (("Show accounts sending money to many different accounts", ("sender_account", "receiver_account", "amount_paid")), ("Find fan-in", ("receiver_account", "sender_account", "amount_received")))))
def questions_answered(spark: SparkSession, d: str) -> DataFrame:
    """What questions find when their plans run over all transactions."""
    out = None
    for question in ("Show accounts sending money to many different accounts", "Find fan-in"):
        context = Context(transactions=_tx(spark, d))
        run = Orchestrator().run(question, context, today=TODAY)
        if run.status.value != "SUCCESS":
            raise ValueError(f"{question}: {run.status.value}")
        own = context.latest("evidence").select(F.lit(question).alias("question"), "primary_account_id", "transaction_count")
        out = own if out is None else out.unionByName(own)
    return out
