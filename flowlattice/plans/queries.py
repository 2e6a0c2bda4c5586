"""The registered queries of the library, and for each the DuckDB SQL that says the same.

The ``events`` table stands for transactions (see sources.transactions.from_events).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.functions.columns import money, one_place
from flowlattice.functions.materialise import written
from flowlattice.operators import features as fe
from flowlattice.operators.cycle import cycles
from flowlattice.operators.fan import fan_in, fan_out, slices
from flowlattice.operators.gather_scatter import gather_scatter
from flowlattice.operators.scatter_gather import scatter_gather
from flowlattice.operators.velocity import velocity
from flowlattice.plans.assessment import aggregate, apportioned, level, ordered, scored
from flowlattice.plans.evidence import union
from flowlattice.plans.report import reports
from flowlattice.plans.views import timeline_rows
from flowlattice.sources import transactions as src
from flowlattice.sources.annotations import SPLIT, attempts

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, tuple[Query, str | None]] = {}

TX = """tx AS (SELECT event_id AS ord, ts AS timestamp, CAST(user_id % 10 AS VARCHAR) AS from_bank, CAST(user_id AS VARCHAR) AS sender_account,
  CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS to_bank, json_extract_string(props, '$.k') AS receiver_account,
  value AS amount_received, 'USD' AS receiving_currency, value AS amount_paid, CASE WHEN user_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS payment_currency,
  event_type AS payment_format, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END::BIGINT AS is_laundering, epoch_us(ts) AS t FROM events)"""
HOUR = 3_600_000_000
DAY = 24 * HOUR
EV = f"""{TX},
ev AS (SELECT sender_account AS account_id, receiver_account AS party, to_bank AS bank, t, ord, payment_format AS format, payment_currency AS paid_in, receiving_currency AS got_in, from_bank <> to_bank AS cross_bank, is_laundering,
    1 AS o, (sender_account = receiver_account)::INT AS i, amount_paid AS oa, CASE WHEN sender_account = receiver_account THEN amount_paid ELSE 0 END AS ia,
    (sender_account = receiver_account)::INT AS self, (amount_paid < 10000)::INT AS low, (amount_paid >= 9500 AND amount_paid < 10000)::INT AS near,
    (amount_paid - 100 * floor(amount_paid / 100) <= 0.01 OR 100 - (amount_paid - 100 * floor(amount_paid / 100)) <= 0.011)::INT AS round_ FROM tx
  UNION ALL SELECT receiver_account, sender_account, from_bank, t, ord, payment_format, payment_currency, receiving_currency, from_bank <> to_bank, is_laundering, 0, 1, 0, amount_received, 0, 0, 0, 0 FROM tx WHERE sender_account <> receiver_account)"""


def _query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _registry[f.__name__] = (f, sql)
        return f

    return keep


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return src.from_events(spark, d)


def _r(c: str | Column, n: int = 4) -> Column:
    """Rounded as the SQL's engine does: 55.683749999999996 times 10^4 is 556837.5, so it becomes 55.6838."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.round(x * 10.0**n) / 10.0**n
    return x.alias(c) if isinstance(c, str) else x


CANON = "ord, timestamp, from_bank, sender_account, to_bank, receiver_account, amount_received, receiving_currency, amount_paid, payment_currency, payment_format, is_laundering"


@_query(f"WITH {TX} SELECT {CANON} FROM tx")
def scan_transactions(spark: SparkSession, d: str) -> DataFrame:
    return _tx(spark, d)


@_query(f"WITH {TX} SELECT {CANON} FROM tx WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'")
def filter_date_range(spark: SparkSession, d: str) -> DataFrame:
    return src.selected(_tx(spark, d), "2024-01-05 00:00:00", "2024-01-12 12:00:00")


@_query(f"WITH {TX} SELECT {CANON} FROM tx WHERE sender_account IN ('3', '7', '42') OR receiver_account IN ('3', '7', '42')")
def filter_account_ego(spark: SparkSession, d: str) -> DataFrame:
    return src.selected(_tx(spark, d), accounts=["3", "7", "42"])


@_query(f"WITH {TX} SELECT {CANON} FROM tx WHERE sender_account IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3) OR receiver_account IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3)")
def filter_account_table(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("account_id"))
    return src.selected(_tx(spark, d), accounts=ids)


@_query(f"WITH {TX} SELECT {CANON} FROM tx WHERE timestamp >= TIMESTAMP '2024-01-10' ORDER BY ord LIMIT 100")
def filter_limit(spark: SparkSession, d: str) -> DataFrame:
    return src.selected(_tx(spark, d), "2024-01-10 00:00:00", max_rows=100)


@_query(f"WITH {EV} SELECT account_id, party, bank, ord, o AS out, i AS inc, oa::DOUBLE AS out_amount, ia::DOUBLE AS in_amount FROM ev")
def events_union(spark: SparkSession, d: str) -> DataFrame:
    return fe.account_events(_tx(spark, d)).select("account_id", "party", "bank", "ord", "out", "inc", "out_amount", "in_amount")


@_query(f"""WITH {EV} SELECT account_id, count(*) AS transaction_count, sum(o)::BIGINT AS outgoing_count, sum(i)::BIGINT AS incoming_count, round(sum(oa::DECIMAL(28,6))::DOUBLE, 4) AS total_outgoing_amount, round(sum(ia::DECIMAL(28,6))::DOUBLE, 4) AS total_incoming_amount,
  greatest(max(oa), 0)::DOUBLE AS max_outgoing_amount, greatest(max(ia), 0)::DOUBLE AS max_incoming_amount FROM ev GROUP BY account_id""")
def agg_counts_amounts(spark: SparkSession, d: str) -> DataFrame:
    f = fe.counts_and_amounts(fe.account_events(_tx(spark, d)), "none")
    return f.select("account_id", "transaction_count", "outgoing_count", "incoming_count", _r("total_outgoing_amount"), _r("total_incoming_amount"), "max_outgoing_amount", "max_incoming_amount")


@_query(f"""WITH {EV} SELECT account_id, sum(low)::BIGINT AS low_value_outgoing_count, round(sum(CASE WHEN low = 1 THEN oa ELSE 0 END::DECIMAL(28,6))::DOUBLE, 4) AS low_value_outgoing_amount, sum(near)::BIGINT AS near_threshold_outgoing_count,
  round(sum(CASE WHEN near = 1 THEN oa ELSE 0 END::DECIMAL(28,6))::DOUBLE, 4)::DOUBLE AS near_threshold_outgoing_value, sum(round_)::BIGINT AS round_amount_count, sum(cross_bank::INT)::BIGINT AS cross_bank_transaction_count, sum(self)::BIGINT AS self_transfer_count FROM ev GROUP BY account_id""")
def agg_flags(spark: SparkSession, d: str) -> DataFrame:
    f = fe.counts_and_amounts(fe.account_events(_tx(spark, d)), "none")
    return f.select("account_id", "low_value_outgoing_count", _r("low_value_outgoing_amount"), "near_threshold_outgoing_count", _r("near_threshold_outgoing_value"), "round_amount_count", "cross_bank_transaction_count", "self_transfer_count")


@_query(f"WITH {EV} SELECT account_id, coalesce(median(oa) FILTER (o = 1), 0)::DOUBLE AS median_outgoing_amount, coalesce(median(ia) FILTER (i = 1), 0)::DOUBLE AS median_incoming_amount FROM ev GROUP BY account_id")
def agg_median(spark: SparkSession, d: str) -> DataFrame:
    return fe.counts_and_amounts(fe.account_events(_tx(spark, d))).select("account_id", "median_outgoing_amount", "median_incoming_amount")


@_query(f"""WITH {EV} SELECT account_id, count(DISTINCT party) FILTER (o = 1 AND party <> account_id) AS unique_outgoing_counterparties, count(DISTINCT party) FILTER (i = 1 AND party <> account_id) AS unique_incoming_counterparties,
  count(DISTINCT party) FILTER (party <> account_id) AS unique_counterparties FROM ev GROUP BY account_id""")
def agg_distinct_counterparties(spark: SparkSession, d: str) -> DataFrame:
    return fe.distinct_counts(fe.account_events(_tx(spark, d))).select("account_id", "unique_outgoing_counterparties", "unique_incoming_counterparties", "unique_counterparties")


@_query(f"WITH {EV} SELECT account_id, count(DISTINCT bank) FILTER (o = 1) AS unique_outgoing_banks, count(DISTINCT bank) FILTER (i = 1) AS unique_incoming_banks FROM ev GROUP BY account_id")
def agg_distinct_banks(spark: SparkSession, d: str) -> DataFrame:
    return fe.distinct_counts(fe.account_events(_tx(spark, d))).select("account_id", "unique_outgoing_banks", "unique_incoming_banks")


@_query(f"WITH {EV} SELECT account_id, count(DISTINCT format) AS payment_format_count, count(DISTINCT paid_in) AS payment_currency_count, count(DISTINCT got_in) AS receiving_currency_count FROM ev GROUP BY account_id")
def agg_categorical(spark: SparkSession, d: str) -> DataFrame:
    return fe.distinct_counts(fe.account_events(_tx(spark, d))).select("account_id", "payment_format_count", "payment_currency_count", "receiving_currency_count")


BUCKETS = f"""h AS (SELECT account_id, t // {HOUR} AS h, count(*) AS n FROM ev GROUP BY ALL), hh AS (SELECT account_id, count(*) AS active_hours, max(n) AS max_transactions_in_hour FROM h GROUP BY account_id),
dd AS (SELECT account_id, count(*) AS active_days, max(n) AS max_transactions_in_day FROM (SELECT account_id, t // {DAY} AS dy, count(*) AS n FROM ev GROUP BY ALL) GROUP BY account_id)"""
GAPS = """ga AS (SELECT account_id, t - lag(t) OVER (PARTITION BY account_id ORDER BY t, ord) AS gap FROM ev),
gg AS (SELECT account_id, sum(gap)::BIGINT AS gap_micros, count(*) AS gap_count, count(*) FILTER (gap <= 3600000000) AS rapid_gap_count FROM ga WHERE gap > 0 GROUP BY account_id)"""


@_query(f"WITH {EV}, {BUCKETS} SELECT account_id, active_hours, active_days, max_transactions_in_hour, max_transactions_in_day FROM hh JOIN dd USING (account_id)")
def agg_buckets(spark: SparkSession, d: str) -> DataFrame:
    f = fe.bucket_counts(fe.account_events(_tx(spark, d)))
    return f.select("account_id", "active_hours", "active_days", "max_transactions_in_hour", F.col("max_transactions_in_day").cast("long"))


@_query(f"WITH {EV}, {GAPS} SELECT * FROM gg")
def agg_gaps(spark: SparkSession, d: str) -> DataFrame:
    return fe.gaps(fe.account_events(_tx(spark, d)))


ACCOUNTS = "ac AS (SELECT CAST(c_custkey AS VARCHAR) AS account_id, 'Bank ' || c_nationkey AS bank_name, CAST(c_custkey % 10 AS VARCHAR) AS bank_id, 'E' || c_nationkey AS entity_id, c_name AS entity_name FROM customer)"
FEATURES = f"""WITH {EV}, {BUCKETS}, {GAPS}, {ACCOUNTS},
base AS (SELECT account_id, count(*) AS transaction_count, sum(o)::BIGINT AS outgoing_count, sum(i)::BIGINT AS incoming_count, sum(oa::DECIMAL(28,6))::DOUBLE AS oa, sum(ia::DECIMAL(28,6))::DOUBLE AS ia, coalesce(median(oa) FILTER (o = 1), 0)::DOUBLE AS mo, coalesce(median(ia) FILTER (i = 1), 0)::DOUBLE AS mi,
  greatest(max(oa), 0)::DOUBLE AS max_outgoing_amount, greatest(max(ia), 0)::DOUBLE AS max_incoming_amount, count(DISTINCT party) FILTER (o = 1 AND party <> account_id) AS uo, count(DISTINCT party) FILTER (i = 1 AND party <> account_id) AS ui,
  count(DISTINCT party) FILTER (party <> account_id) AS unique_counterparties, count(DISTINCT bank) FILTER (o = 1) AS unique_outgoing_banks, count(DISTINCT bank) FILTER (i = 1) AS unique_incoming_banks,
  count(DISTINCT format) AS payment_format_count, count(DISTINCT paid_in) AS payment_currency_count, count(DISTINCT got_in) AS receiving_currency_count, sum(low)::BIGINT AS low_value_outgoing_count, sum(CASE WHEN low = 1 THEN oa ELSE 0 END::DECIMAL(28,6))::DOUBLE AS lv,
  sum(near)::BIGINT AS near_threshold_outgoing_count, sum(CASE WHEN near = 1 THEN oa ELSE 0 END::DECIMAL(28,6))::DOUBLE AS nv, sum(round_)::BIGINT AS round_amount_count, sum(cross_bank::INT)::BIGINT AS cross_bank_transaction_count, sum(self)::BIGINT AS self_transfer_count FROM ev GROUP BY account_id),
f AS (SELECT b.account_id, transaction_count, outgoing_count, incoming_count, round(oa, 4)::DOUBLE AS total_outgoing_amount, round(ia, 4)::DOUBLE AS total_incoming_amount, round(CASE WHEN outgoing_count > 0 THEN oa / outgoing_count ELSE 0 END, 4)::DOUBLE AS mean_outgoing_amount,
  round(CASE WHEN incoming_count > 0 THEN ia / incoming_count ELSE 0 END, 4)::DOUBLE AS mean_incoming_amount, round(mo, 4) AS median_outgoing_amount, round(mi, 4) AS median_incoming_amount, max_outgoing_amount, max_incoming_amount, uo AS unique_outgoing_counterparties, ui AS unique_incoming_counterparties,
  unique_counterparties, unique_outgoing_banks, unique_incoming_banks, round(CASE WHEN outgoing_count > 0 THEN uo / outgoing_count ELSE 0 END, 4) AS fan_out_ratio, round(CASE WHEN incoming_count > 0 THEN ui / incoming_count ELSE 0 END, 4) AS fan_in_ratio, active_hours, active_days, max_transactions_in_hour, max_transactions_in_day,
  round(transaction_count / active_days, 4) AS average_transactions_per_active_day, round(transaction_count / active_hours, 4) AS transactions_per_active_hour, round(coalesce(gap_micros / gap_count / 60e6, -1), 4) AS mean_time_between_transactions_minutes,
  payment_format_count, payment_currency_count, receiving_currency_count, low_value_outgoing_count, round(lv, 4)::DOUBLE AS low_value_outgoing_amount, near_threshold_outgoing_count, round(nv, 4)::DOUBLE AS near_threshold_outgoing_value, round_amount_count, cross_bank_transaction_count, self_transfer_count,
  coalesce(rapid_gap_count, 0) AS rapid_gap_count, round(coalesce(rapid_gap_count, 0) / greatest(transaction_count - 1, 1), 4) AS rapid_gap_ratio, bank_name, bank_id, entity_id, entity_name
  FROM base b JOIN hh USING (account_id) JOIN dd USING (account_id) LEFT JOIN gg USING (account_id) LEFT JOIN ac USING (account_id))"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    return fe.features(_tx(spark, d), src.first_per_account(src.accounts_from_customers(spark, d)))


@_query(f"{FEATURES} SELECT * FROM f")
def features_full(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).withColumn("mean_time_between_transactions_minutes", F.nanvl("mean_time_between_transactions_minutes", F.lit(-1.0)))
    exact = ("max_outgoing_amount", "max_incoming_amount")
    return f.select(*(_r(c) if kind == "double" and c not in exact else F.col(c) for c, kind in f.dtypes))


@_query(f"WITH {EV} SELECT account_id, count(*) AS event_count, sum(is_laundering)::BIGINT AS laundering_event_count, round(sum(is_laundering) / count(*), 6) AS laundering_event_rate, sum(is_laundering) > 0 AS has_laundering_label FROM ev GROUP BY account_id")
def labels(spark: SparkSession, d: str) -> DataFrame:
    f = fe.label_counts(fe.account_events(_tx(spark, d)))
    return f.select("account_id", "event_count", "laundering_event_count", _r("laundering_event_rate", 6), "has_laundering_label")


@_query(f"WITH {ACCOUNTS} SELECT bank_name, bank_id, account_id AS account_number, entity_id, entity_name FROM ac")
def account_metadata_dedup(spark: SparkSession, d: str) -> DataFrame:
    return src.first_per_account(src.accounts_from_customers(spark, d))


@_query(f"WITH {EV}, {ACCOUNTS} SELECT account_id, n AS transaction_count, bank_name, entity_name FROM (SELECT account_id, count(*) AS n FROM ev GROUP BY account_id) LEFT JOIN ac USING (account_id)")
def features_left_join(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("account_id", "transaction_count", "bank_name", "entity_name")


def _fan_sql(account: str, party: str, amount: str, least: int = 5, hours: int = 24, count: int = 5) -> str:
    return f"""WITH {TX}, w AS (SELECT {account} AS account, t, ord, list({party}) OVER x AS l FROM tx WINDOW x AS (PARTITION BY {account} ORDER BY t RANGE BETWEEN {hours * HOUR} PRECEDING AND CURRENT ROW)),
c AS (SELECT account, t, len(list_distinct(l)) AS d, len(l) AS n FROM w WHERE len(list_distinct(l)) >= {least} AND len(l) >= {count}),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY account ORDER BY d DESC, n DESC, t) = 1),
s AS (SELECT b.account, b.d, tx.ord, tx.timestamp, tx.t, tx.{party} AS party, tx.{amount} AS amount FROM b JOIN tx ON tx.{account} = b.account AND tx.t BETWEEN b.t - {hours * HOUR} AND b.t),
u AS (SELECT account, party, min((t, ord)) AS o FROM s GROUP BY ALL), l AS (SELECT account, array_to_string(list(party ORDER BY o)[:20], ',') AS parties FROM u GROUP BY account),
r AS (SELECT account, array_to_string(list('row-' || ord ORDER BY t, ord)[:20], ',') AS refs FROM s GROUP BY account),
e AS (SELECT account, d, count(*) AS n, sum(amount::DECIMAL(28,6))::DOUBLE AS amount, min(timestamp) AS start_time, max(timestamp) AS end_time FROM s GROUP BY account, d)"""


_FAN = """ SELECT account AS primary_account_id, parties AS involved, start_time, end_time, n AS transaction_count, round(amount, 4) AS total_amount, least(1.0, d / 5.0)::DOUBLE AS evidence_strength,
  CASE WHEN d / 5.0 >= 2 THEN 'high' WHEN d / 5.0 >= 1.25 THEN 'medium' ELSE 'low' END AS severity, refs FROM e JOIN l USING (account) JOIN r USING (account)"""


def _evidence(df: DataFrame, refs: bool = True) -> DataFrame:
    cols = ["primary_account_id", F.array_join("involved_account_ids", ",").alias("involved"), "start_time", "end_time", "transaction_count", _r("total_amount"), "evidence_strength", "severity"]
    return df.select(*cols, *([F.array_join("transaction_references", ",").alias("refs")] if refs else []))


@_query(_fan_sql("sender_account", "receiver_account", "amount_paid") + _FAN)
def fan_out_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(fan_out(_tx(spark, d)))


@_query(_fan_sql("receiver_account", "sender_account", "amount_received") + _FAN)
def fan_in_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(fan_in(_tx(spark, d)))


@_query(_fan_sql("sender_account", "receiver_account", "amount_paid") + " SELECT account, party, ord, timestamp, amount FROM s")
def fan_out_slice(spark: SparkSession, d: str) -> DataFrame:
    return slices(_tx(spark, d), True).select("account", "party", "ord", "timestamp", "amount")


def _velocity_sql(peak: int, rapid: int, rate: float) -> str:
    return f"""{FEATURES}, v AS (SELECT account_id, entity_id, transaction_count, total_outgoing_amount + total_incoming_amount AS amount, greatest(max_transactions_in_hour / {peak}, rapid_gap_count / {rapid}, (transaction_count / active_hours) / {rate}) AS ratio FROM f
  WHERE max_transactions_in_hour >= {peak} OR rapid_gap_count >= {rapid} OR transaction_count / active_hours >= {rate})
SELECT account_id AS primary_account_id, transaction_count, round(amount, 2) AS total_amount, round(least(1.0, ratio), 6)::DOUBLE AS evidence_strength, CASE WHEN ratio >= 1.75 THEN 'high' WHEN ratio >= 1.25 THEN 'medium' ELSE 'low' END AS severity, coalesce(entity_id, '') AS entities FROM v"""


def _velocity(df: DataFrame) -> DataFrame:
    return df.select("primary_account_id", "transaction_count", _r("total_amount", 2), _r("evidence_strength", 6), "severity", F.array_join("entity_ids", ",").alias("entities"))


@_query(_velocity_sql(10, 5, 5.0))
def velocity_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _velocity(velocity(_features(spark, d)))


@_query(_velocity_sql(3, 20, 1.5))
def velocity_low_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _velocity(velocity(_features(spark, d), 3, 20, 1.5))


def _ref(x: str) -> str:
    return f"strftime({x}.timestamp, '%Y-%m-%d %H:%M:%S') || '|' || {x}.sender_account || '|' || {x}.receiver_account"


_GS = f"""WITH {TX}, fs AS (SELECT receiver_account AS account, sender_account AS party, min((t, ord)) AS s FROM tx GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY s) AS r FROM fs),
e AS (SELECT account, min(s[1]) AS t0, max(s) AS s1 FROM k WHERE r <= 3 GROUP BY account HAVING count(*) = 3),
g AS (SELECT e.account, 0 AS phase, tx.timestamp, tx.t, tx.ord, tx.amount_received AS amount, tx.sender_account AS party, {_ref("tx")} AS ref FROM e JOIN tx ON tx.receiver_account = e.account AND (tx.t, tx.ord) <= e.s1),
s AS (SELECT e.account, 1 AS phase, tx.timestamp, tx.t, tx.ord, tx.amount_paid AS amount, tx.receiver_account AS party, {_ref("tx")} AS ref FROM e JOIN tx ON tx.sender_account = e.account AND tx.t > e.s1[1] AND tx.t <= e.t0 + {DAY}),
a AS (SELECT * FROM g WHERE account IN (SELECT account FROM s) UNION ALL SELECT * FROM s),
p AS (SELECT account, phase, party, min((t, ord)) AS o FROM a GROUP BY ALL), l AS (SELECT account, phase, list(party ORDER BY o)[:20] AS ps FROM p GROUP BY ALL),
b AS (SELECT account, count(*) AS n, sum(amount::DECIMAL(28,6))::DOUBLE AS amount, min(timestamp) AS start_time, max(timestamp) AS end_time, array_to_string(list(ref ORDER BY t, phase, ord), ',') AS refs FROM a GROUP BY account),
i AS (SELECT x.account, list_concat([x.account], x.ps, y.ps) AS v, len(x.ps) AS ni, len(y.ps) AS no FROM l x JOIN l y ON x.account = y.account AND x.phase = 0 AND y.phase = 1),
j AS (SELECT account, list(v1 ORDER BY o)[:20] AS v FROM (SELECT account, v1, min(o) AS o FROM (SELECT account, unnest(v) AS v1, generate_subscripts(v, 1) AS o FROM i) GROUP BY ALL) GROUP BY account)
SELECT b.account AS primary_account_id, array_to_string(j.v, ',') AS involved, start_time, end_time, n AS transaction_count, round(amount, 4) AS total_amount, 1.0::DOUBLE AS evidence_strength,
  CASE WHEN greatest(ni / 3.0, no / 1.0) >= 2 THEN 'high' WHEN greatest(ni / 3.0, no / 1.0) >= 1.25 THEN 'medium' ELSE 'low' END AS severity, refs FROM b JOIN i USING (account) JOIN j USING (account)"""


@_query(_GS)
def gather_scatter_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(gather_scatter(_tx(spark, d)))


def _sg_sql(hours: int) -> str:
    return f"""WITH {TX}, fs AS (SELECT sender_account AS account, receiver_account AS party, min((t, ord)) AS s FROM tx GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY s) AS r FROM fs),
e AS (SELECT account, min(s[1]) AS t0, max(s) AS s1 FROM k WHERE r <= 2 GROUP BY account HAVING count(*) = 2),
q AS (SELECT e.account, k.party AS via, k.s[1] AS met, k.r, e.t0 + {hours * HOUR} AS until FROM e JOIN k USING (account) WHERE k.r <= 2),
d AS (SELECT q.account, q.via, tx.receiver_account AS dest, min((tx.t, tx.ord)) AS f FROM q JOIN tx ON tx.sender_account = q.via AND tx.t > q.met AND tx.t <= q.until
  WHERE tx.receiver_account <> q.account AND NOT EXISTS (SELECT 1 FROM q z WHERE z.account = q.account AND z.via = tx.receiver_account) GROUP BY ALL),
c AS (SELECT account, dest, max(f[1]) AS latest FROM d GROUP BY ALL HAVING count(*) = 2), m AS (SELECT account, arg_min(dest, (latest, dest)) AS dest FROM c GROUP BY account),
a AS (SELECT m.account, m.dest, tx.timestamp, tx.t, tx.ord, 0 AS phase, tx.amount_paid AS amount, {_ref("tx")} AS ref FROM m JOIN e USING (account) JOIN tx ON tx.sender_account = m.account AND (tx.t, tx.ord) <= e.s1
  UNION ALL SELECT m.account, m.dest, tx.timestamp, tx.t, tx.ord, 1, tx.amount_paid, {_ref("tx")} FROM m JOIN d ON d.account = m.account AND d.dest = m.dest JOIN tx ON tx.ord = d.f[2]),
v AS (SELECT account, list(via ORDER BY r) AS vs FROM q GROUP BY account)
SELECT a.account AS primary_account_id, array_to_string(list_concat(list_concat(CASE WHEN list_contains(any_value(vs), a.account) THEN [] ELSE [a.account] END, any_value(vs)), [a.dest]), ',') AS involved, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS transaction_count,
  round(sum(amount::DECIMAL(28,6))::DOUBLE, 4) AS total_amount, 1.0::DOUBLE AS evidence_strength, 'low' AS severity, array_to_string(list(ref ORDER BY t, phase, ord), ',') AS refs FROM a JOIN v USING (account) GROUP BY a.account, a.dest"""


def _sg(df: DataFrame) -> DataFrame:
    """The primary account is listed first unless it is an intermediary too."""
    vias = F.from_json(F.get_json_object("metadata", "$.intermediate_accounts"), "array<string>")
    rest = F.concat(vias, F.array(F.get_json_object("metadata", "$.common_destination")))
    own = F.when(F.array_contains(vias, F.col("primary_account_id")), rest).otherwise(F.concat(F.array("primary_account_id"), rest))
    return _evidence(df.withColumn("involved_account_ids", own))


@_query(_sg_sql(24))
def scatter_gather_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _sg(scatter_gather(_tx(spark, d)))


@_query(_sg_sql(7 * 24))
def scatter_gather_7d(spark: SparkSession, d: str) -> DataFrame:
    return _sg(scatter_gather(_tx(spark, d), 2, 7 * 24))


def _cycle_sql(least: int, most: int) -> str:
    return f"""WITH RECURSIVE {TX}, ed AS (SELECT sender_account AS s, receiver_account AS r, t, ord, timestamp, amount_paid AS amount, {_ref("tx")} AS ref FROM tx WHERE sender_account <> receiver_account AND receiver_account IN (SELECT sender_account FROM tx)),
p AS (SELECT s AS start, r AS cur, t AS t0, t AS t1, [s, r] AS acc, [(t, ord)] AS pl, 1 AS hops, amount, timestamp AS start_time, timestamp AS end_time, ref AS refs FROM ed
  UNION ALL SELECT p.start, ed.r, p.t0, ed.t, list_append(p.acc, ed.r), list_append(p.pl, (ed.t, ed.ord)), p.hops + 1, p.amount + ed.amount, p.start_time, ed.timestamp, p.refs || ',' || ed.ref
    FROM p JOIN ed ON ed.s = p.cur AND ed.t > p.t1 AND ed.t - p.t0 <= {DAY} WHERE p.hops < {most} AND p.cur <> p.start AND (ed.r = p.start OR NOT list_contains(p.acc, ed.r))),
c AS (SELECT *, acc[:-2] AS cyc FROM p WHERE cur = start AND hops >= {least}),
z AS (SELECT *, list_concat(cyc[list_position(cyc, list_min(cyc)):], cyc[:list_position(cyc, list_min(cyc)) - 1]) AS key FROM c),
o AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY pl) = 1)
SELECT start AS primary_account_id, array_to_string(cyc, ',') AS involved, start_time, end_time, hops::BIGINT AS transaction_count, round(amount, 4) AS total_amount, 1.0::DOUBLE AS evidence_strength,
  CASE WHEN hops / {least}.0 >= 2 THEN 'high' WHEN hops / {least}.0 >= 1.25 THEN 'medium' ELSE 'low' END AS severity, refs FROM o"""


@_query(_cycle_sql(3, 4))
def cycle_3_4(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(cycles(_tx(spark, d), 3, 4))


@_query(_cycle_sql(3, 6))
def cycle_3_6(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(cycles(_tx(spark, d), 3, 6))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Fan-out and fan-in evidence with references in one namespace, so that they can overlap; some of it twice."""
    tx = _tx(spark, d).withColumn("transaction_reference", F.concat(F.lit("T"), F.col("ord").cast("string")))
    out, into = written(fan_out(tx), "fan_out"), fan_in(tx)
    return union(out, into, out.where(F.col("primary_account_id").cast("long") % 2 == 0))


def _part(name: str, account: str, party: str, amount: str, detector: str, kind: str) -> str:
    body = _fan_sql(account, party, amount).split(f"{TX}, ", 1)[1]
    for x in ("w", "c", "b", "s", "u", "l", "r", "e"):
        body = body.replace(f"\n{x} AS (", f"\n{name}_{x} AS (").replace(f", {x} AS (", f", {name}_{x} AS (").replace(f"FROM {x} ", f"FROM {name}_{x} ").replace(f"FROM {x})", f"FROM {name}_{x})")
    body = body.replace("w AS (", f"{name}_w AS (", 1) if body.startswith("w AS (") else body
    body = body.replace("SELECT b.account, b.d", "SELECT b.account, b.d").replace(f"FROM {name}_b JOIN tx", f"FROM {name}_b b JOIN tx").replace("'row-' || ord", "'T' || ord")
    return f"""{body},
{name} AS (SELECT e.account, '{detector}' AS detector, '{kind}' AS kind, n, amount, start_time, end_time, string_split(refs, ',') AS refs, string_split(parties, ',') AS parties, least(1.0, d / 5.0) AS strength,
  CASE WHEN d / 5.0 >= 2 THEN 'high' WHEN d / 5.0 >= 1.25 THEN 'medium' ELSE 'low' END AS severity FROM {name}_e e JOIN {name}_l USING (account) JOIN {name}_r USING (account))"""


ASSESS = f"""WITH {TX}, {_part("fo", "sender_account", "receiver_account", "amount_paid", "fan_out_detector", "FAN-OUT")},
{_part("fi", "receiver_account", "sender_account", "amount_received", "fan_in_detector", "FAN-IN")},
al AS (SELECT *, 1 + (detector = 'fan_out_detector' AND CAST(account AS BIGINT) % 2 = 0)::INT AS repeats FROM (SELECT * FROM fo UNION ALL SELECT * FROM fi)),
od AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY detector) AS place FROM al),
rf AS (SELECT account, place, ref, place = min(place) OVER (PARTITION BY account, ref) AS new FROM (SELECT account, place, unnest(refs) AS ref FROM od)),
sh AS (SELECT account, place, avg(new::INT) AS share, sum(new::INT)::BIGINT AS fresh FROM rf GROUP BY ALL),
ap AS (SELECT od.*, sh.share, sh.fresh FROM od JOIN sh USING (account, place)),
agg AS (SELECT account, count(*) AS evidence_count, array_to_string(list(kind ORDER BY place), '|') AS typologies, min(start_time) AS start_time, max(end_time) AS end_time, sum(amount * share) AS amount, round_even(sum(n * share), 0)::BIGINT AS transactions,
  sum(repeats)::BIGINT AS raw, sum(fresh)::BIGINT AS refs, sum(strength * greatest(n, 1)) / sum(greatest(n, 1)) AS strength, max(CASE severity WHEN 'high' THEN 16.0 WHEN 'medium' THEN 10.0 ELSE 4.0 END)::DOUBLE AS sev, count(DISTINCT kind) AS kinds FROM ap GROUP BY account),
sc AS (SELECT *, round(32 * strength, 4) AS s1, sev AS s2, least(16.0, 4.0 * kinds)::DOUBLE AS s3, CASE WHEN evidence_count <= 1 THEN 0.0 ELSE least(16.0, 5.0 * (evidence_count - 1)) END::DOUBLE AS s4,
  round(least(16.0, least(8.0, 8 * ln(1 + transactions) / ln(26)) + least(8.0, 8 * ln(1 + amount / 10000) / ln(101))), 4) AS s5 FROM agg),
fin AS (SELECT *, round(least(greatest(s1 + s2 + s3 + s4 + s5, 0), 100), 4) AS score FROM sc)"""
_LEVEL = "CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scored(aggregate(_both(spark, d)))


@_query(f"{ASSESS} SELECT account AS primary_account_id, detector AS detector_name, kind AS typology, n AS transaction_count, round(amount, 4) AS total_amount, repeats::BIGINT AS repeats FROM al")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    return ordered(_both(spark, d)).select("primary_account_id", "detector_name", "typology", "transaction_count", _r("total_amount"), "repeats")


@_query(f"{ASSESS} SELECT account AS primary_account_id, place::INTEGER AS place, round(share, 6) AS share, fresh FROM ap")
def apportion_refs(spark: SparkSession, d: str) -> DataFrame:
    return apportioned(written(ordered(_both(spark, d)), "ordered")).select("primary_account_id", "place", _r("share", 6), F.size("fresh").cast("long").alias("fresh"))


@_query(f"{ASSESS} SELECT account AS primary_account_id, evidence_count, typologies, start_time AS assessment_start_time, end_time AS assessment_end_time, round(amount, 4) AS total_suspicious_amount, transactions AS total_suspicious_transactions, raw AS raw_evidence_count, refs AS unique_transaction_reference_count FROM agg")
def aggregate_assessment(spark: SparkSession, d: str) -> DataFrame:
    a = aggregate(_both(spark, d))
    return a.select("primary_account_id", "evidence_count", F.array_join("typologies_detected", "|").alias("typologies"), "assessment_start_time", "assessment_end_time", _r("total_suspicious_amount"), "total_suspicious_transactions", "metadata.raw_evidence_count", "metadata.unique_transaction_reference_count")


@_query(f"{ASSESS} SELECT account AS primary_account_id, round(s1, 3) AS strength, s2 AS severity, s3 AS diversity, s4 AS repetition, round(s5, 3) AS magnitude, round(score, 3) AS score FROM fin")
def score_components(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("score_breakdown")
    return _scored(spark, d).select("primary_account_id", _r(b["evidence_strength_score"], 3).alias("strength"), b["severity_score"].alias("severity"), b["typology_diversity_score"].alias("diversity"), b["repeated_evidence_score"].alias("repetition"), _r(b["activity_magnitude_score"], 3).alias("magnitude"), _r(F.col("risk_score"), 3).alias("score"))


@_query(f"{ASSESS} SELECT {_LEVEL} AS risk_level, count(*) AS accounts FROM fin GROUP BY ALL")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("risk_level").agg(F.count("*").alias("accounts"))


@_query("WITH s AS (SELECT c_custkey, c_acctbal / 100 AS score FROM customer) SELECT c_custkey, " + _LEVEL + " AS risk_level FROM s")
def level_boundaries(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", level(F.col("c_acctbal") / 100).alias("risk_level"))


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 <> 0 THEN '.' || lpad((epoch_us({0}) % 1000000)::VARCHAR, 6, '0') ELSE '' END"


@_query(f"{ASSESS} SELECT account AS primary_account_id, 'IR-' || account || '-' || upper(substr(sha1(account || '::' || {_ISO.format('start_time')} || '::' || {_ISO.format('end_time')} || '::' || printf('%.4f', score) || '::' || array_to_string(list_sort(string_split(typologies, '|')), '|')), 1, 10)) AS report_id, {_LEVEL} AS risk_level, evidence_count, transactions AS suspicious_transaction_count FROM fin")
def report_header(spark: SparkSession, d: str) -> DataFrame:
    return reports(_scored(spark, d)).select("primary_account_id", "report_id", "risk_level", "evidence_count", "suspicious_transaction_count")


@_query(f"{ASSESS} SELECT account AS primary_account_id, row_number() OVER (PARTITION BY account ORDER BY start_time, end_time, kind, detector)::INTEGER AS step, start_time AS timestamp, end_time, kind AS typology, detector, n AS transaction_count, round(amount, 4) AS amount FROM al")
def report_timeline(spark: SparkSession, d: str) -> DataFrame:
    return timeline_rows(reports(_scored(spark, d))).drop("description").withColumn("amount", _r(F.col("amount")))


@_query(f"{ASSESS} SELECT account AS primary_account_id, (1 + (kinds > 1)::INT + (evidence_count > 1)::INT + 1 + 1)::INTEGER AS findings, CASE WHEN score >= 75 THEN 5 WHEN score >= 50 THEN 4 WHEN score >= 25 THEN 3 ELSE 2 END::INTEGER AS actions, least(evidence_count, 8)::INTEGER AS summaries FROM fin")
def report_findings(spark: SparkSession, d: str) -> DataFrame:
    r = reports(_scored(spark, d))
    return r.select("primary_account_id", F.size("key_findings").alias("findings"), F.size("recommended_actions").alias("actions"), F.size("evidence_summary").alias("summaries"))


@_query("SELECT event_id, '$' || format('{:,.2f}', value) AS full_text, CASE WHEN abs(value * 1000) >= 1e6 THEN '$' || format('{:,.1f}', value * 1000 / 1e6) || 'M' WHEN abs(value * 1000) >= 1e3 THEN '$' || format('{:,.1f}', value * 1000 / 1e3) || 'K' ELSE '$' || format('{:,.2f}', value * 1000) END AS compact, " + _ISO.format("ts") + " AS iso FROM events")
def formatting(spark: SparkSession, d: str) -> DataFrame:
    from flowlattice.functions.columns import iso

    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", money(F.col("value")).alias("full_text"), money(F.col("value") * 1000, True).alias("compact"), iso(F.col("ts")).alias("iso"))


_PATTERN = f"""WITH {TX}, n AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS i, * FROM tx), g AS (SELECT i // 7 AS g, count(*) AS c FROM n GROUP BY ALL)
SELECT (g + 1)::BIGINT AS attempt_id, CASE WHEN g % 2 = 0 THEN 'FAN-OUT' ELSE 'GATHER-SCATTER' END AS typology, 'Max ' || g || '-degree Fan-Out' AS description, c::INTEGER AS transactions FROM g WHERE g % 5 <> 4"""


@_query(_PATTERN)
def pattern_parse(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of seven events each, written as annotation lines; every fifth is never ended."""
    tx = src.numbered(_tx(spark, d), "ord", "i").withColumn("g", F.floor(F.col("i") / 7)).withColumn("first", F.col("i") % 7 == 0)
    row = F.concat_ws(",", F.date_format("timestamp", "yyyy/MM/dd HH:mm"), "from_bank", "sender_account", "to_bank", "receiver_account", F.col("amount_received").cast("string"), "receiving_currency", F.col("amount_paid").cast("string"), "payment_currency", F.concat(F.lit('"'), "payment_format", F.lit('"')), F.col("is_laundering").cast("string"))
    kind = F.when(F.col("g") % 2 == 0, "FAN-OUT").otherwise("GATHER scatter".upper())
    head = F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), kind, F.lit(":  Max "), F.col("g").cast("string"), F.lit("-degree Fan-Out"))
    tail = F.concat(F.lit("END LAUNDERING ATTEMPT - "), kind)
    split = F.shiftleft(F.floor(F.col("g") / 16_384).cast("long"), SPLIT)  # as if a file's split had so many attempts
    line = lambda value, k: F.struct(value.alias("value"), (split + F.col("g") % 16_384 * 100 + k).alias("line"))
    own = F.array(line(row, 1 + F.col("i") % 7), F.when(F.col("first"), line(head, F.lit(0))), F.when(F.col("first") & (F.col("g") % 5 != 4), line(tail, F.lit(99))))
    lines = tx.select(F.explode(own).alias("l")).where("l is not null").select("l.*", F.lit("events").alias("file"))
    return attempts(lines).select(F.col("attempt_id").cast("long").alias("attempt_id"), "typology", "description", F.size("transactions").alias("transactions"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Fan-out evidence, assessed and scored."""
    a = scored(aggregate(fan_out(_tx(spark, d))))
    return a.select("primary_account_id", "risk_score", "risk_level", "evidence_count", F.array_join("typologies_detected", "|").alias("typologies"), one_place(F.col("risk_score")).alias("score_text"))


def _more() -> None:
    """These modules register their queries when they are imported."""
    import flowlattice.plans.pattern_queries
    import flowlattice.plans.source_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _more()

    return {k: f for k, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    _more()
    return {k: sql for k, (_, sql) in _registry.items() if sql}
