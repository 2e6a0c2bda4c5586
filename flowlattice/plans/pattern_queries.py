"""Registered queries of features kept between runs, medians that merge, and further patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.functions.materialise import shared_dir, written
from flowlattice.operators import feature_state
from flowlattice.operators import features as fe
from flowlattice.operators.anomaly import anomaly_scores
from flowlattice.operators.deviation import deviations
from flowlattice.operators.sketched_median import RANK_ERROR, exact_by_sketches
from flowlattice.operators.smurfing import smurfing
from flowlattice.operators.structuring import structuring
from flowlattice.plans.queries import DAY, EV, FEATURES, HOUR, TX, _features, _query, _r, _ref, _tx
from flowlattice.sources import transactions as src
from flowlattice.sources.feature_store import FeatureStore

# ---- features


@_query(f"{FEATURES} SELECT * FROM f")
def features_kept_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Features of a store whose state three parts were merged into, one after the other."""
    store, tx = FeatureStore(spark, shared_dir(spark, "store")), _tx(spark, d)
    days = tx.select(F.to_date("timestamp").alias("day"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    cut = [first + (last - first) * k / 3 for k in (1, 2)]
    for lo, hi in zip([None, *cut], [*cut, None], strict=True):
        part = tx.where((F.lit(True) if lo is None else F.col("timestamp") >= F.lit(str(lo)).cast("timestamp_ntz")) & (F.lit(True) if hi is None else F.col("timestamp") < F.lit(str(hi)).cast("timestamp_ntz")))
        feature_state.advance(store, part)
    f = feature_state.features_of(feature_state.State(**store.load_state()), src.first_per_account(src.accounts_from_customers(spark, d)))
    f = f.withColumn("mean_time_between_transactions_minutes", F.nanvl("mean_time_between_transactions_minutes", F.lit(-1.0)))
    exact = ("max_outgoing_amount", "max_incoming_amount")
    return f.select(*(_r(c) if kind == "double" and c not in exact else F.col(c) for c, kind in f.dtypes))


_BUSY = f"""WITH {TX}, a AS (SELECT payment_format AS account_id, amount_paid AS x FROM tx UNION ALL SELECT 'bank ' || to_bank, amount_paid FROM tx)"""


@_query(f"{_BUSY} SELECT account_id, count(*) AS n, true AS within FROM a GROUP BY account_id")
def median_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Whether each median's rank is within twice the stated error; the accounts are few and so have very many amounts."""
    tx = _tx(spark, d)
    busy = tx.withColumn("sender_account", F.col("payment_format")).unionByName(tx.withColumn("sender_account", F.concat(F.lit("bank "), "to_bank")))
    e = fe.account_events(busy.withColumn("receiver_account", F.lit("x"))).where("out = 1")
    m = feature_state.sketched_medians(e).select("account_id", F.col("median_outgoing_amount").alias("m"))
    x = F.col("out_amount")
    ranks = e.join(F.broadcast(m), "account_id").groupBy("account_id").agg(F.count("*").alias("n"), F.count_if(x < F.col("m")).alias("below"), F.count_if(x > F.col("m")).alias("above"))
    most = (0.5 + 2 * RANK_ERROR) * F.col("n") + 1
    return ranks.select("account_id", "n", ((F.col("below") <= most) & (F.col("above") <= most)).alias("within"))


@_query(f"WITH {EV} SELECT account_id, coalesce(median(oa) FILTER (o = 1), 0)::DOUBLE AS median_outgoing_amount, coalesce(median(ia) FILTER (i = 1), 0)::DOUBLE AS median_incoming_amount FROM ev GROUP BY account_id")
def agg_median_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Medians by sketches, made exact among the amounts that the sketches point to."""
    return exact_by_sketches(fe.account_events(_tx(spark, d)))


# ---- patterns


_STRUCTURING = f"""WITH RECURSIVE {TX}, nr AS (SELECT sender_account AS account, timestamp, t, ord, amount_paid AS amount, round(amount_paid * 1e6)::BIGINT AS x FROM tx WHERE amount_paid >= 20 AND amount_paid < 100),
pl AS (SELECT *, row_number() OVER w AS place, (sum(x) OVER w)::BIGINT AS s FROM nr WINDOW w AS (PARTITION BY account ORDER BY t, ord)),
f AS (SELECT b.account, max(a.place) AS i, b.place AS e, max_by(a.t, a.place) AS ta, any_value(b.t) AS tb FROM pl a JOIN pl b ON a.account = b.account AND a.place <= b.place AND b.s - a.s + a.x >= 150000000 GROUP BY b.account, b.place),
g AS (SELECT account, i, e FROM f WHERE tb - ta <= {48 * HOUR}),
nx AS (SELECT a.account, a.e, min(b.e) AS nxt FROM g a JOIN g b ON a.account = b.account AND b.i > a.e GROUP BY ALL),
ch AS (SELECT account, min(e) AS e FROM g GROUP BY account UNION ALL SELECT ch.account, nx.nxt FROM ch JOIN nx USING (account, e)),
o AS (SELECT g.account, g.i, pl.* EXCLUDE (account) FROM ch JOIN g USING (account, e) JOIN pl ON pl.account = g.account AND pl.place BETWEEN g.i AND g.e)
SELECT account AS primary_account_id, count(DISTINCT i) AS windows, count(*) AS transaction_count, round(sum(amount::DECIMAL(28,6))::DOUBLE, 4) AS total_amount, min(timestamp) AS start_time, max(timestamp) AS end_time FROM o GROUP BY account HAVING count(DISTINCT i) >= 2"""


@_query(_STRUCTURING)
def structuring_windows(spark: SparkSession, d: str) -> DataFrame:
    e = structuring(_tx(spark, d), 100.0, 0.8, 150.0, 48, 2)
    return e.select("primary_account_id", F.get_json_object("metadata", "$.windows").cast("long").alias("windows"), "transaction_count", _r("total_amount"), "start_time", "end_time")


_ROUNDS = 24


def _core_sql(out: int, into: int, days: int, amount: float) -> str:
    rounds = "".join(f""",
s{k} AS (SELECT span, s FROM e{k - 1} GROUP BY ALL HAVING count(*) >= {out}), r{k} AS (SELECT span, r FROM e{k - 1} GROUP BY ALL HAVING count(*) >= {into}),
e{k} AS MATERIALIZED (SELECT e.* FROM e{k - 1} e JOIN s{k} USING (span, s) JOIN r{k} USING (span, r))""" for k in range(1, _ROUNDS + 1))  # fmt: skip
    return f"""WITH {TX}, p AS (SELECT t // {days * DAY} AS span, sender_account AS s, receiver_account AS r, timestamp, amount_paid AS amount FROM tx WHERE amount_paid < {amount} AND sender_account <> receiver_account),
e0 AS (SELECT DISTINCT span, s, r FROM p){rounds}, x AS (SELECT span, count(DISTINCT s) AS senders, count(DISTINCT r) AS receivers FROM e{_ROUNDS} GROUP BY span)
SELECT s AS primary_account_id, senders, receivers, count(*) AS transaction_count, round(sum(amount::DECIMAL(28,6))::DOUBLE, 4) AS total_amount, least(1.0, count(DISTINCT r) / {out})::DOUBLE AS evidence_strength, min(timestamp) AS start_time
FROM p JOIN e{_ROUNDS} USING (span, s, r) JOIN x USING (span) GROUP BY span, s, senders, receivers"""


@_query(_core_sql(3, 4, 3, 60.0))
def smurfing_cores(spark: SparkSession, d: str) -> DataFrame:
    """The SQL peels a fixed number of rounds, more than the tables need."""
    e = smurfing(_tx(spark, d), 60.0, 3, 4, 72)
    whole = lambda c: F.get_json_object("metadata", f"$.{c}").cast("long").alias(c)
    return e.select("primary_account_id", whole("senders"), whole("receivers"), "transaction_count", _r("total_amount"), "evidence_strength", "start_time")


_DEVIATION = f"""WITH {TX}, ro AS (SELECT sender_account AS account, t // {DAY} AS day, amount_paid AS amount FROM tx UNION ALL SELECT receiver_account, t // {DAY}, amount_paid FROM tx WHERE sender_account <> receiver_account),
dy AS (SELECT account, day, count(*) AS n, sum(amount::DECIMAL(28,6)) AS amount FROM ro GROUP BY ALL), rg AS (SELECT min(day) AS lo, max(day) AS hi FROM dy),
al AS (SELECT account, day, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount FROM (SELECT account, unnest(range(lo, hi + 1)) AS day FROM (SELECT DISTINCT account FROM dy), rg) LEFT JOIN dy USING (account, day)),
z AS (SELECT *, CASE WHEN stddev_pop(n) OVER w > 0 THEN round((n - avg(n) OVER w) / stddev_pop(n) OVER w, 6) ELSE 0 END::DECIMAL(20,6) AS z FROM al WINDOW w AS (PARTITION BY account)),
p AS (SELECT *, sum(z - 0.5::DECIMAL(20,6)) OVER w AS pu, sum(-z - 0.5::DECIMAL(20,6)) OVER w AS pd FROM z WINDOW w AS (PARTITION BY account ORDER BY day)),
c AS (SELECT *, pu - least(0, min(pu) OVER w) AS up, pd - least(0, min(pd) OVER w) AS down FROM p WINDOW w AS (PARTITION BY account ORDER BY day)),
k AS (SELECT account, max(up) AS mu, max(down) AS md, greatest(max(up), max(down)) AS peak FROM c GROUP BY account),
o AS (SELECT c.*, k.peak, mu >= md AS rises, CASE WHEN mu >= md THEN up ELSE down END AS v FROM c JOIN k USING (account) WHERE k.peak >= 4),
b AS (SELECT account, rises, peak, min(day) FILTER (v >= 4) AS first, min(day) FILTER (v = peak) AS last FROM o GROUP BY ALL)
SELECT account AS primary_account_id, CASE WHEN any_value(b.rises) THEN 'up' ELSE 'down' END AS direction, round(any_value(b.peak)::DOUBLE, 4) AS peak, any_value(first)::BIGINT AS first_day, sum(n)::BIGINT AS transaction_count, round(sum(amount)::DOUBLE, 4) AS total_amount
FROM b JOIN o USING (account) WHERE day BETWEEN first AND greatest(first, last) GROUP BY account"""


@_query(_DEVIATION)
def behaviour_changes(spark: SparkSession, d: str) -> DataFrame:
    e = deviations(_tx(spark, d))
    told = lambda c, kind: F.get_json_object("metadata", f"$.{c}").cast(kind)
    day = F.datediff(F.to_date("start_time"), F.lit("1970-01-01").cast("date")).cast("long")
    return e.select("primary_account_id", told("direction", "string").alias("direction"), F.round(told("peak", "double"), 4).alias("peak"), day.alias("first_day"), "transaction_count", _r("total_amount"))


@_query(None)
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Trees of random cuts are not SQL; tests walk them in plain Python."""
    return anomaly_scores(written(_features(spark, d), "features"))
