import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowlattice.functions.columns import iso, money, one_place
from flowlattice.operators.features import FEATURES, FeatureConfig, feature_set, features
from flowlattice.operators.velocity import velocity
from flowlattice.sources import transactions as src
from flowlattice.sources.annotations import attempts, read_annotations, typology_counts
from flowlattice.sources.feature_store import FeatureStore

HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
ROWS = [
    "2022/09/01 00:10,010,A,020,B,100.00,USD,100.00,USD,Wire,0",
    "2022/09/01 00:30,010,A,010,C,9600.00,USD,9600.00,EUR,Cheque,1",
    "2022/09/01 05:00,010,A,010,A,50.00,USD,50.00,USD,Wire,0",
    "2022/09/02 01:00,020,B,010,A,70.50,USD,70.50,USD,ACH,0",
    "2022/09/02 01:20,030,C,010,A,20000.00,USD,20000.00,USD,ACH,0",
    "2022/09/02 09:00,010,A,020,B,123.45,USD,123.45,USD,Wire,0",
]
ACCOUNTS = "Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nFirst, 010 , A ,E1,Ann\nSecond,011,A,E2,Bea\nThird,020,B,E3,Cy\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / src.TRANSACTION_FILE).write_text(HEAD + "\n".join([*ROWS, "bad,1,A,2,B,1,USD,1,USD,Wire,0", "2022/09/03 00:00,1,,2,B,oops,USD,1,USD,Wire,x"]) + "\n")
    (tmp_path / src.ACCOUNT_FILE).write_text(ACCOUNTS)
    return str(tmp_path)


def test_transactions_are_normalised(spark, files):
    got = src.read_transactions(spark, files).orderBy("ord").collect()
    assert len(got) == 7  # the bad time goes; the empty sender stays
    assert got[0].from_bank == "010" and got[0].timestamp == datetime(2022, 9, 1, 0, 10)
    assert got[6].sender_account == "" and got[6].amount_received is None and got[6].is_laundering is None
    with pytest.raises(ValueError):
        src.read_transactions(spark, files, chunksize=0)


def test_selection_is_inclusive_and_limits_last(spark, files):
    got = src.read_transactions(spark, files, start="2022-09-01 00:30:00", end="2022-09-02 01:00:00")
    assert got.count() == 3
    assert [r.ord for r in src.read_transactions(spark, files, accounts=["C"], max_rows=1).collect()] == [r.ord for r in src.read_transactions(spark, files, accounts=["C"]).orderBy("ord").limit(1).collect()]
    assert src.read_transactions(spark, files, accounts=[]).count() == 0
    assert src.sample_transactions(spark, files, 2).count() == 2
    ids = spark.createDataFrame([("B",), ("C",)], "account_id string")
    assert src.selected(src.read_transactions(spark, files), accounts=ids).count() == src.read_transactions(spark, files, accounts=["B", "C"]).count()


def test_first_account_row_wins(spark, files):
    got = {r.account_number: r for r in src.read_accounts(spark, files).collect()}
    assert got["A"].entity_id == "E1" and got["A"].bank_id == "010" and len(got) == 2


def test_generic_file(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("transaction_id,customer_id,amount,timestamp,transaction_type,counterparty,country\n2,C1,5.5,2024-01-02 10:00:00,wire,X,US\n1,C1,oops,2024-01-01 10:00:00,wire,X,US\n3,C1,1,never,wire,X,US\n")
    assert [r.transaction_id for r in src.read_generic(spark, str(p)).collect()] == ["1", "2"]
    p.write_text("transaction_id\n1\n")
    with pytest.raises(ValueError):
        src.read_generic(spark, str(p))


def test_feature_values(spark, files):
    f = {r.account_id: r for r in features(src.read_transactions(spark, files), src.read_accounts(spark, files)).collect()}
    a = f["A"]
    assert tuple(a.asDict()) == FEATURES
    assert (a.transaction_count, a.outgoing_count, a.incoming_count, a.self_transfer_count) == (6, 4, 3, 1)
    assert (a.total_outgoing_amount, a.total_incoming_amount, a.max_incoming_amount) == (pytest.approx(9873.45), pytest.approx(20120.5), 20000.0)
    assert (a.unique_outgoing_counterparties, a.unique_incoming_counterparties, a.unique_counterparties) == (2, 2, 2)
    assert (a.unique_outgoing_banks, a.unique_incoming_banks, a.payment_format_count, a.payment_currency_count) == (2, 3, 3, 2)
    assert (a.low_value_outgoing_count, a.near_threshold_outgoing_count, a.near_threshold_outgoing_value, a.round_amount_count) == (4, 1, 9600.0, 2)
    assert (a.active_hours, a.active_days, a.max_transactions_in_hour, a.max_transactions_in_day) == (4, 2, 2, 3)
    assert (a.rapid_gap_count, a.rapid_gap_ratio) == (2, pytest.approx(0.4))
    assert a.mean_time_between_transactions_minutes == pytest.approx((32 * 60 + 50) / 5)
    assert (a.median_outgoing_amount, a.median_incoming_amount) == (pytest.approx(111.725), 70.5)
    assert (a.bank_name, a.entity_name) == ("First", "Ann") and f["C"].bank_name is None
    assert math.isnan(f[""].mean_time_between_transactions_minutes)


def test_features_do_not_depend_on_partitions_or_labels(spark, files):
    t = src.read_transactions(spark, files)
    want = sorted(map(str, features(t).collect()))
    assert sorted(map(str, features(t.repartition(5)).collect())) == want
    assert sorted(map(str, features(t.withColumn("is_laundering", F.lit(1).cast("long"))).collect())) == want
    assert features(t.where("false")).count() == 0
    assert features(t, config=FeatureConfig(median="none")).first().median_outgoing_amount is None


def test_store_keeps_labels_apart(spark, files, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    assert not store.exists()
    store.save(feature_set(src.read_transactions(spark, files), max_rows=None))
    assert store.exists() and store.lookup("A").count() == 1
    got = store.load()
    assert got.metadata["feature_count"] == 42 and not {"laundering_event_count", "is_laundering"} & set(got.features.columns)
    labels = {r.account_id: r for r in got.labels.collect()}
    assert (labels["A"].event_count, labels["A"].laundering_event_count, labels["A"].has_laundering_label) == (6, 1, True)


def frame(spark, **cols):
    base = {"account_id": "A", "max_transactions_in_hour": 0, "rapid_gap_count": 0, "transactions_per_active_hour": 0.0} | cols
    return spark.createDataFrame([tuple(base.values())], list(base))


def test_velocity(spark):
    assert velocity(frame(spark)).count() == 0
    e = velocity(frame(spark, max_transactions_in_hour=18, rapid_gap_count=5, total_outgoing_amount=10.0, total_incoming_amount=5.5, entity_id="E", laundering_event_count=9)).first()
    assert (e.severity, e.evidence_strength, e.total_amount, e.entity_ids, len(e.reasons), e.start_time) == ("high", 1.0, 15.5, ["E"], 2, None)
    assert velocity(frame(spark, transactions_per_active_hour=6.25)).first().severity == "medium"
    with pytest.raises(ValueError):
        velocity(frame(spark).drop("rapid_gap_count"))


TEXT = """noise
BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 3-degree Fan-Out
2022/09/01 00:06,021174,800737690,012,80011F990,2848.96,Euro,2848.96,Euro,ACH,1
not a row
END LAUNDERING ATTEMPT - FAN-OUT
2022/09/01 00:07,1,2,3,4,5,Euro,6,Euro,ACH,1
BEGIN LAUNDERING ATTEMPT - CYCLE
BEGIN LAUNDERING ATTEMPT - gather scatter: two
2022/09/01 04:33,021174,8,020,9,8630.40,Euro,8630.40,Euro,"A,B"
END LAUNDERING ATTEMPT - GATHER-SCATTER
BEGIN LAUNDERING ATTEMPT - STACK
"""


def test_annotations(spark, tmp_path):
    (tmp_path / "p.txt").write_text(TEXT)
    got = read_annotations(spark, str(tmp_path / "p.txt")).orderBy("attempt_id").collect()
    assert [(r.attempt_id, r.typology, r.description, len(r.transactions)) for r in got] == [(1, "FAN-OUT", "Max 3-degree Fan-Out", 1), (3, "GATHER-SCATTER", "two", 1)]
    assert got[1].transactions[0].payment_format == "A,B" and got[1].transactions[0].is_laundering is None
    assert {r.typology: r.attempts for r in typology_counts(read_annotations(spark, str(tmp_path / "p.txt"))).collect()} == {"FAN-OUT": 1, "GATHER-SCATTER": 1}
    bad = spark.createDataFrame([("BEGIN LAUNDERING ATTEMPT", 1, "f"), ("END LAUNDERING ATTEMPT", 2, "f")], "value string, line long, file string")
    with pytest.raises(Exception, match="no typology"):
        attempts(bad).collect()


def test_formats(spark):
    r = spark.sql("select timestamp_ntz'2024-01-02 03:04:05.5' a, timestamp_ntz'2024-01-02 00:00:00' b, 1234567.891D m, 12.35D s")
    r = r.select(iso(F.col("a")).alias("a"), iso(F.col("b")).alias("b"), money(F.col("m")).alias("m"), money(F.col("m"), True).alias("c"), one_place(F.col("s")).alias("s")).first()
    assert tuple(r) == ("2024-01-02T03:04:05.500000", "2024-01-02T00:00:00", "$1,234,567.89", "$1.2M", "12.4")


def test_rows_are_numbered_by_ranges(spark):
    """Places run on over many ranges, repeated numbers and nulls, and no range holds all rows."""
    df = spark.range(5000, numPartitions=7).select(F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 5000 % 4000).alias("x"))
    got = src.numbered(df, "x", "i", rows=100)
    want = sorted((r.x is None, r.x or 0) for r in df.collect())
    assert [(r.x is None, r.x or 0) for r in sorted(got.collect(), key=lambda r: r.i)] == want
    assert sorted(r.i for r in got.select("i").collect()) == list(range(5000))
    assert src.numbered(df.where("false"), "x", "i").count() == 0
    assert "row_number() windowspecdefinition(__range" in got._jdf.queryExecution().optimizedPlan().toString()
