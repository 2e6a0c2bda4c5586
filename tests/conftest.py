import sys
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from moments import START  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "2").config("spark.sql.codegen.wholeStage", "false").config("spark.sql.adaptive.enabled", "false").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TX = "ord long, timestamp timestamp_ntz, sender_account string, receiver_account string, amount_paid double, amount_received double, from_bank string, to_bank string, payment_format string, payment_currency string, receiving_currency string, is_laundering long"


@pytest.fixture
def tx(spark):
    """Makes transactions of (minutes, sender, receiver[, amount])."""

    def make(*rows, **extra):
        out = []
        for i, (minutes, s, r, *amount) in enumerate(rows):
            a = float(amount[0]) if amount else 100.0
            out.append((i, START + timedelta(minutes=minutes), s, r, a, a, "1", "2", "Wire", "USD", "USD", i % 2))
        return spark.createDataFrame(out, TX)

    return make
