import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


DAY0 = date(2015, 1, 1)
PANEL_SCHEMA = "date date, store_nbr int, family string, sales double, onpromotion int"


def seasonal(store, family, i):
    """Weekly pattern with a slow trend, no randomness."""
    return 50.0 + 10 * store + 5 * len(family) % 7 + (0, 3, 6, 9, 15, 30, 25)[i % 7] + 0.05 * i


@pytest.fixture(scope="session")
def make_panel(spark):
    def build(days=60, stores=(1, 2), families=("GROCERY", "DAIRY"), promo=lambda i: 0):
        rows = [
            (DAY0 + timedelta(days=i), s, f, seasonal(s, f, i), promo(i))
            for i in range(days)
            for s in stores
            for f in families
        ]
        return spark.createDataFrame(rows, PANEL_SCHEMA)

    return build


@pytest.fixture(scope="session")
def series(spark):
    """A single series from lists of sales and promotions."""

    def build(sales, promo=None):
        promo = promo or [0] * len(sales)
        rows = [(DAY0 + timedelta(days=i), 1, "A", s, p) for i, (s, p) in enumerate(zip(sales, promo))]
        return spark.createDataFrame(rows, PANEL_SCHEMA)

    return build
