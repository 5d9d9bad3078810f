import datetime as dt

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def panel(spark):
    """Bars from closes by ticker; None is a gap."""

    def make(start="2024-01-02", **closes):
        rows = []
        for ticker, values in closes.items():
            d = dt.date.fromisoformat(start)
            for v in values:
                while d.weekday() > 4:
                    d += dt.timedelta(1)
                rows.append((d, ticker, v, v, v, v, None if v is None else 100))
                d += dt.timedelta(1)
        return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume long")

    return make


@pytest.fixture
def returns(spark):
    def make(**values):
        import math

        rows = [(dt.date(2024, 1, 1) + dt.timedelta(k), t, x, math.log(1 + x)) for t, xs in values.items() for k, x in enumerate(xs)]
        return spark.createDataFrame(rows, "date date, ticker string, simple_return double, log_return double")

    return make
