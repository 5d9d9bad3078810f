import datetime as dt
import math

import pytest

from panelforge.functions.calendar import business_day, easter, nyse_holidays, trading_days
from panelforge.operators import cleaning, contracts
from pyspark.sql import functions as F


def test_schema_check(panel, spark):
    p = panel(A=[1.0, 2.0])
    cleaning.validate_raw_schema(p.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError):
        cleaning.validate_raw_schema(p.drop("close"))
    with pytest.raises(ValueError):
        cleaning.validate_raw_schema(p.withColumn("open", F.lit("x")))
    with pytest.raises(ValueError):
        cleaning.validate_raw_schema(p.withColumn("date", F.lit(5)))


def test_dedup_keeps_the_first(spark):
    rows = [("2024-01-02", "A", 3, 30.0), ("2024-01-02", "A", 1, 10.0), ("2024-01-02", "B", 2, 20.0)]
    df = spark.createDataFrame(rows, "date string, ticker string, o int, close double")
    assert {(r.ticker, r.close) for r in cleaning.dedup_keep_first(df, "o").collect()} == {("A", 10.0), ("B", 20.0)}


def test_calendar(spark):
    assert easter(2024) == dt.date(2024, 3, 31) and easter(2000) == dt.date(2000, 4, 23) and easter(1997) == dt.date(1997, 3, 30)
    h = set(nyse_holidays(2021, 2024))
    # fixed days that are made up for, Good Friday, the third Monday, a Saturday New Year
    assert {dt.date(2021, 12, 24), dt.date(2021, 7, 5), dt.date(2022, 6, 20), dt.date(2023, 1, 2), dt.date(2024, 3, 29), dt.date(2024, 1, 15), dt.date(2024, 11, 28), dt.date(2024, 5, 27)} <= h
    assert dt.date(2021, 12, 31) not in h and dt.date(2022, 1, 1) not in h
    assert trading_days(spark, dt.date(2023, 1, 1), dt.date(2023, 12, 31)).count() == 250
    assert trading_days(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)).count() == 252
    with pytest.raises(ValueError):
        trading_days(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 2), "MARS")


def test_business_days(spark):
    import pandas as pd

    for start in pd.date_range("2024-03-01", periods=9):
        want = [d.date() for d in pd.bdate_range(start, periods=13)]
        got = [r.d for r in spark.range(13).select(business_day(F.lit(start.date()), F.col("id")).alias("d")).collect()]
        assert got == want


def test_reindex_drops_other_days_and_adds_missing(panel, spark):
    p = panel(start="2024-01-02", A=[1.0, 2.0, 3.0, 4.0], B=[5.0, 6.0, 7.0, 8.0]).where("NOT (ticker = 'A' AND date = '2024-01-03')")
    p = p.unionByName(p.limit(1).withColumn("date", F.lit(dt.date(2024, 1, 6))))
    rows = cleaning.calendar_reindex(p).collect()
    assert len(rows) == 8 and {r.date for r in rows if r.close is None} == {dt.date(2024, 1, 3)}
    with pytest.raises(ValueError):
        cleaning.calendar_reindex(p.limit(0))


def test_fill_limit(panel):
    p = panel(A=[1.0, None, None, None, None, 6.0, None])
    assert [r.close for r in cleaning.bounded_ffill(p, 3).orderBy("date").collect()] == [1.0, 1.0, 1.0, 1.0, None, 6.0, 6.0]
    assert cleaning.fill_and_drop(p, 3).count() == 6
    assert cleaning.fill_counts(p, 3).first().fills == 4
    assert cleaning.bounded_ffill(p, 0).where("close IS NULL").count() == 5
    with pytest.raises(ValueError):
        cleaning.bounded_ffill(p, 3, "bfill")


def test_invalid_prices(spark):
    rows = [(1.0, 2.0, 0.5, 1.0, 5), (0.0, 2.0, 1.0, 1.0, 5), (1.0, 0.5, 1.0, 1.0, 5), (1.0, 1.0, 1.0, 1.0, -4)]
    df = spark.createDataFrame(rows, "open double, high double, low double, close double, volume long")
    assert [r.volume for r in cleaning.drop_invalid_prices(df).collect()] == [5, None]


def test_coverage_keeps_the_boundary(panel):
    p = panel(A=[1.0] * 5, B=[1.0] * 4, C=[1.0] * 3)
    kept = cleaning.enforce_coverage(p, 0.80)
    assert {r.ticker for r in kept.select("ticker").distinct().collect()} == {"A", "B"}
    assert {r.ticker for r in cleaning.drop_tiny(p.where("ticker <> 'C' OR date = '2024-01-02'")).select("ticker").distinct().collect()} == {"A", "B"}


@pytest.mark.parametrize("a,b,want", [(100.0, 110.0, 0.10), (200.0, 190.0, -0.05), (150.0, 150.0, 0.0)])
def test_returns(panel, a, b, want):
    r = cleaning.compute_returns(panel(A=[a, b], B=[7.0])).collect()
    assert len(r) == 1 and r[0].simple_return == pytest.approx(want) and r[0].log_return == pytest.approx(math.log(b / a))


def test_outliers_are_strict(returns):
    r = returns(A=[0.25, -0.26, 0.3], B=[0.1])
    flagged = cleaning.flag_outliers(r)
    assert sorted(x.simple_return for x in flagged.collect()) == [-0.26, 0.3] and flagged.first().reason == "abs_return_exceeds_threshold"
    assert [(x.ticker, x.n_flagged) for x in cleaning.outlier_counts(r).collect()] == [("A", 2)]


def test_chain(panel):
    p = panel(start="2024-01-02", A=[1.0, None, 3.0, 4.0, 5.0], b=[1.0, -2.0, 3.0, 4.0, 5.0])
    out = cleaning.clean(p)
    assert {(r.ticker, r["count"]) for r in out.groupBy("ticker").count().collect()} == {("A", 5), ("B", 4)}
    assert contracts.violations(out, "prices_clean") == {}


def test_contracts(panel):
    p = panel(A=[1.0, 2.0])
    assert contracts.violations(p.unionByName(p), "prices_clean") == {"date, ticker repeat": 2}
    bad = p.withColumn("high", F.lit(0.5)).withColumn("open", F.lit(None).cast("double"))
    assert contracts.violations(bad, "prices_clean") == {"open is null": 2, "high is not below low": 2}
    assert set(contracts.violations(p.drop("close"), "prices_clean")) == {"close is missing"}
    with pytest.raises(RuntimeError):
        contracts.enforce(bad, "prices_clean", RuntimeError)
    assert len(contracts.CONTRACTS) == 12


def test_currencies(spark):
    meta = spark.createDataFrame([("A", "USD"), ("B", "EUR"), ("C", None), ("D", "GBP")], "ticker string, currency string")
    r = cleaning.currency_mix(meta, spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")).first()
    assert (r.n_currencies, r.currencies) == (2, "EUR,USD")
