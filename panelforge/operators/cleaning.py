"""Cleaning of a price panel, and returns.

Every operator takes and gives (date, ticker, open, high, low, close, volume).  Nulls mean missing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.calendar import is_trading_day, trading_days
from ..functions.stats import by_date, no_nan

OHLC = ("open", "high", "low", "close")
_RAW = {"date": ("date", "timestamp", "timestamp_ntz"), "ticker": ("string",), **dict.fromkeys(OHLC, ("double", "float")), "volume": None}


def validate_raw_schema(prices: DataFrame) -> None:
    """Raises ValueError for a missing column or a wrong type; further columns are allowed."""
    types = dict(prices.dtypes)
    missing = [c for c in _RAW if c not in types]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c, allowed in _RAW.items():
        if allowed and types[c] not in allowed:
            raise ValueError(f"{c} has type {types[c]}, not {allowed[0]}")


def dedup_keep_first(prices: DataFrame, ordinal: str) -> DataFrame:
    """The row with the smallest ordinal of each date and ticker."""
    w = Window.partitionBy("date", "ticker").orderBy(ordinal)
    return prices.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def span(prices: DataFrame) -> tuple[dt.date, dt.date] | None:
    r = prices.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return None if r.a is None else (r.a, r.b)


def calendar_reindex(prices: DataFrame, calendar: str = DEFAULTS.calendar) -> DataFrame:
    """Each ticker has a row for every trading day of the panel's span; other days go, missing ones are null."""
    ends = span(prices)
    if ends is None:
        raise ValueError("the panel is empty")
    if trading_days(prices.sparkSession, *ends, calendar).isEmpty():
        raise ValueError("the calendar has no trading day in the panel's span")
    # each ticker lays out its own days, so nothing is broadcast or crossed
    grid = prices.select("ticker").distinct().withColumn("date", F.explode(F.sequence(F.lit(ends[0]), F.lit(ends[1])))).where(is_trading_day(F.col("date"), ends[0].year, ends[1].year, calendar))
    return grid.join(prices, ["date", "ticker"], "left").select("date", "ticker", *OHLC, "volume")


def bounded_ffill(prices: DataFrame, limit: int = DEFAULTS.max_fills, method: str = "ffill") -> DataFrame:
    """Fills each price on its own from at most `limit` rows before; volume stays."""
    if method != "ffill":
        raise ValueError(f"unknown fill method: {method}")
    w = by_date().rowsBetween(-limit, 0)
    return prices.select("date", "ticker", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in OHLC], "volume")


def fill_and_drop(prices: DataFrame, limit: int = DEFAULTS.max_fills) -> DataFrame:
    """bounded_ffill, then without rows that still lack a price."""
    return bounded_ffill(prices, limit).dropna(how="any", subset=list(OHLC))


def fill_counts(prices: DataFrame, limit: int = DEFAULTS.max_fills) -> DataFrame:
    """(ticker, fills): closes that bounded_ffill fills, in rows or not."""
    w = by_date().rowsBetween(-limit, 0)
    filled = prices.select("ticker", F.col("close").isNull().alias("gap"), F.last("close", ignorenulls=True).over(w).alias("now"))
    return filled.groupBy("ticker").agg(F.count_if(F.col("gap") & F.col("now").isNotNull()).alias("fills"))


def drop_invalid_prices(prices: DataFrame) -> DataFrame:
    """Without rows that have a price of 0 or less or a high under the low; negative volumes become null."""
    good = (F.least(*OHLC) > 0) & (F.col("high") >= F.col("low"))
    return prices.where(good).withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))


def coverage(prices: DataFrame, calendar: str = DEFAULTS.calendar) -> DataFrame:
    """(ticker, n_rows, coverage): the share of the trading days of the panel's span."""
    ends = span(prices)
    if ends is None:
        raise ValueError("the panel is empty")
    expected = trading_days(prices.sparkSession, *ends, calendar).count()
    return prices.groupBy("ticker").agg(F.count("*").alias("n_rows")).withColumn("coverage", F.try_divide(F.col("n_rows").cast("double"), F.lit(float(expected))))


def enforce_coverage(prices: DataFrame, least: float = DEFAULTS.min_coverage, calendar: str = DEFAULTS.calendar) -> DataFrame:
    """Tickers with at least `least` of the days."""
    good = coverage(prices, calendar).where(F.col("coverage") >= F.lit(least)).select("ticker")
    return prices.join(good, "ticker", "left_semi").select(prices.columns)


def drop_tiny(prices: DataFrame, least: int = 2) -> DataFrame:
    """Tickers with at least `least` rows."""
    good = prices.groupBy("ticker").count().where(F.col("count") >= least).select("ticker")
    return prices.join(good, "ticker", "left_semi").select(prices.columns)


def compute_returns(prices: DataFrame) -> DataFrame:
    """(date, ticker, simple_return, log_return); a ticker's first row has none."""
    prior = F.lag("close").over(by_date())
    return prices.select("date", "ticker", (F.try_divide(F.col("close"), prior) - 1).alias("simple_return"), F.ln(F.try_divide(F.col("close"), prior)).alias("log_return")).where("simple_return IS NOT NULL")


def flag_outliers(returns: DataFrame, threshold: float = DEFAULTS.outlier_threshold) -> DataFrame:
    return returns.where(F.abs("simple_return") > threshold).withColumn("reason", F.lit("abs_return_exceeds_threshold"))


def outlier_counts(returns: DataFrame, threshold: float = DEFAULTS.outlier_threshold) -> DataFrame:
    return flag_outliers(returns, threshold).groupBy("ticker").agg(F.count("*").alias("n_flagged"))


def zero_volume_days(prices: DataFrame) -> DataFrame:
    """Rows without volume; a missing volume counts as none."""
    return prices.where(F.coalesce("volume", F.lit(0)) == 0)


def currency_mix(metadata: DataFrame, tickers: DataFrame) -> DataFrame:
    """(n_currencies, currencies): the distinct currencies of the tickers, sorted; more than one asks for care."""
    known = metadata.join(tickers.select("ticker").distinct(), "ticker", "left_semi").where("currency IS NOT NULL")
    return known.agg(F.count_distinct("currency").alias("n_currencies"), F.concat_ws(",", F.sort_array(F.collect_set("currency"))).alias("currencies"))


def clean(prices: DataFrame, ordinal: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The whole chain: one row per key, calendar, fill, invalid rows, coverage, tiny tickers.

    Filling comes before invalid rows go, so a bad price may be filled forward, and days that such rows leave
    empty are not filled; coverage is measured on what is left.
    """
    validate_raw_schema(prices)
    prices = prices.select("date", F.upper("ticker").alias("ticker"), *[no_nan(F.col(c)).alias(c) for c in OHLC], F.col("volume").cast("long").alias("volume"), *([ordinal] if ordinal else []))
    prices = prices.withColumn("date", F.to_date("date"))
    first = dedup_keep_first(prices, ordinal).drop(ordinal) if ordinal else prices
    whole = fill_and_drop(calendar_reindex(first, settings.calendar), settings.max_fills)
    return drop_tiny(enforce_coverage(drop_invalid_prices(whole), settings.min_coverage, settings.calendar))
