"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_key(ticks: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first tick of each key that arrives; keys are forgotten once the watermark has passed them."""
    return ticks.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def stream_bars(ticks: DataFrame, ticker: str, price: str, time: str = "ts", width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """(window_start, ticker, open, high, low, close, volume) of tumbling windows; ticks later than `late` are dropped.

    late None: the ticks have a watermark already.
    """
    own = ticks.where(F.col(price).isNotNull())
    own = own.withWatermark(time, late) if late else own
    bars = own.groupBy(F.window(time, width), F.col(ticker).alias("ticker")).agg(F.min_by(price, time).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, time).alias("close"), F.count("*").alias("volume"))
    return bars.select(F.col("window.start").alias("window_start"), "ticker", "open", "high", "low", "close", "volume")
