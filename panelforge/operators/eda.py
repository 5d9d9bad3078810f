"""Exploration: distributions, volatility, correlations, moves and runs, and the data behind the charts."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.stats import by_date, correlation, jarque_bera_p, last_rows, sample_kurtosis, sample_skewness


def distribution_stats(returns: DataFrame) -> DataFrame:
    """Mean, deviation, bias-corrected skewness and excess kurtosis, extremes, Jarque-Bera p-value."""
    r = F.col("simple_return")
    return returns.groupBy("ticker").agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), sample_skewness(r).alias("skew"), sample_kurtosis(r).alias("kurtosis"), F.min(r).alias("min"), F.max(r).alias("max"),
        jarque_bera_p(r).alias("jarque_bera_p"), (F.stddev_samp(r) == 0).alias("flat_lined"),
    )


def moving_averages(prices: DataFrame, windows: tuple[int, ...] = DEFAULTS.moving_windows) -> DataFrame:
    """close with ma_{k}: null until k closes are there."""
    return prices.select("date", "ticker", "close", *[F.when(F.count("close").over(last_rows(k)) == k, F.avg("close").over(last_rows(k))).alias(f"ma_{k}") for k in windows])


def volume_trend(prices: DataFrame) -> DataFrame:
    return prices.select("date", "ticker", F.col("volume").cast("double").alias("volume"))


def rolling_volatility(returns: DataFrame, window: int = DEFAULTS.volatility_window, days: int = DEFAULTS.days_per_year) -> DataFrame:
    """Annualised; tickers with fewer rows than the window are left out, and so are rows before it is full."""
    w = last_rows(window)
    return returns.select("date", "ticker", F.when(F.count("simple_return").over(w) == window, F.stddev_samp("simple_return").over(w) * math.sqrt(days)).alias("volatility")).where("volatility IS NOT NULL")


def monthly_volatility(returns: DataFrame, window: int = DEFAULTS.volatility_window, days: int = DEFAULTS.days_per_year) -> DataFrame:
    """(ticker, month, volatility) of tickers with `window` rows; a month of one row has null."""
    long = returns.groupBy("ticker").count().where(F.col("count") >= window).select("ticker")
    return returns.join(long, "ticker", "left_semi").groupBy("ticker", F.date_format("date", "yyyy-MM").alias("month")).agg((F.stddev_samp("simple_return") * math.sqrt(days)).alias("volatility"))


def pairs(returns: DataFrame, column: str = "simple_return", unique: bool = False) -> DataFrame:
    """(a, b, x, y) of every two tickers a < b on common dates; repeated keys are averaged, or raise with unique."""
    check = F.when(F.count("*") > 1, F.raise_error(F.lit("a date has a ticker twice")).cast("double")) if unique else F.lit(None).cast("double")
    one = returns.where(F.col(column).isNotNull()).groupBy("date", "ticker").agg(F.coalesce(check, F.avg(column)).alias("v"))
    left, right = one.select("date", F.col("ticker").alias("a"), F.col("v").alias("x")), one.select("date", F.col("ticker").alias("b"), F.col("v").alias("y"))
    return left.join(right, "date").where("a < b").select("a", "b", "date", "x", "y")


def correlation_pairs(returns: DataFrame, column: str = "simple_return", unique: bool = False) -> DataFrame:
    """(a, b, corr) with a < b over common dates; null if one is constant there or there are fewer than two."""
    return pairs(returns, column, unique).groupBy("a", "b").agg(F.when(F.count("*") > 1, correlation(F.col("x"), F.col("y"))).alias("corr"))


def mirrored(pairs: DataFrame, a: str, b: str, left: str, right: str) -> DataFrame:
    """Each pair in both orders, from one evaluation."""
    half = lambda x, y: F.struct(F.col(x).alias(left), F.col(y).alias(right), "corr")
    return pairs.select(F.explode(F.array(half(a, b), half(b, a))).alias("p")).select("p.*")


def correlation_matrix(returns: DataFrame, column: str = "simple_return", unique: bool = False) -> DataFrame:
    """(ticker_a, ticker_b, corr): both halves and the diagonal, which is null for a constant ticker."""
    c = correlation_pairs(returns, column, unique)
    own = returns.where(F.col(column).isNotNull()).groupBy("ticker").agg(F.when(F.stddev_samp(column) > 0, 1.0).alias("corr")).select(F.col("ticker").alias("ticker_a"), F.col("ticker").alias("ticker_b"), "corr")
    return mirrored(c, "a", "b", "ticker_a", "ticker_b").unionByName(own)


def top_correlated_pairs(returns: DataFrame, n: int = DEFAULTS.top_correlations) -> DataFrame:
    """The n pairs with the largest absolute correlation; ties go by name."""
    return correlation_pairs(returns).where("corr IS NOT NULL").orderBy(F.abs("corr").desc(), "a", "b").limit(n)


def scatter(returns: DataFrame, n: int = DEFAULTS.top_correlations) -> DataFrame:
    """(a, b, date, x, y) of the top pairs."""
    return pairs(returns).join(F.broadcast(top_correlated_pairs(returns, n).select("a", "b")), ["a", "b"], "left_semi")


def _sectored(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    own = returns.select("ticker").distinct().join(sectors, "ticker", "left").select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    c = correlation_pairs(returns)
    return c.join(own.select(F.col("ticker").alias("a"), F.col("sector").alias("sa")), "a").join(own.select(F.col("ticker").alias("b"), F.col("sector").alias("sb")), "b")


def sector_corr_matrix(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector_a, sector_b, corr): mean over pairs of different tickers; null where there is none."""
    c = _sectored(returns, sectors)
    both = mirrored(c, "sa", "sb", "sector_a", "sector_b")
    names = returns.select("ticker").distinct().join(sectors, "ticker", "left").select(F.coalesce("sector", F.lit("Unknown")).alias("s")).distinct()
    grid = names.select(F.col("s").alias("sector_a")).crossJoin(names.select(F.col("s").alias("sector_b")))
    return grid.join(both.groupBy("sector_a", "sector_b").agg(F.avg("corr").alias("corr")), ["sector_a", "sector_b"], "left")


def sector_avg_corr(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, avg_corr): mean of the pairs inside a sector, to 4 digits; 0 where there is none."""
    inside = _sectored(returns, sectors).where("sa = sb").groupBy(F.col("sa").alias("sector")).agg(F.avg("corr").alias("m"))
    names = returns.select("ticker").distinct().join(sectors, "ticker", "left").select(F.coalesce("sector", F.lit("Unknown")).alias("sector")).distinct()
    return names.join(inside, "sector", "left").select("sector", F.round(F.coalesce("m", F.lit(0.0)), 4).alias("avg_corr"))


def top_moves(returns: DataFrame, n: int = DEFAULTS.top_moves) -> DataFrame:
    """The n largest absolute returns of each ticker with their place; ties go to the earlier date."""
    w = Window.partitionBy("ticker").orderBy(F.abs("simple_return").desc(), "date")
    return returns.select("ticker", "date", "simple_return", F.row_number().over(w).cast("long").alias("place")).where(F.col("place") <= n)


def outlier_match(returns: DataFrame, cleaning_counts: DataFrame, n: int = DEFAULTS.top_moves, threshold: float = DEFAULTS.outlier_threshold) -> DataFrame:
    """(ticker, eda_count, cleaning_count, overlap): top moves, rows that cleaning flagged, and top moves beyond the threshold."""
    own = top_moves(returns, n).groupBy("ticker").agg(F.count("*").alias("eda_count"), F.count_if(F.abs("simple_return") > threshold).alias("overlap"))
    return own.join(cleaning_counts, "ticker", "left").select("ticker", "eda_count", F.coalesce("n_flagged", F.lit(0)).cast("long").alias("cleaning_count"), "overlap")


def flat_runs(prices: DataFrame) -> DataFrame:
    """(date, ticker, close, run_length) of rows whose close equals the one before; each has its whole run's length."""
    w = by_date()
    flat = prices.select("date", "ticker", "close", F.coalesce(F.col("close") - F.lag("close").over(w) == 0, F.lit(False)).alias("flat"))
    runs = flat.withColumn("run", F.sum((~F.col("flat")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.withColumn("run_length", F.sum(F.col("flat").cast("long")).over(Window.partitionBy("ticker", "run")))
    return whole.where("flat").select("date", "ticker", "close", "run_length")


def counts_and_ranges(prices: DataFrame) -> DataFrame:
    return prices.agg(F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# ── data behind charts ───────────────────────────────────────────────────────
def histogram(returns: DataFrame, bins: int = 50) -> DataFrame:
    """(ticker, bin, low, high, n, density): equal bins from least to greatest, the last one closed; empty bins have rows.

    A constant ticker has a range of 1 around its value.
    """
    ends = returns.groupBy("ticker").agg(F.min("simple_return").alias("lo"), F.max("simple_return").alias("hi"), F.count("simple_return").alias("all"))
    ends = ends.select("ticker", F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"), F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"), "all")
    at = F.least(F.floor((F.col("simple_return") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("long")
    n = returns.join(ends, "ticker").groupBy("ticker", at.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(n, ["ticker", "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / bins
    count = F.coalesce("n", F.lit(0)).cast("long")
    return grid.select("ticker", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), count.alias("n"), (count / (F.col("all") * width)).alias("density"))


def density(returns: DataFrame, points: int = 300) -> DataFrame:
    """(ticker, x, y): Gaussian kernel density with Scott's bandwidth on a grid from least to greatest."""
    s = returns.groupBy("ticker").agg(F.min("simple_return").alias("lo"), F.max("simple_return").alias("hi"), F.count("simple_return").alias("n"), F.stddev_samp("simple_return").alias("sd")).where("n > 1 AND sd > 0")
    grid = s.select("ticker", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h"), "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).select("ticker", "h", "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1)).alias("x"))
    z = (F.col("x") - F.col("simple_return")) / F.col("h")
    both = grid.join(returns.select("ticker", "simple_return"), "ticker")
    return both.groupBy("ticker", "k", "x", "h").agg(F.avg(F.exp(-0.5 * z * z)).alias("m")).select("ticker", F.col("k").cast("long").alias("k"), "x", (F.col("m") / (F.col("h") * math.sqrt(2 * math.pi))).alias("y"))


def _ppf(batches):
    for pdf in batches:
        pdf["theoretical"] = [NormalDist().inv_cdf(p) for p in pdf["p"]]
        yield pdf


def qq(returns: DataFrame, least: int = DEFAULTS.min_qq_rows) -> DataFrame:
    """(ticker, i, theoretical, ordered, slope, intercept): order statistics against the medians of normal ones, with the fitted line."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    rows = returns.select("ticker", F.col("simple_return").alias("ordered"), F.row_number().over(Window.partitionBy("ticker").orderBy("simple_return")).cast("long").alias("i"), n.alias("n")).where(F.col("n") >= least)
    end = F.pow(F.lit(0.5), 1 / F.col("n"))
    median = F.when(F.col("i") == F.col("n"), end).when(F.col("i") == 1, 1 - end).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    points = rows.select("ticker", "i", "ordered", median.alias("p")).mapInPandas(_ppf, "ticker string, i long, ordered double, p double, theoretical double")
    line = points.groupBy("ticker").agg(F.regr_slope("ordered", "theoretical").alias("slope"), F.regr_intercept("ordered", "theoretical").alias("intercept"))
    return points.join(line, "ticker").select("ticker", "i", "theoretical", "ordered", "slope", "intercept")


def box(returns: DataFrame) -> DataFrame:
    """(ticker, q1, median, q3, whiskers, n_outliers): whiskers end at the last values within 1.5 quartile ranges."""
    q = returns.groupBy("ticker").agg(F.percentile("simple_return", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select("ticker", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    r, lo, hi = F.col("simple_return"), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (r >= lo) & (r <= hi)
    return returns.join(q, "ticker").groupBy("ticker", "q1", "median", "q3").agg(F.min(F.when(inside, r)).alias("whisker_low"), F.max(F.when(inside, r)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
