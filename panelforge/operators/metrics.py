"""Risk and return metrics per ticker, rolling metrics, and portfolios.

returns: (date, ticker, simple_return, log_return).  Long metric tables have (ticker, metric_name, value,
category).  What can't be computed is null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.stats import by_date, correlation, last_rows, ratio

#: Trading days of a month, whatever the year has.
MONTH = 21


def level_name(kind: str, level: float) -> str:
    return f"{kind}_{int(level * 100)}"


def unpivot(wide: DataFrame, names: list[str], category: str, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Long form of a wide table of metrics."""
    return wide.unpivot(list(keys), names, "metric_name", "value").withColumn("category", F.lit(category))


# ── per ticker ───────────────────────────────────────────────────────────────
RETURN_METRICS = ["total_return", "cagr", "mean_daily", "mean_monthly", "mean_annual", "best_day", "worst_day", "pct_positive_days"]


def _return_columns(r: Column, days: int) -> list[Column]:
    total = F.product(1 + r) - 1
    return [
        total.alias("total_return"), (F.pow(1 + total, days / F.count(r)) - 1).alias("cagr"), F.avg(r).alias("mean_daily"), (F.avg(r) * MONTH).alias("mean_monthly"),
        (F.avg(r) * days).alias("mean_annual"), F.max(r).alias("best_day"), F.min(r).alias("worst_day"), F.avg((r > 0).cast("double")).alias("pct_positive_days"),
    ]


def wide(returns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All metrics of each ticker in one aggregation, and so one shuffle.

    What needs the series itself (the tail's mean, the drawdown) is read off its array, which is as long as the
    calendar.  The drawdown is that of growth from 1, so a first loss counts.
    """
    r, days, year = F.col("simple_return"), settings.days_per_year, float(settings.days_per_year) ** 0.5
    down = F.when(r < 0, r)
    levels = sorted({*settings.var_levels, *settings.cvar_levels})
    own = returns.groupBy("ticker").agg(
        *_return_columns(r, days), F.stddev_samp(r).alias("daily_vol"), (F.stddev_samp(r) * year).alias("annual_vol"), F.when(F.count(down) > 1, F.stddev_samp(down) * year).alias("downside_deviation"),
        F.percentile(r, F.array(*[F.lit(1 - x) for x in levels])).alias("q"), F.sort_array(F.collect_list(F.struct("date", r.alias("r")))).alias("s"),
    )
    q = {x: F.col("q")[k] for k, x in enumerate(levels)}
    values = F.transform("s", lambda x: x.r)
    step = lambda acc, x: F.struct((acc.g * (1 + x.r)).alias("g"), F.greatest(acc.peak, acc.g * (1 + x.r)).alias("peak"), F.least(acc.low, F.try_divide(acc.g * (1 + x.r), F.greatest(acc.peak, acc.g * (1 + x.r))) - 1).alias("low"))
    low = F.aggregate("s", F.struct(F.lit(1.0).alias("g"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("low")), step, lambda acc: acc.low)
    own = own.select("*", *[F.abs(q[x]).alias(level_name("var", x)) for x in settings.var_levels], *[F.abs(_mean_below(values, q[x])).alias(level_name("cvar", x)) for x in settings.cvar_levels], low.alias("max_drawdown")).drop("q", "s")
    excess = F.col("mean_annual") - settings.risk_free_rate
    return own.select("*", ratio(excess, F.col("annual_vol")).alias("sharpe"), ratio(excess, F.col("downside_deviation")).alias("sortino"), ratio(F.col("cagr"), F.abs("max_drawdown")).alias("calmar"))


def return_metrics(returns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return unpivot(wide(returns, settings), RETURN_METRICS, "return")


def _mean_below(values: Column, border: Column) -> Column:
    """The mean of an array's values not above a border."""
    own = F.filter(values, lambda x: x <= border)
    return F.try_divide(F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x), F.size(own).cast("double"))


def tail(returns: DataFrame, levels: list[float], keys: tuple[str, ...] = ("ticker",), value: str = "simple_return") -> DataFrame:
    """The quantile q_{L} at 1 - L of each group and the mean t_{L} of the values not above it, from one aggregation.

    A group's values are held as an array, as its exact quantile needs them anyway.
    """
    r = F.col(value)
    own = returns.groupBy(*keys).agg(F.percentile(r, F.array(*[F.lit(1 - x) for x in levels])).alias("q"), F.collect_list(r).alias("v"))
    return own.select(*keys, *[F.col("q")[k].alias(f"q_{int(x * 100)}") for k, x in enumerate(levels)], *[_mean_below(F.col("v"), F.col("q")[k]).alias(f"t_{int(x * 100)}") for k, x in enumerate(levels)])


def growth(returns: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Cumulative growth from 1, and its drawdown from the peak so far (the start counts as a peak)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("growth", F.product(1 + F.col("simple_return")).over(run))
    return grown.withColumn("drawdown", F.try_divide(F.col("growth"), F.greatest(F.lit(1.0), F.max("growth").over(run))) - 1)


def drawdown_duration(returns: DataFrame) -> DataFrame:
    """(ticker, max_drawdown, max_duration, recovered): the longest run of steps under water.

    A run that is still open at the end counts one step less; without any run the duration is 0.
    """
    w = by_date()
    g = growth(returns).select("ticker", "date", "drawdown", F.sum((F.col("drawdown") >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"), F.max("date").over(Window.partitionBy("ticker")).alias("end"))
    runs = g.groupBy("ticker", "island").agg(F.count_if(F.col("drawdown") < 0).alias("under"), F.max((F.col("date") == F.col("end")).cast("int")).alias("last"), F.min("drawdown").alias("low"), F.max_by("drawdown", "date").alias("at_end"))
    steps = F.col("under") - F.when((F.col("last") == 1) & (F.col("at_end") < 0), 1).otherwise(0)
    return runs.groupBy("ticker").agg(F.least(F.min("low"), F.lit(0.0)).alias("max_drawdown"), F.max(steps).cast("long").alias("max_duration"), F.coalesce(F.max_by("at_end", "last") >= 0, F.lit(True)).alias("recovered"))


def risk_names(settings: Settings = DEFAULTS) -> list[str]:
    return ["daily_vol", "annual_vol", "downside_deviation", *[level_name("var", x) for x in settings.var_levels], *[level_name("cvar", x) for x in settings.cvar_levels], "max_drawdown"]


def risk_metrics(returns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Volatilities, downside deviation, VaR and CVaR at each level (both positive), and the maximum drawdown."""
    return unpivot(wide(returns, settings), risk_names(settings), "risk")


ADJUSTED = ["sharpe", "sortino", "calmar"]


def risk_adjusted(returns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return unpivot(wide(returns, settings), ADJUSTED, "risk_adjusted")


def metrics_per_ticker(returns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All of them in long form, out of the one aggregation."""
    kinds = {**dict.fromkeys(RETURN_METRICS, "return"), **dict.fromkeys(risk_names(settings), "risk"), **dict.fromkeys(ADJUSTED, "risk_adjusted")}
    category = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return wide(returns, settings).unpivot("ticker", list(kinds), "metric_name", "value").withColumn("category", category[F.col("metric_name")])


def drawdown_series(prices: DataFrame) -> DataFrame:
    """(date, ticker, close, running_peak, drawdown_pct), from prices."""
    peak = F.max("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return prices.select("date", "ticker", "close", peak.alias("running_peak")).withColumn("drawdown_pct", F.try_divide(F.col("close"), F.col("running_peak")) - 1)


def beta_per_ticker(returns: DataFrame, benchmark: str) -> DataFrame:
    """(ticker, beta) against the benchmark on common dates; the benchmark itself has null."""
    b = returns.where(F.col("ticker") == benchmark).select("date", F.col("simple_return").alias("b"))
    both = returns.join(b, "date").groupBy("ticker").agg(F.when(F.count("*") > 1, ratio(F.covar_samp("simple_return", "b"), F.var_samp("b"))).alias("beta"))
    return returns.select("ticker").distinct().join(both, "ticker", "left").select("ticker", F.when(F.col("ticker") != benchmark, F.col("beta")).alias("beta"))


def invariants(returns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return broken_rules(wide(returns, settings), settings)


def broken_rules(w: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(ticker, broken) of the tickers whose metrics break a rule: VaR at a higher level below one at a lower, CVaR below VaR, a positive drawdown."""
    names = [level_name("var", x) for x in sorted(settings.var_levels)]
    rules = [F.when(F.col(b) < F.col(a), f"{b}<{a}") for a, b in zip(names, names[1:], strict=False)]
    rules += [F.when(F.col(level_name("cvar", x)) < F.col(level_name("var", x)), f"{level_name('cvar', x)}<{level_name('var', x)}") for x in settings.cvar_levels if x in settings.var_levels]
    rules.append(F.when(F.col("max_drawdown") > 0, "max_drawdown>0"))
    return w.select("ticker", F.array_compact(F.array(*rules)).alias("broken")).where(F.size("broken") > 0)


# ── rolling ──────────────────────────────────────────────────────────────────
def _rolled(returns: DataFrame, value: Column, window: int) -> DataFrame:
    """Only where the window is full and the value defined."""
    full = F.count("*").over(last_rows(window)) == window
    return returns.select("date", "ticker", F.when(full, value).alias("value")).where("value IS NOT NULL")


def rolling_sharpe(returns: DataFrame, window: int = DEFAULTS.sharpe_window, settings: Settings = DEFAULTS) -> DataFrame:
    """Infinite values (no deviation) are null here and so left out."""
    w, year = last_rows(window), float(settings.days_per_year)
    r = F.col("simple_return")
    return _rolled(returns, ratio(F.avg(r).over(w) - settings.risk_free_rate / year, F.stddev_samp(r).over(w)) * year**0.5, window)


def rolling_volatility(returns: DataFrame, window: int = DEFAULTS.sharpe_window, settings: Settings = DEFAULTS) -> DataFrame:
    return _rolled(returns, F.stddev_samp("simple_return").over(last_rows(window)) * float(settings.days_per_year) ** 0.5, window)


def _with_benchmark(returns: DataFrame, benchmark: str, least: int) -> DataFrame:
    """Common dates with the benchmark's return b, of tickers that have `least` returns."""
    b = returns.where(F.col("ticker") == benchmark).select("date", F.col("simple_return").alias("b"))
    long = returns.groupBy("ticker").count().where(F.col("count") >= least).select("ticker")
    return returns.join(long, "ticker", "left_semi").join(b, "date")


def rolling_beta(returns: DataFrame, benchmark: str, window: int = DEFAULTS.beta_window, least: int = DEFAULTS.sharpe_window) -> DataFrame:
    w = last_rows(window)
    return _rolled(_with_benchmark(returns, benchmark, least), ratio(F.covar_samp("simple_return", "b").over(w), F.var_samp("b").over(w)), window)


def rolling_corr(returns: DataFrame, benchmark: str, window: int = DEFAULTS.corr_window, least: int = DEFAULTS.sharpe_window) -> DataFrame:
    return _rolled(_with_benchmark(returns, benchmark, least), correlation(F.col("simple_return"), F.col("b"), last_rows(window)), window)


def rolling_metrics(returns: DataFrame, benchmark: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """All rolling metrics in long form, named with their windows."""
    s, b, c = settings.sharpe_window, settings.beta_window, settings.corr_window
    year, r, w = float(settings.days_per_year), F.col("simple_return"), last_rows(settings.sharpe_window)
    many = F.count("*").over(Window.partitionBy("ticker"))
    full = lambda k: F.count("*").over(last_rows(k)) == k
    sharpe = ratio(F.avg(r).over(w) - settings.risk_free_rate / year, F.stddev_samp(r).over(w)) * year**0.5
    # the metrics of one set of rows share its windows
    own = returns.withColumn("_n", many).where(F.col("_n") >= s).select("date", "ticker", F.when(full(s), sharpe).alias(f"rolling_sharpe_{s}"), F.when(full(s), F.stddev_samp(r).over(w) * year**0.5).alias(f"rolling_volatility_{s}"))
    out = own.unpivot(["date", "ticker"], own.columns[2:], "metric_name", "value")
    if benchmark:
        x = F.col("b")
        both = _with_benchmark(returns, benchmark, s).select("date", "ticker", F.when(full(b), ratio(F.covar_samp(r, x).over(last_rows(b)), F.var_samp(x).over(last_rows(b)))).alias(f"rolling_beta_{b}"), F.when(full(c), correlation(r, x, last_rows(c))).alias(f"rolling_corr_{c}"))
        out = out.unionByName(both.unpivot(["date", "ticker"], both.columns[2:], "metric_name", "value"))
    return out.where("value IS NOT NULL")


# ── portfolio ────────────────────────────────────────────────────────────────
def resolve_weights(tickers: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """Equal weights, or the given ones if they cover just these tickers and add up to 1."""
    if weights is None:
        return {t: 1 / len(tickers) for t in tickers} if tickers else {}
    missing, extra = sorted(set(tickers) - set(weights)), sorted(set(weights) - set(tickers))
    if missing or extra:
        raise ValueError(f"weights lack {missing} and have {extra} besides")
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"weights add up to {sum(weights.values())}")
    return weights


def portfolio_returns(returns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(date, simple_return) on the dates on which every ticker has a return; a repeated key raises."""
    own = returns.where(F.col("ticker").isin(list(weights)))
    w = F.create_map(*[F.lit(x) for t, v in weights.items() for x in (t, float(v))])
    twice = F.count("*") > F.count_distinct("ticker")
    day = own.groupBy("date").agg(F.sum(w[F.col("ticker")] * F.col("simple_return")).alias("simple_return"), F.count("simple_return").alias("n"), F.when(twice, F.raise_error(F.lit("a date has a ticker twice"))).alias("e"))
    return day.where((F.col("n") == len(weights)) & F.col("e").isNull()).select("date", "simple_return")


def portfolio_metrics(returns: DataFrame, weights: dict[str, float] | None = None, benchmark: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: return, risk, beta, diversification ratio, and the weights used."""
    exclude = benchmark if settings.exclude_benchmark else None
    tickers = [r.ticker for r in returns.select("ticker").distinct().orderBy("ticker").collect() if r.ticker != exclude]
    used = resolve_weights(tickers, weights)
    day = portfolio_returns(returns, used)
    r, year, days = F.col("simple_return"), float(settings.days_per_year) ** 0.5, settings.days_per_year
    down = F.when(r < 0, r)
    base = day.agg((F.product(1 + r) - 1).alias("total_return"), F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.when(F.count(down) > 1, F.stddev_samp(down)).alias("down"))
    levels = sorted({*settings.var_levels, *settings.cvar_levels})
    t = tail(day, levels, keys=())
    low = growth(day, keys=()).agg(F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"))
    own = returns.where(F.col("ticker").isin(list(used))).groupBy("ticker").agg(F.stddev_samp("simple_return").alias("sd_own"))
    w = F.create_map(*[F.lit(x) for k, v in used.items() for x in (k, float(v))])
    spread = own.agg(F.sum(w[F.col("ticker")] * F.col("sd_own")).alias("spread"))
    if benchmark:
        b = returns.where(F.col("ticker") == benchmark).select("date", F.col("simple_return").alias("b"))
        beta = day.join(b, "date").agg(F.when(F.count("*") > 1, ratio(F.covar_samp("simple_return", "b"), F.var_samp("b"))).alias("beta"))
    else:
        beta = day.limit(0).agg(F.max("simple_return").alias("beta"))
    one = base
    for part in (t, low, spread, beta):  # a row each
        one = one.crossJoin(F.broadcast(part))
    cagr = F.pow(1 + F.col("total_return"), days / F.col("n")) - 1
    excess = F.col("mean") * days - settings.risk_free_rate
    return one.select(
        "total_return", cagr.alias("cagr"), (F.col("sd") * year).alias("annual_vol"), ratio(excess, F.col("sd") * year).alias("sharpe"), ratio(excess, F.col("down") * year).alias("sortino"),
        ratio(cagr, F.abs("max_drawdown")).alias("calmar"), "max_drawdown", *[F.abs(f"q_{int(x * 100)}").alias(level_name("var", x)) for x in settings.var_levels], *[F.abs(f"t_{int(x * 100)}").alias(level_name("cvar", x)) for x in settings.cvar_levels],
        F.col("beta").alias("beta_vs_benchmark"), ratio(F.col("spread"), F.col("sd")).alias("diversification_ratio"), F.lit("equal" if weights is None else "custom").alias("weights_strategy"), F.lit(json.dumps({k: round(v, 8) for k, v in used.items()})).alias("weights_used"),
    )
