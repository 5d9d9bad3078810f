"""Monte Carlo paths and what is read off them.

A path is a row with an array of values from day 0 to the horizon, so that drawing and compounding need no
shuffle; draws are keyed (functions.rng).  Summaries group by scenario and ticker.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.calendar import business_day
from ..functions.rng import normal, scenario_seed, uniform
from .eda import correlation_pairs
from .metrics import resolve_weights, tail

METHODS = ("gbm", "bootstrap", "block_bootstrap")
PORTFOLIO = "PORTFOLIO"
KEYS = ["scenario_name", "ticker"]
_TICKER = re.compile(r"[A-Z0-9.\-]{1,15}")
#: Simulations of a ticker that are drawn side by side.
RUNS = 1024
#: Bytes of Cholesky's factor up to which it is broadcast (some 2,000 tickers).
FACTOR_BYTES = 1 << 25


@dataclass(frozen=True)
class Scenario:
    name: str
    method: str
    horizon: int
    n_simulations: int
    block_size: int | None = None
    drift: str | None = None
    tickers: str | None = None
    portfolio: bool = True


def gbm_params(returns: DataFrame, settings: Settings = DEFAULTS, drift: str = "historical") -> DataFrame:
    """(ticker, mu_daily, sigma_daily, mu_annual, sigma_annual, n_observations) from log returns; zero drift sets mu to 0."""
    r, days = F.col("log_return"), settings.days_per_year
    mu = F.lit(0.0) if drift == "zero" else F.coalesce(F.avg(r), F.lit(0.0))
    sigma = F.when(F.count(r) > 1, F.stddev_samp(r)).otherwise(0.0)
    return returns.groupBy("ticker").agg(mu.alias("mu_daily"), sigma.alias("sigma_daily"), (mu * days).alias("mu_annual"), (sigma * float(days) ** 0.5).alias("sigma_annual"), F.count(r).alias("n_observations"))


def last_prices(prices: DataFrame) -> DataFrame:
    """(ticker, s0, last_date): the last close that isn't null, and its date."""
    return prices.where("close IS NOT NULL").groupBy("ticker").agg(F.max_by("close", "date").alias("s0"), F.max("date").alias("last_date"))


def parse_tickers(text: str | None, known: list[str]) -> tuple[list[str], list[str]]:
    """The tickers a scenario names that are known, and those that aren't; null or 'all': every one."""
    if text is None or text.strip() == "all":
        return known, []
    asked = [t.strip() for t in text.split(",") if t.strip()]
    wrong = [t for t in asked if not _TICKER.fullmatch(t)]
    if wrong:
        raise ValueError(f"not a ticker: {wrong[0]}")
    return [t for t in asked if t in known], [t for t in asked if t not in known]


def parse_bool(value, default: bool) -> bool:
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return default
    return value.strip().lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)


def _runs(own: DataFrame, n: int) -> DataFrame:
    """A row of each ticker for each simulation: tickers are dealt out with blocks of RUNS simulations, nothing is broadcast."""
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = own.where(F.lit(n > 0)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0) // RUNS)))).repartition(parts, "ticker", "_block")
    first = F.col("_block").cast("long") * RUNS
    return blocks.withColumn("simulation_id", F.explode(F.sequence(first, F.least(first + RUNS, F.lit(n).cast("long")) - 1))).drop("_block")


def _days(horizon: int) -> Column:
    return F.sequence(F.lit(1), F.lit(horizon))


def _running(steps: Column, first: Column, op) -> Column:
    """first, then op applied along the steps."""
    return F.aggregate(steps, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))


def _path(scenario: Scenario, df: DataFrame, values: Column) -> DataFrame:
    return df.select(F.lit(scenario.name).alias("scenario_name"), "ticker", F.lit(scenario.method).alias("method"), "simulation_id", "s0", values.alias("values"))


def simulate_gbm(scenario: Scenario, params: DataFrame, s0: DataFrame, seed: int) -> DataFrame:
    """Geometric Brownian motion with the Ito correction; one row per ticker and simulation."""
    df = _runs(params.join(s0, "ticker"), scenario.n_simulations)
    z = lambda d: normal(F.lit(seed), F.col("ticker"), F.col("simulation_id"), d)
    steps = F.transform(_days(scenario.horizon), lambda d: F.col("mu_daily") - 0.5 * F.col("sigma_daily") * F.col("sigma_daily") + F.col("sigma_daily") * z(d))
    logs = _running(steps, F.lit(0.0), lambda a, x: a + x)
    return _path(scenario, df, F.transform(logs, lambda x: F.col("s0") * F.exp(x)))


def history(returns: DataFrame) -> DataFrame:
    """(ticker, hist): a ticker's simple returns by date."""
    return returns.where("simple_return IS NOT NULL").groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "simple_return"))), lambda x: x.simple_return).alias("hist"))


def simulate_bootstrap(scenario: Scenario, returns: DataFrame, s0: DataFrame, seed: int, block: int = 1) -> DataFrame:
    """Resampled returns, compounded: day by day, or in circular blocks of consecutive ones.

    A ticker with one return or none keeps its price; a block as long as a history raises.
    """
    hist = history(returns).join(s0, "ticker")
    if block > 1 and (short := hist.where(F.size("hist") <= block).select("ticker").first()):
        raise ValueError(f"block_size {block} is not below the number of returns of {short.ticker}")
    df = _runs(hist, scenario.n_simulations)
    n = F.size("hist")
    start = lambda d: F.floor(uniform(F.lit(seed), F.col("ticker"), F.col("simulation_id"), F.floor((d - 1) / block)) * n)
    at = lambda d: (start(d) + (d - 1) % block) % n
    steps = F.transform(_days(scenario.horizon), lambda d: F.when(n > 1, F.col("hist")[at(d).cast("int")]).otherwise(0.0))
    grown = _running(steps, F.lit(1.0), lambda a, x: a * (1 + x))
    return _path(scenario, df, F.transform(grown, lambda x: F.col("s0") * x))


def is_positive_definite(m: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(m)
        return True
    except np.linalg.LinAlgError:
        return False


def nearest_positive_definite(m: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Eigenvalues raised to `floor`, then the diagonal scaled back to 1."""
    value, vector = np.linalg.eigh((m + m.T) / 2)
    out = (vector * np.maximum(value, floor)) @ vector.T
    d = np.sqrt(np.diag(out))
    return out / np.outer(d, d)


def correlation_of(returns: DataFrame, tickers: list[str]) -> np.ndarray:
    """The tickers' matrix of correlations of log returns, on the driver: it is as large as the portfolio is wide."""
    at = {t: k for k, t in enumerate(tickers)}
    out = np.eye(len(tickers))
    for r in correlation_pairs(returns.where(F.col("ticker").isin(tickers)), "log_return", unique=True).collect():
        out[at[r.a], at[r.b]] = out[at[r.b], at[r.a]] = np.nan if r["corr"] is None else r["corr"]
    return out


def simulate_correlated(scenario: Scenario, params: DataFrame, s0: DataFrame, corr: np.ndarray, tickers: list[str], seed: int) -> DataFrame:
    """GBM of all tickers with correlated draws: each simulation draws once for every ticker and mixes by Cholesky's factor."""
    if np.isnan(corr).any():
        raise ValueError("the correlation matrix has a null")
    lower = np.linalg.cholesky(corr if is_positive_definite(corr) else nearest_positive_definite(corr))
    own = {r.ticker: r for r in params.join(s0, "ticker").where(F.col("ticker").isin(tickers)).collect()}
    spark = params.sparkSession
    # a row of the factor for each ticker
    rows = spark.createDataFrame([(t, float(own[t].mu_daily), float(own[t].sigma_daily), float(own[t].s0), lower[k].tolist()) for k, t in enumerate(tickers)], "ticker string, mu double, sigma double, s0 double, factor array<double>")
    z = F.transform(F.array(*[F.lit(t) for t in tickers]), lambda t: F.transform(_days(scenario.horizon), lambda d: normal(F.lit(seed), t, F.col("simulation_id"), d)))
    df = spark.range(scenario.n_simulations).withColumnRenamed("id", "simulation_id").withColumn("z", z).crossJoin(F.broadcast(rows) if lower.nbytes <= FACTOR_BYTES else rows)
    mixed = lambda d: F.aggregate(F.zip_with(F.col("factor"), F.col("z"), lambda a, b: a * F.element_at(b, d)), F.lit(0.0), lambda acc, x: acc + x)
    steps = F.transform(_days(scenario.horizon), lambda d: F.col("mu") - 0.5 * F.col("sigma") * F.col("sigma") + F.col("sigma") * mixed(d))
    logs = _running(steps, F.lit(0.0), lambda a, x: a + x)
    return _path(scenario, df, F.transform(logs, lambda x: F.col("s0") * F.exp(x)))


def portfolio_paths(paths: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted sum of the tickers' paths, each from 1."""
    w = F.create_map(*[F.lit(x) for t, v in weights.items() for x in (t, float(v))])
    rows = paths.where(F.col("ticker").isin(list(weights))).select("scenario_name", "method", "simulation_id", F.posexplode(F.transform("values", lambda v: w[F.col("ticker")] * v / F.col("s0"))).alias("day", "v"))
    days = rows.groupBy("scenario_name", "method", "simulation_id", "day").agg(F.sum("v").alias("v"))
    whole = days.groupBy("scenario_name", "method", "simulation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "v"))), lambda x: x.v).alias("values"))
    return whole.select("scenario_name", F.lit(PORTFOLIO).alias("ticker"), "method", "simulation_id", F.lit(1.0).alias("s0"), "values")


def run_scenario(scenario: Scenario, prices: DataFrame, returns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All paths of a scenario, with the portfolio's if it is asked for and two tickers or more are simulated."""
    if scenario.method not in METHODS:
        raise ValueError(f"unknown method: {scenario.method}")
    known = sorted(r.ticker for r in last_prices(prices).select("ticker").collect())
    tickers, _ = parse_tickers(scenario.tickers, known)
    own, s0 = returns.where(F.col("ticker").isin(tickers)), last_prices(prices).where(F.col("ticker").isin(tickers))
    seed = scenario_seed(settings.seed, scenario.name)
    # a global drift of zero holds for every scenario
    params = gbm_params(own, settings, "zero" if "zero" in (settings.drift, scenario.drift) else "historical")
    both = scenario.portfolio and len(tickers) >= 2
    if scenario.method == "gbm" and both and settings.use_correlation:
        paths = simulate_correlated(scenario, params, s0, correlation_of(own, tickers), tickers, seed)
    elif scenario.method == "gbm":
        paths = simulate_gbm(scenario, params, s0, seed)
    else:
        paths = simulate_bootstrap(scenario, own, s0, seed, 1 if scenario.method == "bootstrap" else scenario.block_size or settings.block_size)
    return paths.unionByName(portfolio_paths(paths, resolve_weights(tickers, settings.weights))) if both else paths


# ── what is read off the paths ───────────────────────────────────────────────
def terminal(paths: DataFrame) -> DataFrame:
    return paths.select("scenario_name", "ticker", "method", "s0", F.element_at("values", -1).alias("t"), (F.element_at("values", -1) / F.col("s0") - 1).alias("r"))


def path_percentiles(paths: DataFrame, last_date=None, settings: Settings = DEFAULTS) -> DataFrame:
    """(scenario_name, ticker, method, day_offset, date, percentile, value) over the simulations of each day."""
    days = paths.select("scenario_name", "ticker", "method", F.posexplode("values").alias("day_offset", "v"))
    points = F.array(*[F.lit(p / 100) for p in settings.percentiles])
    out = days.groupBy("scenario_name", "ticker", "method", "day_offset").agg(F.percentile("v", points).alias("q"))
    out = out.select("scenario_name", "ticker", "method", F.col("day_offset").cast("long").alias("day_offset"), F.posexplode("q").alias("k", "value"))
    date = business_day(F.lit(last_date), F.col("day_offset")) if last_date is not None else F.lit(None).cast("date")
    return out.select("scenario_name", "ticker", "method", "day_offset", date.alias("date"), F.array(*[F.lit(p) for p in settings.percentiles])[F.col("k")].alias("percentile"), "value")


def terminal_distribution(paths: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Mean, deviation, biased skewness and kurtosis, and percentiles of the last value and of its return."""
    name = lambda p: f"{p:g}"
    q = F.array(*[F.lit(p / 100) for p in settings.percentiles])
    out = terminal(paths).groupBy("scenario_name", "ticker", "method", "s0").agg(F.avg("t").alias("terminal_mean"), F.stddev_samp("t").alias("terminal_std"), F.skewness("t").alias("terminal_skew"), F.kurtosis("t").alias("terminal_kurtosis"), F.percentile("t", q).alias("q"), F.percentile("r", q).alias("rq"))
    return out.select("scenario_name", "ticker", "method", "s0", "terminal_mean", "terminal_std", "terminal_skew", "terminal_kurtosis", *[F.col("q")[k].alias(f"terminal_p{name(p)}") for k, p in enumerate(settings.percentiles)], *[F.col("rq")[k].alias(f"return_p{name(p)}") for k, p in enumerate(settings.percentiles)])


def simulated_var_cvar(paths: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(scenario_name, ticker, method, metric_name, value): losses positive, so a quantile above 0 gives a negative VaR."""
    keys, tag = ["scenario_name", "ticker", "method"], lambda x: int(round(x * 100))
    levels = sorted({*settings.var_levels, *settings.cvar_levels})
    own = tail(terminal(paths), levels, tuple(keys), "r")
    name = lambda kind, x: F.col(f"{kind}_{int(x * 100)}")
    wide = own.select(*keys, *[(-name("q", x)).alias(f"var_{tag(x)}") for x in settings.var_levels], *[(-F.coalesce(name("t", x), F.lit(0.0))).alias(f"cvar_{tag(x)}") for x in settings.cvar_levels])
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "metric_name", "value")


def threshold_name(t: float) -> str:
    if t == 0:
        return "prob_loss"
    return f"prob_loss_{round(-t * 100)}pct" if t < 0 else f"prob_gain_lt_{round(t * 100)}pct"


def loss_probabilities(paths: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(scenario_name, ticker, method, metric_name, value): the share of simulations that end below each threshold."""
    keys, names = ["scenario_name", "ticker", "method"], [threshold_name(t) for t in settings.thresholds]
    wide = terminal(paths).groupBy(*keys).agg(*[F.avg((F.col("r") < t).cast("double")).alias(n) for t, n in zip(settings.thresholds, names, strict=True)])
    return wide.unpivot(keys, names, "metric_name", "value")


def path_drawdowns(paths: DataFrame) -> DataFrame:
    """Mean, median, 5 and 1 percent quantiles of the paths' maximum drawdowns, and the share beyond 20 percent."""
    step = lambda acc, x: F.struct(F.greatest(acc.peak, x).alias("peak"), F.least(acc.low, x / F.greatest(acc.peak, x) - 1).alias("low"))
    low = F.aggregate("values", F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("low")), step, lambda acc: acc.low)
    own = paths.select("scenario_name", "ticker", "method", low.alias("d"))
    q = F.percentile("d", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.01)))
    return own.groupBy("scenario_name", "ticker", "method").agg(F.avg("d").alias("mean_max_drawdown"), q[0].alias("median_max_drawdown"), q[1].alias("p5_max_drawdown"), q[2].alias("p1_max_drawdown"), F.avg((F.col("d") < -0.2).cast("double")).alias("prob_drawdown_exceeds_20pct"))


def full_paths(paths: DataFrame) -> DataFrame:
    """(scenario_name, ticker, simulation_id, day_offset, value): a row for each day."""
    return paths.select("scenario_name", "ticker", "simulation_id", F.posexplode("values").alias("day_offset", "value")).withColumn("day_offset", F.col("day_offset").cast("long"))


def method_comparison(mc_metrics: DataFrame) -> DataFrame:
    """(scenario_name, var_95, cvar_95) of the portfolio."""
    own = mc_metrics.where((F.col("ticker") == PORTFOLIO) & F.col("metric_name").isin("var_95", "cvar_95"))
    return own.groupBy("scenario_name").agg(*[F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in ("var_95", "cvar_95")])


def interpretation(comparison: list[tuple[str, float]]) -> str | None:
    """A sentence on the bootstrap's VaR against the first GBM scenario's; comparison: names and VaR in order."""
    gbm = next((v for n, v in comparison if "gbm" in n), None)
    boot = next((v for n, v in comparison if "bootstrap" in n and "block" not in n), None)
    if not gbm or not boot or gbm <= 0:
        return None
    more = boot > gbm
    return f"The bootstrap's VaR is {abs(boot - gbm) / gbm * 100:.1f}% {'above' if more else 'not above'} that of GBM: {'past returns have fat tails' if more else 'GBM covers the tail'}."


def broken_invariants(mc_metrics: DataFrame) -> DataFrame:
    """(scenario_name, ticker, broken): VaR 99 below VaR 95, or CVaR 95 below VaR 95."""
    w = mc_metrics.groupBy(*KEYS).agg(*[F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in ("var_95", "var_99", "cvar_95")])
    rules = F.array_compact(F.array(F.when(F.col("var_99") < F.col("var_95"), "var_99<var_95"), F.when(F.col("cvar_95") < F.col("var_95"), "cvar_95<var_95")))
    return w.select(*KEYS, F.explode(rules).alias("broken"))
