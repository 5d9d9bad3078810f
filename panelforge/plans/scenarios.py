"""Queries on forecasts and simulations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.rng import scenario_seed
from ..functions.stats import interval_z
from ..operators import cleaning, forecast, simulate
from ..sources import bars as B
from . import sql as S
from .panel import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, digits: int = 6):
    def add(f):
        QUERIES[name] = lambda s, d: rounded(f(s, d), digits)
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


# ── forecasts ────────────────────────────────────────────────────────────────
H, LEVEL = 30, 0.95
Z = repr(interval_z(LEVEL))
BASE = (S.orders("day"), S.RETURNS)
DATA = {
    "returns": "ser AS (SELECT ticker, date, r AS y FROM rets)",
    "prices": "ser AS (SELECT ticker, date, ln(close) AS y FROM bars)",
}


def _panel(s: SparkSession, d: str, grain: str = "day") -> tuple[DataFrame, DataFrame]:
    p = B.order_bars(s, d, grain)
    return p, cleaning.compute_returns(p)


def _data(s: SparkSession, d: str, target: str, grain: str = "day") -> DataFrame:
    return forecast.series(*_panel(s, d, grain), target)


def _naive_sql(method: str, source: str, keys: str) -> str:
    point = {"random_walk": "last", "drift": "last + drift * step", "mean": "mean"}[method]
    half = f"{Z} * sd" if method == "mean" else f"{Z} * sd_step * sqrt(step)"
    return f"""SELECT {keys}, step, {point} AS forecast, {point} - {half} AS lower_ci, {point} + {half} AS upper_ci FROM (SELECT *, unnest(range(1, {H + 1})) AS step FROM (
        SELECT {keys}, count(*) AS n, arg_max(y, date) AS last, avg(y) AS mean, stddev_samp(y) AS sd, avg(dy) AS drift, stddev_samp(dy) AS sd_step FROM (SELECT *, y - lag(y) OVER (PARTITION BY {keys} ORDER BY date) AS dy FROM {source}) GROUP BY {keys}) WHERE n >= 2)"""


for _name, _method, _target in (("naive_random_walk", "random_walk", "returns"), ("naive_drift", "drift", "prices"), ("naive_mean", "mean", "returns")):

    @query(_name, S.build(*BASE, DATA[_target], select=f"SELECT ticker, step::INTEGER AS step, round(forecast, 6) AS forecast, round(lower_ci, 6) AS lower_ci, round(upper_ci, 6) AS upper_ci FROM ({_naive_sql(_method, 'ser', 'ticker')})"))
    def _(s, d, method=_method, target=_target):
        return forecast.naive(_data(s, d, target), method, H, LEVEL)


FOLDS = f"""num AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM ser),
    folds AS (SELECT ticker, fold, 0::BIGINT AS train_start, {DEFAULTS.train_initial} + fold * {DEFAULTS.step} AS train_end FROM (SELECT ticker, unnest(range(0, (n - {DEFAULTS.train_initial} - {H}) // {DEFAULTS.step} + 1)) AS fold FROM (SELECT DISTINCT ticker, n FROM num WHERE n >= {DEFAULTS.train_initial + H}))),
    train AS (SELECT num.ticker, fold, date, y FROM num JOIN folds ON num.ticker = folds.ticker AND i < train_end),
    test AS (SELECT num.ticker, fold, date, y, i - train_end + 1 AS step FROM num JOIN folds ON num.ticker = folds.ticker AND i >= train_end AND i < train_end + {H}),
    ends AS (SELECT ticker, fold, min(date) AS fold_start_date, max(date) AS fold_end_date FROM train GROUP BY 1, 2)"""


def _walk(method: str) -> str:
    return f"walk AS (SELECT ticker, fold, fold_start_date, fold_end_date, date AS forecast_date, y AS actual, forecast AS predicted, lower_ci, upper_ci FROM test JOIN ({_naive_sql(method, 'train', 'ticker, fold')}) USING (ticker, fold, step) JOIN ends USING (ticker, fold))"


@query("walk_forward_folds", S.build(*BASE, DATA["returns"], FOLDS, select="SELECT ticker, fold, train_start, train_end FROM folds"))
def _(s, d):
    return forecast.folds(_data(s, d, "returns"), DEFAULTS.train_initial, DEFAULTS.step, H)


for _name, _method, _target in (("walk_forward_random_walk", "random_walk", "returns"), ("walk_forward_drift", "drift", "prices"), ("walk_forward_mean", "mean", "returns")):

    @query(_name, S.build(*BASE, DATA[_target], FOLDS, _walk(_method), select="SELECT ticker, fold, fold_start_date, fold_end_date, forecast_date, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(lower_ci, 6) AS lower_ci, round(upper_ci, 6) AS upper_ci FROM walk"))
    def _(s, d, method=_method, target=_target):
        return forecast.walk_forward(_data(s, d, target), f"naive_{method}", H, LEVEL, DEFAULTS)


_MEASURE = """SELECT ticker, sqrt(avg((actual - predicted) ^ 2)) AS rmse, avg(abs(actual - predicted)) AS mae, avg(abs((actual - predicted) / actual)) FILTER (abs(actual) > 1e-8) * 100 AS mape, avg((sign(predicted) = sign(actual))::INT) AS directional_accuracy,
    avg((lower_ci <= actual AND actual <= upper_ci)::INT) AS coverage_rate, avg(upper_ci - lower_ci) AS mean_interval_width, count(DISTINCT fold)::DOUBLE AS n_folds, count(*)::DOUBLE AS n_predictions FROM {} GROUP BY ticker"""
_NAMES = ", ".join(forecast.METRICS)


@query("forecast_metrics", S.build(*BASE, DATA["returns"], FOLDS, _walk("mean"), f"m AS ({_MEASURE.format('walk')})", select=f"SELECT ticker, metric_name, round(value, 6) AS value FROM (UNPIVOT m ON {_NAMES} INTO NAME metric_name VALUE value)"))
def _(s, d):
    return forecast.forecast_metrics(forecast.walk_forward(_data(s, d, "returns"), "naive_mean", H, LEVEL, DEFAULTS))


def _three(s: SparkSession, d: str) -> DataFrame:
    p, r = _panel(s, d)
    out = None
    for m in ("naive_random_walk", "naive_drift", "naive_mean"):
        part = forecast.run_scenario(forecast.Scenario(f"s_{m}", m, "returns", H, LEVEL), p, r, DEFAULTS)[1]
        out = part if out is None else out.unionByName(part)
    return out


_ALL = ", ".join(f"w_{m} AS ({_walk(m)[len('walk AS ('):-1]})" for m in ("random_walk", "drift", "mean"))
# a series that is long enough for a forecast and too short for a fold has metrics, all null
_NAMED = f"(SELECT ticker FROM ser GROUP BY ticker HAVING count(*) >= {max(H, DEFAULTS.min_observations)})"
_MET = "met AS (" + " UNION ALL ".join(f"SELECT 's_naive_{m}' AS scenario_name, 'naive_{m}' AS model, * FROM {_NAMED} LEFT JOIN ({_MEASURE.format(f'w_{m}')}) USING (ticker)" for m in ("random_walk", "drift", "mean")) + ")"


@query("best_model_per_ticker", S.build(*BASE, DATA["returns"], FOLDS, _ALL, _MET, select="SELECT ticker, arg_min(model, (rmse, scenario_name)) FILTER (rmse IS NOT NULL) AS model, round(min(rmse), 6) AS rmse, CASE WHEN arg_min(model, (rmse, scenario_name)) FILTER (rmse IS NOT NULL) <> 'naive_random_walk' THEN min(rmse) < min(rmse) FILTER (model = 'naive_random_walk') END AS beats_random_walk FROM met GROUP BY ticker"))
def _(s, d):
    return forecast.best_models(_three(s, d))


@query("scenario_averages", S.build(*BASE, DATA["returns"], FOLDS, _ALL, _MET, select="SELECT scenario_name, round(avg(rmse), 6) AS mean_rmse, round(avg(coverage_rate), 6) AS mean_coverage, count(DISTINCT ticker) AS n_tickers FROM met GROUP BY 1"))
def _(s, d):
    return forecast.scenario_averages(_three(s, d))


@query("forecast_scenario", S.build(*BASE, DATA["prices"], "ld AS (SELECT ticker, max(date) AS last_date FROM ser GROUP BY ticker)", select=f"""SELECT 'drift' AS scenario_name, ticker, 'naive_drift' AS model_type, 'prices' AS target, d AS forecast_date, round(forecast, 6) AS forecast, round(lower_ci, 6) AS lower_ci, round(upper_ci, 6) AS upper_ci, 0.95::DOUBLE AS confidence_level
    FROM ({_naive_sql('drift', 'ser', 'ticker')}) JOIN (SELECT ticker, d::DATE AS d, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS step FROM (SELECT ticker, unnest(generate_series(last_date, last_date + INTERVAL 60 DAY, INTERVAL 1 DAY)) AS d FROM ld) WHERE isodow(d) < 6) USING (ticker, step)"""))  # fmt: skip
def _(s, d):
    return forecast.run_scenario(forecast.Scenario("drift", "naive_drift", "prices", H, LEVEL), *_panel(s, d), DEFAULTS)[0]


@query("stationarity_adf")
def _(s, d):
    return forecast.stationarity(_panel(s, d)[1])


# an ARIMA search takes seconds a fit: weekly bars
@query("forecast_arima")
def _(s, d):
    return forecast.fitted(_data(s, d, "returns", "week"), "arima_returns", H, LEVEL)


@query("forecast_arima_log_prices")
def _(s, d):
    return forecast.fitted(_data(s, d, "prices", "week"), "arima_log_prices", H, LEVEL)


@query("forecast_trend_seasonal")
def _(s, d):
    return forecast.fitted(_data(s, d, "prices"), "prophet", H, LEVEL)


@query("walk_forward_arima")
def _(s, d):
    return forecast.walk_forward(_data(s, d, "returns", "week"), "arima_returns", H, LEVEL, DEFAULTS)


@query("walk_forward_trend_seasonal")
def _(s, d):
    return forecast.walk_forward(_data(s, d, "prices"), "prophet", H, LEVEL, DEFAULTS)


# ── simulations ──────────────────────────────────────────────────────────────
N, DAYS, BLOCK = 10_000, 30, 10
CALM = "bars AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, o_orderpriority AS ticker, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)"
PANEL = (CALM, S.RETURNS, "s0 AS (SELECT ticker, arg_max(close, date) AS s0 FROM bars GROUP BY ticker)", "par AS (SELECT ticker, avg(lr) AS mu, coalesce(stddev_samp(lr), 0) AS sigma, count(lr) AS n FROM rets GROUP BY ticker)")
TICKERS = "(SELECT DISTINCT ticker FROM rets)"


def calm(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Monthly mean order totals by priority: a panel of modest moves."""
    p = B.table(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("ticker")).agg(F.avg("o_totalprice").alias("close"))
    return p, cleaning.compute_returns(p)


def _u(seed: int, *key: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(key)})), 1, 13))::BIGINT + 1) / {2.0**52 + 1!r})"


def _normal(seed: int, *key: str) -> str:
    return f"sqrt(-2 * ln({_u(seed, *key, repr('a'))})) * cos({2 * math.pi!r} * {_u(seed, *key, repr('b'))})"


GRID = f"grid AS (SELECT ticker, sim, day FROM {TICKERS} CROSS JOIN range({N}) t(sim) CROSS JOIN range(1, {DAYS + 1}) u(day))"


def paths_sql(method: str, seed: int) -> tuple[str, ...]:
    if method == "gbm":
        steps = f"steps AS (SELECT ticker, sim, day, exp(sum(mu - 0.5 * sigma * sigma + sigma * ({_normal(seed, 'ticker', 'sim', 'day')})) OVER (PARTITION BY ticker, sim ORDER BY day)) AS g FROM grid JOIN par USING (ticker))"
        own = (GRID, steps)
    else:
        b = 1 if method == "bootstrap" else BLOCK
        hist = "hist AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS n FROM rets)"
        at = f"drawn AS (SELECT grid.*, ((floor({_u(seed, 'ticker', 'sim', f'(day - 1) // {b}')} * n))::BIGINT + (day - 1) % {b}) % n AS k FROM grid JOIN par USING (ticker))"
        steps = "steps AS (SELECT ticker, sim, day, product(1 + r) OVER (PARTITION BY ticker, sim ORDER BY day) AS g FROM drawn JOIN hist USING (ticker, k))"
        own = (GRID, hist, at, steps)
    return (*PANEL, *own, "paths AS (SELECT ticker, sim, day, s0 * g AS v, s0 FROM steps JOIN s0 USING (ticker) UNION ALL SELECT ticker, sim, 0, s0, s0 FROM s0 CROSS JOIN range(%d) t(sim))" % N)


def scenario(method: str, portfolio: bool = False) -> simulate.Scenario:
    return simulate.Scenario(f"{method}_q", method, DAYS, N, BLOCK, portfolio=portfolio)


SEEDS = {m: scenario_seed(42, f"{m}_q") for m in simulate.METHODS}


def paths(s: SparkSession, d: str, method: str, portfolio: bool = False) -> DataFrame:
    return simulate.run_scenario(scenario(method, portfolio), *calm(s, d))


@query("gbm_params", S.build(*PANEL, select="SELECT ticker, round(mu, 6) AS mu_daily, round(sigma, 6) AS sigma_daily, round(mu * 252, 6) AS mu_annual, round(sigma * sqrt(252), 6) AS sigma_annual, n AS n_observations FROM par"))
def _(s, d):
    return simulate.gbm_params(calm(s, d)[1])


for _m in simulate.METHODS:

    @query(f"simulate_{_m}", S.build(*paths_sql(_m, SEEDS[_m]), select=f"SELECT '{_m}_q' AS scenario_name, ticker, sim AS simulation_id, day::BIGINT AS day_offset, round(v, 0) AS value FROM paths"), 0)
    def _(s, d, m=_m):
        return simulate.full_paths(paths(s, d, m))


_PORT = "port AS (SELECT sim, day, sum(v / s0) / (SELECT count(*) FROM s0) AS v FROM paths GROUP BY 1, 2)"


@query("simulate_portfolio", S.build(*paths_sql("bootstrap", SEEDS["bootstrap"]), _PORT, select="SELECT sim AS simulation_id, day::BIGINT AS day_offset, round(v, 6) AS value FROM port"))
def _(s, d):
    return simulate.full_paths(paths(s, d, "bootstrap", True).where(F.col("ticker") == simulate.PORTFOLIO)).select("simulation_id", "day_offset", "value")


@query("simulate_portfolio_correlated")
def _(s, d):
    return simulate.full_paths(paths(s, d, "gbm", True))


_G = paths_sql("gbm", SEEDS["gbm"])
_TERM = "term AS (SELECT ticker, s0, v AS t, v / s0 - 1 AS r FROM paths WHERE day = %d)" % DAYS
_TAG = "'gbm_q' AS scenario_name, ticker, 'gbm' AS method"
_PCT = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)


@query("path_percentiles", S.build(*_G, select=" UNION ALL ".join(f"SELECT {_TAG}, day::BIGINT AS day_offset, {p!r}::DOUBLE AS percentile, round(quantile_cont(v, {p / 100!r}), 2) AS value FROM paths GROUP BY ticker, day" for p in _PCT)), 2)
def _(s, d):
    return simulate.path_percentiles(paths(s, d, "gbm")).drop("date")


@query("path_percentile_dates", S.build(CALM, "x AS (SELECT max(date) AS d FROM bars)", "days AS (SELECT t::DATE AS date, row_number() OVER (ORDER BY t) - 1 AS day_offset FROM (SELECT unnest(generate_series(d, d + INTERVAL 60 DAY, INTERVAL 1 DAY)) AS t FROM x) WHERE isodow(t) < 6)", select=f"SELECT day_offset, date FROM days WHERE day_offset <= {DAYS}"))
def _(s, d):
    p = calm(s, d)[0]
    last = p.agg(F.max("date")).first()[0]
    return simulate.path_percentiles(paths(s, d, "gbm"), last).select("day_offset", "date").distinct()


@query("terminal_distribution", S.build(*_G, _TERM, "k AS (SELECT ticker, skewness(t) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS sk FROM term GROUP BY ticker)", select=f"SELECT {_TAG}, round(s0, 4) AS s0, round(avg(t), 4) AS terminal_mean, round(stddev_samp(t), 4) AS terminal_std, round(any_value(sk), 4) AS terminal_skew, round(kurtosis_pop(t), 4) AS terminal_kurtosis, " + ", ".join(f'round(quantile_cont(t, {p / 100!r}), 4) AS "terminal_p{p:g}", round(quantile_cont(r, {p / 100!r}), 4) AS "return_p{p:g}"' for p in _PCT) + " FROM term JOIN k USING (ticker) GROUP BY ticker, s0"), 4)
def _(s, d):
    return simulate.terminal_distribution(paths(s, d, "gbm"))


_VAR = "q AS (SELECT ticker, quantile_cont(r, 1 - 0.95::DOUBLE) AS q95, quantile_cont(r, 1 - 0.99::DOUBLE) AS q99 FROM term GROUP BY ticker), vc AS (SELECT ticker, -any_value(q95) AS var_95, -any_value(q99) AS var_99, -avg(r) FILTER (r <= q95) AS cvar_95 FROM term JOIN q USING (ticker) GROUP BY ticker)"


@query("simulated_var_cvar", S.build(*_G, _TERM, _VAR, select=f"SELECT {_TAG}, metric_name, round(value, 6) AS value FROM (UNPIVOT vc ON var_95, var_99, cvar_95 INTO NAME metric_name VALUE value)"))
def _(s, d):
    return simulate.simulated_var_cvar(paths(s, d, "gbm"))


_LOSS = ", ".join(f"avg((r < {t!r})::INT) AS {simulate.threshold_name(t)}" for t in (-0.2, -0.1, 0.0, 0.1, 0.2))


@query("loss_probabilities", S.build(*_G, _TERM, f"lp AS (SELECT ticker, {_LOSS} FROM term GROUP BY ticker)", select=f"SELECT {_TAG}, metric_name, round(value, 6) AS value FROM (UNPIVOT lp ON COLUMNS(* EXCLUDE (ticker)) INTO NAME metric_name VALUE value)"))
def _(s, d):
    return simulate.loss_probabilities(paths(s, d, "gbm"))


_DD = "dd AS (SELECT ticker, sim, min(x) AS d FROM (SELECT ticker, sim, v / max(v) OVER (PARTITION BY ticker, sim ORDER BY day) - 1 AS x FROM paths) GROUP BY 1, 2)"


@query("path_drawdowns", S.build(*_G, _DD, select=f"SELECT {_TAG}, round(avg(d), 6) AS mean_max_drawdown, round(quantile_cont(d, 0.5), 6) AS median_max_drawdown, round(quantile_cont(d, 0.05), 6) AS p5_max_drawdown, round(quantile_cont(d, 0.01), 6) AS p1_max_drawdown, round(avg((d < -0.2)::INT), 6) AS prob_drawdown_exceeds_20pct FROM dd GROUP BY ticker"))
def _(s, d):
    return simulate.path_drawdowns(paths(s, d, "gbm"))


_PTERM = "term AS (SELECT 'PORTFOLIO' AS ticker, v - 1 AS r FROM port WHERE day = %d)" % DAYS


def _port_vc(s: SparkSession, d: str) -> DataFrame:
    out = None
    for m in ("bootstrap", "block_bootstrap"):
        part = simulate.simulated_var_cvar(paths(s, d, m, True))
        out = part if out is None else out.unionByName(part)
    return out


@query("method_comparison", " UNION ALL ".join("SELECT * FROM (" + S.build(*paths_sql(m, SEEDS[m]), _PORT, _PTERM, _VAR, select=f"SELECT '{m}_q' AS scenario_name, round(var_95, 6) AS var_95, round(cvar_95, 6) AS cvar_95 FROM vc") + ")" for m in ("bootstrap", "block_bootstrap")))
def _(s, d):
    return simulate.method_comparison(_port_vc(s, d))


# planted faults, as sound metrics break no rule
_FAULTS = "planted AS (SELECT ticker, var_95, CASE WHEN ticker = '1-URGENT' THEN var_99 - 1 ELSE var_99 END AS var_99, CASE WHEN ticker IN ('1-URGENT', '5-LOW') THEN cvar_95 - 1 ELSE cvar_95 END AS cvar_95 FROM vc)"


@query("var_cvar_invariants", S.build(*_G, _TERM, _VAR, _FAULTS, select="SELECT 'gbm_q' AS scenario_name, ticker, 'var_99<var_95' AS broken FROM planted WHERE var_99 < var_95 UNION ALL SELECT 'gbm_q', ticker, 'cvar_95<var_95' FROM planted WHERE cvar_95 < var_95"))
def _(s, d):
    t, m = F.col("ticker"), F.col("metric_name")
    fault = ((t == "1-URGENT") & m.isin("var_99", "cvar_95")) | ((t == "5-LOW") & (m == "cvar_95"))
    return simulate.broken_invariants(simulate.simulated_var_cvar(paths(s, d, "gbm")).withColumn("value", F.when(fault, F.col("value") - 1).otherwise(F.col("value"))))
