"""Forecasts, their walk-forward tests and their metrics.

A series table has (ticker, date, y).  Naive models are plain aggregates; the others fit in grouped Pandas
functions, one group for each ticker and fold, so that all folds fit side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.calendar import business_day
from ..functions.stats import by_date
from . import models

NAIVE = {"naive_random_walk": "random_walk", "naive_drift": "drift", "naive_mean": "mean"}
FITTED = ("arima_returns", "arima_log_prices", "prophet")
#: Further models: name to fit(values, days, future days, level) -> dict as those in models.py give.
CUSTOM: dict[str, Callable] = {}
METRICS = ["rmse", "mae", "mape", "directional_accuracy", "coverage_rate", "mean_interval_width", "n_folds", "n_predictions"]


@dataclass(frozen=True)
class Scenario:
    name: str
    model: str
    target: str
    horizon: int
    level: float
    tickers: str | None = None


def series(prices: DataFrame, returns: DataFrame, target: str) -> DataFrame:
    """(ticker, date, y): simple returns, or logarithms of closes, which forecasts then stay in; nulls go."""
    if target == "returns":
        out = returns.select("ticker", "date", F.col("simple_return").alias("y"))
    elif target == "prices":
        out = prices.select("ticker", "date", F.ln("close").alias("y"))
    else:
        raise ValueError(f"unknown target: {target}")
    return out.where("y IS NOT NULL AND NOT isnan(y)")


def parse_tickers(text: str | None, known: list[str]) -> tuple[list[str], list[str]]:
    """The tickers a scenario names that are known, and those that aren't; nothing or 'all' in any case: every one."""
    if text is None or not text.strip() or text.strip().lower() == "all":
        return known, []
    asked = [t.strip().upper() for t in text.split(",") if t.strip()]
    return [t for t in asked if t in known], [t for t in asked if t not in known]


def naive(train: DataFrame, method: str, horizon: int, level: float, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, step, forecast, lower_ci, upper_ci); groups of fewer than two values have no rows."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    w = Window.partitionBy(*keys).orderBy("date")
    own = train.select(*keys, "date", "y", (F.col("y") - F.lag("y").over(w)).alias("step_y"))
    s = own.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("y", "date").alias("last"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.avg("step_y").alias("drift"), F.stddev_samp("step_y").alias("sd_step")).where("n >= 2")
    s = s.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    # the deviation of steps doesn't change when their mean is taken away
    if method == "random_walk":
        point, half = F.col("last"), z * F.col("sd_step") * F.sqrt("step")
    elif method == "drift":
        point, half = F.col("last") + F.col("drift") * F.col("step"), z * F.col("sd_step") * F.sqrt("step")
    elif method == "mean":
        point, half = F.col("mean"), z * F.col("sd")
    else:
        raise ValueError(f"unknown naive method: {method}")
    return s.select(*keys, "step", point.alias("forecast"), (point - half).alias("lower_ci"), (point + half).alias("upper_ci"))


def numbered(data: DataFrame) -> DataFrame:
    """The series with its place i from 0 and its length n."""
    return data.withColumn("i", F.row_number().over(by_date()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("ticker")))


def folds(data: DataFrame, initial: int, step: int, horizon: int, expanding: bool = True) -> DataFrame:
    """(ticker, fold, train_start, train_end): places of the training rows, the end excluded; too short series have none."""
    n = numbered(data).select("ticker", "n").distinct()
    count = F.floor((F.col("n") - initial - horizon) / step)
    own = n.where(F.col("n") >= initial + horizon).select("ticker", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("fold"))
    return own.select("ticker", "fold", (F.lit(0) if expanding else F.col("fold") * step).cast("long").alias("train_start"), (F.lit(initial) + F.col("fold") * step).cast("long").alias("train_end"))


def _fold_rows(data: DataFrame, plan: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and rows to test on, by ticker and fold; a ticker has few folds, so the plan is the small side."""
    both = numbered(data).join(plan, "ticker")
    train = both.where((F.col("i") >= F.col("train_start")) & (F.col("i") < F.col("train_end"))).select("ticker", "fold", "date", "y")
    test = both.where((F.col("i") >= F.col("train_end")) & (F.col("i") < F.col("train_end") + horizon)).select("ticker", "fold", "date", "y", (F.col("i") - F.col("train_end") + 1).cast("int").alias("step"))
    return train, test


def _days(dates: pd.Series) -> np.ndarray:
    return (pd.to_datetime(dates) - pd.Timestamp("1970-01-01")).dt.days.to_numpy()


def next_business_days(last: pd.Timestamp, n: int) -> pd.DatetimeIndex:
    """n business days after the first one on or after `last`."""
    return pd.bdate_range(last, periods=n + 1)[1:]


def fit(model: str, values: np.ndarray, days: np.ndarray, future: np.ndarray, level: float, settings: Settings = DEFAULTS, custom: dict[str, Callable] | None = None) -> dict:
    custom = CUSTOM if custom is None else custom
    if model in custom:
        return custom[model](values, days, future, level)
    if model.startswith("arima"):
        return models.arima(values, len(future), level, settings.arima_max_p, settings.arima_max_q, settings.arima_max_d)
    if model == "prophet":
        return models.trend_seasonal(values, days, future, level, seed=settings.seed)
    raise ValueError(f"unknown model: {model}")


def fitted(train: DataFrame, model: str, horizon: int, level: float, keys: tuple[str, ...] = ("ticker",), settings: Settings = DEFAULTS) -> DataFrame:
    """(keys, step, forecast, lower_ci, upper_ci, converged): a fit for each group; one that fails, for whatever reason, is a random walk."""
    custom = dict(CUSTOM)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["y"].to_numpy()
        future = _days(pd.Series(next_business_days(pd.Timestamp(pdf["date"].iloc[-1]), horizon)))
        try:
            r = fit(model, y, _days(pdf["date"]), future, level, settings, custom)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            r = {"converged": False}
        ok = bool(r.get("converged"))
        if not ok:
            if len(y) < 2:
                return pd.DataFrame({**{k: [] for k in keys}, "step": [], "forecast": [], "lower_ci": [], "upper_ci": [], "converged": []})
            half = NormalDist().inv_cdf(0.5 + level / 2) * (np.std(np.diff(y), ddof=1) if len(y) > 2 else np.nan) * np.sqrt(np.arange(1, horizon + 1))
            r = {"forecast": np.full(horizon, y[-1]), "lower": y[-1] - half, "upper": y[-1] + half}
        n = len(r["forecast"])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * n for k in keys}, "step": np.arange(1, n + 1), "forecast": r["forecast"], "lower_ci": r["lower"], "upper_ci": r["upper"], "converged": ok})

    types = dict(train.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", step int, forecast double, lower_ci double, upper_ci double, converged boolean"
    return train.groupBy(*keys).applyInPandas(run, schema)


def predict(train: DataFrame, model: str, horizon: int, level: float, keys: tuple[str, ...] = ("ticker",), settings: Settings = DEFAULTS) -> DataFrame:
    if model in NAIVE:
        return naive(train, NAIVE[model], horizon, level, keys)
    if model not in FITTED and model not in CUSTOM:
        raise ValueError(f"unknown model: {model}")
    return fitted(train, model, horizon, level, keys, settings).drop("converged")


def walk_forward(data: DataFrame, model: str, horizon: int, level: float, settings: Settings = DEFAULTS) -> DataFrame:
    """(ticker, fold, fold_start_date, fold_end_date, forecast_date, actual, predicted, lower_ci, upper_ci)."""
    train, test = _fold_rows(data, folds(data, settings.train_initial, settings.step, horizon, settings.expanding), horizon)
    ends = train.groupBy("ticker", "fold").agg(F.min("date").alias("fold_start_date"), F.max("date").alias("fold_end_date"))
    made = predict(train, model, horizon, level, ("ticker", "fold"), settings)
    out = test.join(made, ["ticker", "fold", "step"]).join(ends, ["ticker", "fold"])
    return out.select("ticker", "fold", "fold_start_date", "fold_end_date", F.col("date").alias("forecast_date"), F.col("y").alias("actual"), F.col("forecast").alias("predicted"), "lower_ci", "upper_ci")


def _metric_columns() -> list[Column]:
    e, a = F.col("actual") - F.col("predicted"), F.col("actual")
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.avg(F.when(F.abs(a) > 1e-8, F.abs(F.try_divide(e, a)))) * 100).alias("mape"),
        F.avg((F.signum("predicted") == F.signum(a)).cast("double")).alias("directional_accuracy"), F.avg(((F.col("lower_ci") <= a) & (a <= F.col("upper_ci"))).cast("double")).alias("coverage_rate"),
        F.avg(F.col("upper_ci") - F.col("lower_ci")).alias("mean_interval_width"), F.count_distinct("fold").cast("double").alias("n_folds"), F.count("*").cast("double").alias("n_predictions"),
    ]


def forecast_metrics(backtest: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """(ticker, metric_name, value); tickers without a fold have nulls and counts of 0 if they are named."""
    wide = backtest.groupBy("ticker").agg(*_metric_columns())
    if tickers is not None:
        wide = tickers.select("ticker").distinct().join(wide, "ticker", "left").fillna(0.0, ["n_folds", "n_predictions"])
    return wide.unpivot("ticker", METRICS, "metric_name", "value")


def run_scenario(scenario: Scenario, prices: DataFrame, returns: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(forecasts, metrics) of a scenario; series that are too short are left out."""
    data = series(prices, returns, scenario.target)
    if scenario.tickers is not None:
        known = sorted(r.ticker for r in data.select("ticker").distinct().collect())
        data = data.where(F.col("ticker").isin(parse_tickers(scenario.tickers, known)[0]))
    long = data.groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("last_date")).where((F.col("n") >= settings.min_observations) & (F.col("n") >= scenario.horizon))
    data = data.join(long.select("ticker"), "ticker", "left_semi")
    name, model = F.lit(scenario.name).alias("scenario_name"), F.lit(scenario.model).alias("model_type")
    measured = forecast_metrics(walk_forward(data, scenario.model, scenario.horizon, scenario.level, settings), long)
    made = predict(data, scenario.model, scenario.horizon, scenario.level, settings=settings).join(long, "ticker")
    forecasts = made.select(name, "ticker", model, F.lit(scenario.target).alias("target"), business_day(F.col("last_date"), F.col("step")).alias("forecast_date"), "forecast", "lower_ci", "upper_ci", F.lit(scenario.level).alias("confidence_level"))
    return forecasts, measured.select(name, "ticker", model, "metric_name", "value")


def best_models(metrics: DataFrame) -> DataFrame:
    """(ticker, model, rmse, beats_random_walk): the least RMSE, the first scenario by name on ties; null where all RMSEs are."""
    r = metrics.where("metric_name = 'rmse'")
    best = r.groupBy("ticker").agg(F.min(F.when(F.col("value").isNotNull(), F.struct("value", "scenario_name", "model_type"))).alias("b"), F.min(F.when(F.col("model_type") == "naive_random_walk", F.col("value"))).alias("rw"))
    beats = F.when((F.col("b.model_type") != "naive_random_walk") & F.col("rw").isNotNull(), F.col("b.value") < F.col("rw"))
    return best.select("ticker", F.col("b.model_type").alias("model"), F.col("b.value").alias("rmse"), beats.alias("beats_random_walk"))


def scenario_averages(metrics: DataFrame) -> DataFrame:
    """(scenario_name, mean_rmse, mean_coverage, n_tickers)."""
    pick = lambda m: F.avg(F.when(F.col("metric_name") == m, F.col("value")))
    return metrics.groupBy("scenario_name").agg(pick("rmse").alias("mean_rmse"), pick("coverage_rate").alias("mean_coverage"), F.count_distinct("ticker").alias("n_tickers"))


def stationarity(returns: DataFrame) -> DataFrame:
    """The ADF test of each ticker's returns and cumulative log returns; a test that can't be done is null and not stationary."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rows = []
        for kind, x in (("returns", pdf["simple_return"].dropna()), ("log_prices", pdf["log_return"].dropna().cumsum())):
            r = models.adf(x.to_numpy())
            rows.append((pdf["ticker"].iloc[0], kind, *((r["statistic"], r["p_value"], r["p_value"] < 0.05, r["critical"]["1%"], r["critical"]["5%"]) if r else (None, None, False, None, None))))
        return pd.DataFrame(rows, columns=["ticker", "series_type", "adf_statistic", "p_value", "is_stationary", "critical_1pct", "critical_5pct"])

    return returns.select("ticker", "date", "simple_return", "log_return").groupBy("ticker").applyInPandas(run, "ticker string, series_type string, adf_statistic double, p_value double, is_stationary boolean, critical_1pct double, critical_5pct double")


def empty_forecasts(spark) -> DataFrame:
    return spark.createDataFrame([], "scenario_name string, ticker string, model_type string, target string, forecast_date date, forecast double, lower_ci double, upper_ci double, confidence_level double")


def empty_metrics(spark) -> DataFrame:
    return spark.createDataFrame([], "scenario_name string, ticker string, model_type string, metric_name string, value double")
