"""Files: typed scans of raw CSV, JSON and scenarios, Parquet with contracts, sorted sinks, JSON reports."""

from __future__ import annotations

import datetime as dt
import json
import logging
import math
import re
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import no_nan
from ..operators import contracts, forecast, simulate

log = logging.getLogger(__name__)

PRICE_COLUMNS = ("date", "ticker", "open", "high", "low", "close", "volume")
METADATA_KEYS = {"shortName": "string", "sector": "string", "industry": "string", "marketCap": "bigint", "currency": "string", "beta": "double", "trailingPE": "double", "fiftyTwoWeekHigh": "double", "fiftyTwoWeekLow": "double"}
_NAME = re.compile(r"^[A-Za-z0-9_\-]{1,64}$")
#: Order of rows in files, so that a second run writes the same.
SORTED_BY = {
    "prices_clean": ("ticker", "date"), "returns_daily": ("ticker", "date"), "flagged_observations": ("ticker", "date"), "metrics_per_ticker": ("ticker", "category", "metric_name"), "rolling_metrics": ("ticker", "date", "metric_name"),
    "drawdown_series": ("ticker", "date"), "forecasts": ("scenario_name", "ticker", "forecast_date"), "forecast_metrics": ("scenario_name", "ticker", "metric_name"), "stationarity_tests": ("ticker", "series_type"), "mc_paths_summary": ("scenario_name", "ticker", "day_offset", "percentile"),
    "mc_terminal_distribution": ("scenario_name", "ticker"), "mc_metrics": ("scenario_name", "ticker", "metric_name"), "mc_drawdown_distribution": ("scenario_name", "ticker"), "mc_paths_full": ("scenario_name", "ticker", "simulation_id", "day_offset"),
}


# ── scans ────────────────────────────────────────────────────────────────────
def read_raw_prices(spark: SparkSession, path: str) -> DataFrame:
    """Raw bars from CSV with a header; tickers in upper case, NaN as null.  A missing file raises FileNotFoundError."""
    schema = "date string, ticker string, open double, high double, low double, close double, volume double"
    try:
        raw = spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path}: run the ingestion first") from e
    prices = [no_nan(F.col(c)).alias(c) for c in PRICE_COLUMNS[2:6]]
    return raw.select(F.to_date("date").alias("date"), F.upper("ticker").alias("ticker"), *prices, no_nan(F.col("volume")).cast("bigint").alias("volume"))


def metadata_table(spark: SparkSession, metadata: dict[str, dict]) -> DataFrame:
    """(ticker, the nine keys) from {ticker: {key: value}}; what is missing is null."""
    cast = {"string": str, "bigint": int, "double": float}
    rows = [(t, *(None if v.get(k) is None else cast[kind](v[k]) for k, kind in METADATA_KEYS.items())) for t, v in metadata.items()]
    return spark.createDataFrame(rows, "ticker string, " + ", ".join(f"{k} {kind}" for k, kind in METADATA_KEYS.items()))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The same from a JSON file; a missing one gives no rows."""
    try:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    except AnalysisException:
        log.warning("no metadata at %s", path)
        text = "{}"
    return metadata_table(spark, json.loads(text))


def wide_to_long(wide: DataFrame, tickers: list[str], separator: str = "_") -> DataFrame:
    """Columns date and {ticker}{separator}{Field} in either order, to bars; tickers without a single close go."""
    names = set(wide.columns)
    parts = []
    for t in tickers:
        found = {}
        for f in PRICE_COLUMNS[2:]:
            for n in (f"{t}{separator}{f}", f"{t}{separator}{f.title()}", f"{f}{separator}{t}", f"{f.title()}{separator}{t}"):
                if n in names:
                    found[f] = n
        if "close" in found:
            value = lambda f, kind: (F.col(f"`{found[f]}`") if f in found else F.lit(None)).cast(kind).alias(f)  # noqa: B023, E731
            parts.append(F.struct(F.lit(t).alias("ticker"), *[value(f, "double") for f in PRICE_COLUMNS[2:6]], value("volume", "bigint")))
    schema = "date date, ticker string, open double, high double, low double, close double, volume bigint"
    if not parts:
        return wide.sparkSession.createDataFrame([], schema)
    long = wide.select(F.to_date("date").alias("date"), F.explode(F.array(*parts)).alias("b")).select("date", "b.*")
    known = long.groupBy("ticker").agg(F.count(no_nan(F.col("close"))).alias("n")).where("n > 0").select("ticker")
    return long.join(known, "ticker", "left_semi").select(*PRICE_COLUMNS)


def read_table(spark: SparkSession, folder: str, name: str, hint: str = "run the step before it") -> DataFrame:
    """A persisted table that keeps its contract."""
    path = f"{folder}/{name}.parquet"
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is missing: {hint}") from e
    return contracts.enforce(df, name) if name in contracts.CONTRACTS else df


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        log.warning("%s is missing", path)
        return None


def read_json(path: str | Path) -> dict | None:
    """A report, or None if there is none."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        log.warning("%s is missing", path)
        return None


def _scenario_rows(spark: SparkSession, path: str, required: tuple[str, ...]) -> list[dict]:
    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"scenarios lack {', '.join(missing)}")
    rows = [r.asDict() for r in df.collect()]
    if not rows:
        raise ValueError("no scenarios")
    bad = [r["scenario_name"] for r in rows if not r["scenario_name"] or not _NAME.match(r["scenario_name"])]
    if bad:
        raise ValueError(f"not a scenario name: {bad[0]}")
    return rows


def read_forecast_scenarios(spark: SparkSession, path: str) -> list[forecast.Scenario]:
    rows = _scenario_rows(spark, path, ("scenario_name", "model", "target", "horizon_days", "confidence_level"))
    known = {*forecast.NAIVE, *forecast.FITTED, *forecast.CUSTOM}
    wrong = sorted({r["model"] for r in rows} - known)
    if wrong:
        raise ValueError(f"unknown models: {', '.join(wrong)}")
    return [forecast.Scenario(r["scenario_name"], r["model"], r["target"], int(r["horizon_days"]), float(r["confidence_level"]), r.get("tickers")) for r in rows]


def read_simulation_scenarios(spark: SparkSession, path: str) -> list[simulate.Scenario]:
    rows = _scenario_rows(spark, path, ("scenario_name", "method", "horizon_days", "n_simulations"))
    for r in rows:
        if r["method"] not in simulate.METHODS:
            raise ValueError(f"unknown method: {r['method']}")
        if r.get("drift_method") not in (None, "historical", "zero"):
            raise ValueError(f"unknown drift: {r['drift_method']}")
    return [simulate.Scenario(r["scenario_name"], r["method"], int(r["horizon_days"]), int(r["n_simulations"]), int(float(r["block_size"])) if r.get("block_size") else None, r.get("drift_method"), r.get("tickers"), simulate.parse_bool(r.get("simulate_portfolio"), True)) for r in rows]


def with_retry(call: Callable, attempts: int = 3, first: float = 1.0, most: float = 8.0, errors: tuple = (ConnectionError, TimeoutError, OSError), sleep: Callable = time.sleep):
    """call(), again after 1, 2, 4, 8 seconds while it fails with one of `errors`."""
    for k in range(attempts):
        try:
            return call()
        except errors:
            if k == attempts - 1:
                raise
            sleep(min(most, first * 2**k))
    raise ValueError("attempts must be 1 or more")


# ── sinks ────────────────────────────────────────────────────────────────────
def write_table(df: DataFrame, folder: str, name: str, files: int | None = 1) -> str:
    """Parquet with snappy, sorted for equal reruns; files: how many, None for as many as Spark makes (large tables)."""
    path = f"{folder}/{name}.parquet"
    keys = [c for c in SORTED_BY.get(name, ()) if c in df.columns]
    out = df.orderBy(*keys) if keys else df
    (out.coalesce(files) if files else out).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def sanitise(x):
    """JSON values: numbers that aren't finite become null, numpy's and dates become plain; others raise TypeError."""
    if isinstance(x, dict):
        return {str(k): sanitise(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [sanitise(v) for v in x]
    if isinstance(x, np.ndarray):
        return sanitise(x.tolist())
    if isinstance(x, np.generic):
        return sanitise(x.item())
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if x is None or isinstance(x, (str, int, bool)):
        return x
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    raise TypeError(f"{type(x).__name__} can't be written as JSON")


def write_json(data: dict, path: str | Path) -> str:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(sanitise(data), indent=2, ensure_ascii=False), encoding="utf-8")
    return str(path)
