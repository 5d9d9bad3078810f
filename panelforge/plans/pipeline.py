"""The seven steps from raw bars to exports.  Tables are handed over as Parquet, reports as JSON on the driver."""

from __future__ import annotations

import datetime as dt
import json
import logging
import time
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators import cleaning, contracts, eda, forecast, metrics, simulate
from ..sources import files

log = logging.getLogger(__name__)
CSV_TABLES = ("prices_clean", "returns_daily", "metrics_per_ticker", "portfolio_metrics", "forecasts", "mc_metrics")
SHEETS = ("Portfolio Metrics", "Per-Ticker Metrics", "Drawdown Summary", "Forecasts", "MC Risk", "Config")
#: Simulations below which results are noisy, above which they are slow, and bytes of full paths that are worth a warning.
FEW_RUNS, MANY_RUNS, LARGE_PATHS = 100, 1_000_000, 1_000_000_000


@dataclass
class Folders:
    root: str
    raw: str = field(init=False)
    tables: str = field(init=False)
    reports: str = field(init=False)
    exports: str = field(init=False)

    def __post_init__(self):
        self.raw, self.tables, self.reports, self.exports = (f"{self.root}/{x}" for x in ("raw", "processed", "reports", "exports"))


class Clock:
    def __init__(self):
        self.began, self.stamp = time.time(), dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    @property
    def seconds(self) -> float:
        return round(time.time() - self.began, 2)


def _extent(df: DataFrame) -> dict:
    r = eda.counts_and_ranges(df).first()
    return {"rows": r.n_rows, "tickers": r.n_tickers, "date_range": [str(r.first_date), str(r.last_date)]}


def _nested(rows, *keys: str, value: str = "value") -> dict:
    out: dict = {}
    for r in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault(r[k], {})
        at[r[keys[-1]]] = r[value]
    return out


def run_ingestion(spark: SparkSession, prices: DataFrame, requested: list[str], start: dt.date, end: dt.date, folders: Folders, metadata: dict | None = None) -> dict:
    """Raw bars of the requested tickers and dates to CSV; nothing is written if there are none."""
    clock = Clock()
    if not requested:
        raise ValueError("no tickers")
    if start > end:
        raise ValueError(f"{start} is after {end}")
    own = prices.where(F.col("ticker").isin(requested) & F.col("date").between(F.lit(start), F.lit(end))).select(*files.PRICE_COLUMNS)
    found = {r.ticker: r.n for r in own.groupBy("ticker").agg(F.count("close").alias("n")).where("n > 0").collect()}
    rows = own.where(F.col("ticker").isin(list(found))).count() if found else 0
    if rows:
        files.write_csv(own.where(F.col("ticker").isin(list(found))).orderBy("ticker", "date"), f"{folders.raw}/prices.csv")
        files.write_json({t: {k: (metadata or {}).get(t, {}).get(k) for k in files.METADATA_KEYS} for t in sorted(found)}, f"{folders.raw}/metadata.json")
    else:
        log.critical("no ticker has data; nothing is written")
    return {"tickers_requested": len(requested), "tickers_succeeded": len(found), "tickers_failed": [t for t in requested if t not in found], "rows_fetched": rows, "duration_sec": clock.seconds}


def run_cleaning(spark: SparkSession, folders: Folders, settings: Settings = DEFAULTS) -> dict:
    clock = Clock()
    raw = files.read_raw_prices(spark, f"{folders.raw}/prices.csv")
    meta = files.read_metadata(spark, f"{folders.raw}/metadata.json")
    before = _extent(raw)
    cleaning.validate_raw_schema(raw)
    # the order of rows in one file is the only order that raw bars have
    first = cleaning.dedup_keep_first(raw.withColumn("_o", F.monotonically_increasing_id()), "_o").drop("_o").persist()
    grid = cleaning.calendar_reindex(first, settings.calendar).persist()
    fills = {r.ticker: r.fills for r in cleaning.fill_counts(grid, settings.max_fills).where("fills > 0").collect()}
    whole = cleaning.fill_and_drop(grid, settings.max_fills).persist()
    good = cleaning.drop_invalid_prices(whole).persist()
    n_first, n_grid, n_whole, n_good = first.count(), grid.count(), whole.count(), good.count()
    if not n_good:
        raise RuntimeError("no rows are left after cleaning")
    shares = {r.ticker: r.coverage for r in cleaning.coverage(good, settings.calendar).collect()}
    clean = cleaning.drop_tiny(cleaning.enforce_coverage(good, settings.min_coverage, settings.calendar)).persist()
    if clean.isEmpty():
        raise RuntimeError("no ticker passes the coverage check")
    mix = cleaning.currency_mix(meta, clean).first()
    contracts.enforce(clean, "prices_clean", RuntimeError)
    returns = cleaning.compute_returns(clean).persist()
    flagged = cleaning.flag_outliers(returns, settings.outlier_threshold)
    report = {
        "run_timestamp": clock.stamp, "input": before, "output": _extent(clean),
        "actions": {
            "duplicates_removed": before["rows"] - n_first, "invalid_price_rows_dropped": n_whole - n_good, "missing_filled": fills, "rows_dropped_after_fill_limit": n_grid - n_whole,
            "tickers_dropped_low_coverage": sorted(t for t, c in shares.items() if c < settings.min_coverage), "outliers_flagged": {r.ticker: r.n_flagged for r in cleaning.outlier_counts(returns, settings.outlier_threshold).collect()},
        },
        "coverage_pct": {t: round(c, 4) for t, c in sorted(shares.items())}, "currency_warning": f"several currencies: {mix.currencies}" if mix.n_currencies > 1 else None,
    }
    for name, df in (("prices_clean", clean), ("returns_daily", returns), ("flagged_observations", flagged)):
        files.write_table(df, folders.tables, name)
    for df in (first, grid, whole, good, clean, returns):
        df.unpersist()
    report["duration_sec"] = clock.seconds
    files.write_json(report, f"{folders.tables}/cleaning_report.json")
    return report


def _panel(spark: SparkSession, folders: Folders) -> tuple[DataFrame, DataFrame]:
    return files.read_table(spark, folders.tables, "prices_clean", "run the cleaning first"), files.read_table(spark, folders.tables, "returns_daily", "run the cleaning first")


def run_eda(spark: SparkSession, folders: Folders, settings: Settings = DEFAULTS, sectors: DataFrame | None = None) -> dict:
    """The summary, and the data behind each chart as a table."""
    clock = Clock()
    prices, returns = _panel(spark, folders)
    charts = {
        "01_price_trends": {"moving_averages": eda.moving_averages(prices, settings.moving_windows), "volumes": eda.volume_trend(prices)},
        "02_return_distributions": {"histograms": eda.histogram(returns), "densities": eda.density(returns), "quantiles": eda.qq(returns, settings.min_qq_rows), "boxes": eda.box(returns)},
        "03_volatility": {"rolling": eda.rolling_volatility(returns, settings.volatility_window, settings.days_per_year), "monthly": eda.monthly_volatility(returns, settings.volatility_window, settings.days_per_year)},
        "04_correlations": {"matrix": eda.correlation_matrix(returns), "scatter": eda.scatter(returns, settings.top_correlations)} | ({"sectors": eda.sector_corr_matrix(returns, sectors)} if sectors is not None else {}),
        "05_outliers": {"top_moves": eda.top_moves(returns, settings.top_moves)},
    }
    for block, tables in charts.items():
        for name, df in tables.items():
            files.write_table(df, f"{folders.reports}/charts/{block}", name)
    stats = {r.ticker: {k: None if r[k] is None else round(r[k], 6) for k in ("mean", "std", "skew", "kurtosis", "min", "max")} | {"jarque_bera_pvalue": None if r.jarque_bera_p is None else round(r.jarque_bera_p, 6)} | ({"flat_lined": True} if r.flat_lined else {}) for r in eda.distribution_stats(returns).orderBy("ticker").collect()}
    correlations = {"matrix": _nested(eda.correlation_matrix(returns).select("ticker_a", "ticker_b", F.round("corr", 6).alias("value")).orderBy("ticker_a", "ticker_b").collect(), "ticker_a", "ticker_b"), "top_pairs": [{"ticker_a": r.a, "ticker_b": r.b, "correlation": round(r["corr"], 6)} for r in eda.top_correlated_pairs(returns, settings.top_correlations).collect()]}
    if sectors is not None:
        correlations["sector_avg_correlation"] = {r.sector: r.avg_corr for r in eda.sector_avg_corr(returns, sectors).collect()}
    flat = eda.flat_runs(prices).groupBy("ticker").agg(F.max("run_length").alias("longest")).where("longest > 1")
    summary = {
        "run_timestamp": clock.stamp, "input": _extent(prices), "distribution_stats": stats,
        "monthly_volatility": _nested(eda.monthly_volatility(returns, settings.volatility_window, settings.days_per_year).select("month", "ticker", F.round("volatility", 4).alias("value")).orderBy("month", "ticker").collect(), "month", "ticker"),
        "correlations": correlations, "outliers": {r.ticker: {"eda_count": r.eda_count, "cleaning_count": r.cleaning_count, "overlap": r.overlap} for r in eda.outlier_match(returns, cleaning.outlier_counts(returns, settings.outlier_threshold), settings.top_moves, settings.outlier_threshold).collect()},
        "anomalies": {"zero_volume_days": cleaning.zero_volume_days(prices).count(), "flat_price_runs": {r.ticker: r.longest for r in flat.collect()}},
        "charts": {"total": sum(map(len, charts.values())), "by_block": {b: len(t) for b, t in charts.items()}}, "duration_sec": clock.seconds,
    }
    files.write_json(summary, f"{folders.reports}/eda_summary.json")
    return summary


def run_metrics(spark: SparkSession, folders: Folders, settings: Settings = DEFAULTS) -> dict:
    clock = Clock()
    prices, returns = _panel(spark, folders)
    returns = returns.persist()
    names = sorted(r.ticker for r in returns.select("ticker").distinct().collect())
    if settings.benchmark and settings.benchmark not in names:
        log.warning("the benchmark %s has no returns", settings.benchmark)
    long = metrics.metrics_per_ticker(returns, settings)
    portfolio = metrics.portfolio_metrics(returns, settings.weights, settings.benchmark, settings)
    drawdowns = metrics.drawdown_series(prices)
    rolled = metrics.rolling_metrics(returns, settings.benchmark, settings)
    for name, df in (("metrics_per_ticker", long), ("portfolio_metrics", portfolio), ("rolling_metrics", rolled), ("drawdown_series", drawdowns)):
        files.write_table(contracts.enforce(df, name) if name in contracts.CONTRACTS else df, folders.tables, name)
    per = _nested(files.read_table(spark, folders.tables, "metrics_per_ticker").collect(), "ticker", "metric_name")
    for r in metrics.drawdown_duration(returns).collect():
        per[r.ticker] |= {"max_drawdown_duration": r.max_duration, "recovered": r.recovered}
    if settings.benchmark:
        for r in metrics.beta_per_ticker(returns, settings.benchmark).collect():
            per[r.ticker]["beta_vs_benchmark"] = r.beta
    one = spark.read.parquet(f"{folders.tables}/portfolio_metrics.parquet").first().asDict()
    summary = {"run_timestamp": clock.stamp, "input": _extent(prices) | {"benchmark": settings.benchmark}, "per_ticker": per, "portfolio": one | {"weights_used": json.loads(one["weights_used"])}, "invariants_broken": {r.ticker: r.broken for r in metrics.invariants(returns, settings).collect()}, "config_used": {"risk_free_rate": settings.risk_free_rate, "benchmark_ticker": settings.benchmark, "trading_days_per_year": settings.days_per_year, "var_confidence_levels": settings.var_levels, "rolling_sharpe_window": settings.sharpe_window, "rolling_beta_window": settings.beta_window}, "duration_sec": clock.seconds}
    returns.unpersist()
    files.write_json(summary, f"{folders.reports}/metrics_summary.json")
    return summary


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def run_forecasting(spark: SparkSession, folders: Folders, scenarios: list[forecast.Scenario], settings: Settings = DEFAULTS) -> dict:
    """A scenario that fails is reported and the others run; if all fail, it raises."""
    clock = Clock()
    prices, returns = _panel(spark, folders)
    tests = forecast.stationarity(returns)
    made, measured, failed = [], [], {}
    for s in scenarios:
        try:
            a, b = forecast.run_scenario(s, prices, returns, settings)
            made.append(a)
            measured.append(b)
        except ValueError as e:
            failed[s.name] = str(e)
    if scenarios and not made:
        raise RuntimeError(f"every scenario failed: {failed}")
    forecasts, scores = _union(made), _union(measured)
    forecasts = forecast.empty_forecasts(spark) if forecasts is None else forecasts
    scores = forecast.empty_metrics(spark) if scores is None else scores
    for name, df in (("forecasts", forecasts), ("forecast_metrics", scores), ("stationarity_tests", tests)):
        files.write_table(df, folders.tables, name)
    scores, tests = (files.read_table(spark, folders.tables, n) for n in ("forecast_metrics", "stationarity_tests"))
    stationary = {r.series_type: r.n for r in tests.where("is_stationary").groupBy("series_type").agg(F.count("*").alias("n")).collect()}
    summary = {
        "run_timestamp": clock.stamp, "input": _extent(prices) | {"scenarios_loaded": len(scenarios)}, "stationarity": {f"{k}_stationary_count": stationary.get(k, 0) for k in ("returns", "log_prices")},
        "scenarios_run": {r.scenario_name: {"mean_rmse": r.mean_rmse, "mean_coverage": r.mean_coverage, "tickers": r.n_tickers} for r in forecast.scenario_averages(scores).collect()}, "scenarios_failed": failed,
        "best_model_per_ticker": {r.ticker: {"model": r.model, "rmse": r.rmse, "beats_random_walk": r.beats_random_walk} for r in forecast.best_models(scores).collect()},
        "config_used": {"train_initial_days": settings.train_initial, "walk_forward_step_days": settings.step, "expanding_window": settings.expanding, "random_seed": settings.seed}, "duration_sec": clock.seconds,
    }
    files.write_json(summary, f"{folders.reports}/forecasting_summary.json")
    return summary


def run_monte_carlo(spark: SparkSession, folders: Folders, scenarios: list[simulate.Scenario], settings: Settings = DEFAULTS) -> dict:
    clock = Clock()
    prices, returns = _panel(spark, folders)
    last = prices.agg(F.max("date")).first()[0]
    tickers = sorted(r.ticker for r in returns.select("ticker").distinct().collect())
    corr = simulate.correlation_of(returns, tickers)
    sound = not np.isnan(corr).any()
    done, failed, warnings = [], {}, []
    for s in scenarios:
        if s.n_simulations < FEW_RUNS:
            warnings.append(f"{s.name}: {s.n_simulations} simulations are few")
        if s.n_simulations > MANY_RUNS:
            warnings.append(f"{s.name}: {s.n_simulations} simulations take long")
        if s.horizon > 2 * settings.days_per_year:
            warnings.append(f"{s.name}: {s.horizon} days are more than two years")
        if settings.save_full_paths and s.n_simulations * (s.horizon + 1) * 8 * (len(tickers) + 1) > LARGE_PATHS:
            log.critical("%s: full paths take more than %d bytes", s.name, LARGE_PATHS)
        try:
            done.append((s, simulate.run_scenario(s, prices, returns, settings)))
        except ValueError as e:
            failed[s.name] = str(e)
    if scenarios and not done:
        raise RuntimeError(f"every scenario failed: {failed}")
    tables = {
        "mc_paths_summary": _union([simulate.path_percentiles(p, last, settings) for _, p in done]), "mc_terminal_distribution": _union([simulate.terminal_distribution(p, settings) for _, p in done]),
        "mc_metrics": _union([simulate.simulated_var_cvar(p, settings).unionByName(simulate.loss_probabilities(p, settings)) for _, p in done]), "mc_drawdown_distribution": _union([simulate.path_drawdowns(p) for _, p in done]),
    }
    if settings.save_full_paths:
        _union([simulate.full_paths(p) for _, p in done]).write.mode("overwrite").partitionBy("scenario_name").parquet(f"{folders.tables}/mc_paths_full.parquet")
    for name, df in tables.items():
        if df is not None:
            files.write_table(df, folders.tables, name)
    risk = files.read_table(spark, folders.tables, "mc_metrics")
    compared = simulate.method_comparison(risk).collect()
    order = {s.name: k for k, s in enumerate(scenarios)}
    said = simulate.interpretation([(r.scenario_name, r.var_95) for r in sorted(compared, key=lambda r: order[r.scenario_name])])
    summary = {
        "run_timestamp": clock.stamp, "input": _extent(prices) | {"scenarios_loaded": len(scenarios)}, "gbm_parameters": {r.ticker: {"mu_annual": r.mu_annual, "sigma_annual": r.sigma_annual, "n_observations": r.n_observations} for r in simulate.gbm_params(returns, settings, settings.drift).collect()},
        "correlation_matrix_health": {"is_positive_definite": bool(sound and simulate.is_positive_definite(corr)), "min_eigenvalue": round(float(np.linalg.eigvalsh(corr).min()), 6) if sound else None, "condition_number": round(float(np.linalg.cond(corr)), 4) if sound else None},
        "scenarios_run": {s.name: {"method": s.method, "horizon_days": s.horizon, "n_simulations": s.n_simulations} for s, _ in done}, "scenarios_failed": failed, "warnings": warnings,
        "method_comparison": {m: {r.scenario_name: r[m] for r in compared} for m in ("var_95", "cvar_95")} | ({"interpretation": said} if said else {}), "invariants_broken": [list(r) for r in simulate.broken_invariants(risk).collect()],
        "config_used": {"random_seed": settings.seed, "trading_days_per_year": settings.days_per_year, "save_full_paths": settings.save_full_paths, "use_correlation": settings.use_correlation, "drift_method": settings.drift}, "duration_sec": clock.seconds,
    }
    files.write_json(summary, f"{folders.reports}/monte_carlo_summary.json")
    return summary


def sheets(spark: SparkSession, folders: Folders, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """The tables of the workbook; what has no upstream table is left out."""
    get = lambda n: files.read_optional(spark, f"{folders.tables}/{n}.parquet")

    def pivoted(df: DataFrame | None, keys: list[str]) -> DataFrame | None:
        if df is None:
            return None
        names = sorted(r.metric_name for r in df.select("metric_name").distinct().collect())
        return df.groupBy(*keys).pivot("metric_name", names).agg(F.first("value")).orderBy(*keys)

    down = get("drawdown_series")
    out = {
        "Portfolio Metrics": get("portfolio_metrics"), "Per-Ticker Metrics": pivoted(get("metrics_per_ticker"), ["ticker"]), "Drawdown Summary": None if down is None else down.groupBy("ticker").agg(F.min("drawdown_pct").alias("max_drawdown"), F.avg("drawdown_pct").alias("mean_drawdown")).orderBy("ticker"),
        "Forecasts": get("forecasts"), "MC Risk": pivoted(get("mc_metrics"), ["scenario_name", "ticker", "method"]), "Config": spark.createDataFrame([(k, str(getattr(settings, k))) for k in ("risk_free_rate", "benchmark", "weights", "export_csv", "export_excel")], "parameter string, value string"),
    }
    return {k: v for k, v in out.items() if v is not None}


def run_export(spark: SparkSession, folders: Folders, settings: Settings = DEFAULTS) -> dict:
    """CSV of six tables, a workbook if openpyxl is there, and the summary of all steps; what is missing is skipped."""
    clock, written, book = Clock(), [], False
    if settings.export_csv:
        for name in CSV_TABLES:
            df = files.read_optional(spark, f"{folders.tables}/{name}.parquet")
            if df is not None:
                written.append(files.write_csv(df, f"{folders.exports}/{name}.csv"))
    if settings.export_excel:
        try:
            import openpyxl  # noqa: F401
            import pandas as pd

            tables = sheets(spark, folders, settings)
            if len(tables) > 1:
                Path(folders.exports).mkdir(parents=True, exist_ok=True)
                with pd.ExcelWriter(f"{folders.exports}/portfolio_report.xlsx", engine="openpyxl") as w:
                    for name in SHEETS:
                        if name in tables:
                            tables[name].toPandas().to_excel(w, sheet_name=name, index=False)
                book = True
        except ImportError:
            log.warning("openpyxl is missing; no workbook")
    reports = {"step_2_cleaning": f"{folders.tables}/cleaning_report.json", **{f"step_{k}_{n}": f"{folders.reports}/{n}_summary.json" for k, n in ((3, "eda"), (4, "metrics"), (5, "forecasting"), (6, "monte_carlo"))}}
    steps = {k: v for k, p in reports.items() if (v := files.read_json(p)) is not None}
    summary = {"run_timestamp": clock.stamp, "pipeline_version": settings.version, "steps": steps, "export": {"csv_files_written": len(written), "excel_written": book, "duration_sec": clock.seconds}}
    files.write_json(summary, f"{folders.reports}/pipeline_summary.json")
    return {"csv_files_written": len(written), "csv_paths": written, "excel_written": book, "summary_written": True}


def run_all(spark: SparkSession, folders: Folders, forecasts: list[forecast.Scenario], simulations: list[simulate.Scenario], settings: Settings = DEFAULTS) -> dict:
    """Steps 2 to 7 on raw bars that are there already."""
    return {"cleaning": run_cleaning(spark, folders, settings), "eda": run_eda(spark, folders, settings), "metrics": run_metrics(spark, folders, settings), "forecasting": run_forecasting(spark, folders, forecasts, settings), "monte_carlo": run_monte_carlo(spark, folders, simulations, settings), "export": run_export(spark, folders, settings)}
