"""Contracts of the persisted tables: column types and named rules, checked in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """columns: name to type, with a trailing ? if nulls are allowed; rules: name to SQL condition; key: unique columns; prefixes: families of further double columns."""

    columns: dict[str, str]
    rules: dict[str, str] = field(default_factory=dict)
    key: tuple[str, ...] = ()


_NAMED = {"scenario_name": "string", "ticker": "string", "method": "string"}
CONTRACTS = {
    "prices_clean": Contract({"date": "date", "ticker": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint?"}, {"prices are positive": "least(open, high, low, close) > 0", "high is not below low": "high >= low"}, ("date", "ticker")),
    "returns_daily": Contract({"date": "date", "ticker": "string", "simple_return": "double", "log_return": "double"}),
    "metrics_per_ticker": Contract({"ticker": "string", "metric_name": "string", "value": "double?", "category": "string"}, {"known category": "category IN ('return', 'risk', 'risk_adjusted')"}),
    "rolling_metrics": Contract({"date": "date", "ticker": "string", "metric_name": "string", "value": "double?"}),
    "drawdown_series": Contract({"date": "date", "ticker": "string", "close": "double", "running_peak": "double", "drawdown_pct": "double"}, {"close is positive": "close > 0", "peak is positive": "running_peak > 0", "drawdown is not positive": "drawdown_pct <= 0"}),
    "forecasts": Contract({"scenario_name": "string", "ticker": "string", "model_type": "string", "target": "string", "forecast_date": "date", "forecast": "double", "lower_ci": "double", "upper_ci": "double", "confidence_level": "double"}),
    "forecast_metrics": Contract({"scenario_name": "string", "ticker": "string", "model_type": "string", "metric_name": "string", "value": "double?"}),
    "stationarity_tests": Contract({"ticker": "string", "series_type": "string", "adf_statistic": "double?", "p_value": "double?", "is_stationary": "boolean", "critical_1pct": "double?", "critical_5pct": "double?"}),
    "mc_paths_summary": Contract({**_NAMED, "day_offset": "bigint", "date": "date", "percentile": "double", "value": "double"}),
    "mc_terminal_distribution": Contract({**_NAMED, "s0": "double", "terminal_mean": "double", "terminal_std": "double", "terminal_skew": "double", "terminal_kurtosis": "double"}),
    "mc_metrics": Contract({**_NAMED, "metric_name": "string", "value": "double"}),
    "mc_drawdown_distribution": Contract({**_NAMED, **dict.fromkeys(("mean_max_drawdown", "median_max_drawdown", "p5_max_drawdown", "p1_max_drawdown", "prob_drawdown_exceeds_20pct"), "double")}, {"drawdowns are not positive": "greatest(mean_max_drawdown, median_max_drawdown, p5_max_drawdown, p1_max_drawdown) <= 0", "a share": "prob_drawdown_exceeds_20pct BETWEEN 0 AND 1"}),
}


def violations(df: DataFrame, name: str) -> dict[str, int]:
    """Broken rules with the number of rows (for types: 1).  Further columns are allowed."""
    c, types, out = CONTRACTS[name], dict(df.dtypes), {}
    for column, kind in c.columns.items():
        if column not in types:
            out[f"{column} is missing"] = 1
        elif types[column] != kind.rstrip("?"):
            out[f"{column} is {types[column]}, not {kind.rstrip('?')}"] = 1
    if out:
        return out
    tests = {f"{k} is null": F.col(k).isNull() for k, kind in c.columns.items() if not kind.endswith("?")}
    tests |= {rule: ~F.coalesce(F.expr(sql), F.lit(True)) for rule, sql in c.rules.items()}
    aggs = [F.count_if(t).alias(f"t{k}") for k, t in enumerate(tests.values())]
    if c.key:
        aggs.append((F.count("*") - F.count_distinct(F.struct(*c.key))).alias("key"))
    row = df.agg(*aggs).first()
    out = {rule: row[f"t{k}"] for k, rule in enumerate(tests) if row[f"t{k}"]}
    if c.key and row.key:
        out[f"{', '.join(c.key)} repeat"] = row.key
    return out


def enforce(df: DataFrame, name: str, error: type[Exception] = ValueError) -> DataFrame:
    broken = violations(df, name)
    if broken:
        raise error(f"{name}: " + "; ".join(f"{rule} ({n})" for rule, n in broken.items()))
    return df
