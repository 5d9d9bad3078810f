"""Queries against their SQL on small driver tables, where those are at hand."""

import math
import os

import pytest

from panelforge.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["return_qq", "metric_invariants", "var_cvar_invariants", "last_prices", "return_metrics", "calendar_reindex", "clean_prices", "risk_metrics", "drawdown_duration", "portfolio_metrics", "rolling_metrics", "distribution_stats", "sector_corr_matrix", "flat_price_runs", "walk_forward_drift", "best_model_per_ticker", "simulate_block_bootstrap", "terminal_distribution", "method_comparison"]
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"stationarity_adf", "forecast_arima", "forecast_arima_log_prices", "forecast_trend_seasonal", "walk_forward_arima", "walk_forward_trend_seasonal", "simulate_portfolio_correlated"}


def plain(rows, names):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.12g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, FOLDER), c.sql(registry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


@needs_data
def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["ticker", "metric_name", "value", "category"] and df.count() == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_archive_holds_the_package():
    import zipfile

    import __spark_entry__

    names = zipfile.ZipFile(__spark_entry__.archive()).namelist()
    assert "panelforge/__init__.py" in names and "panelforge/operators/metrics.py" in names
