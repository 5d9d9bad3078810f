import datetime as dt
import json
import math
from pathlib import Path

import numpy as np
import pytest

from panelforge.config import Settings
from panelforge.functions.calendar import nyse_holidays
from panelforge.operators import forecast, simulate
from panelforge.plans import pipeline as P
from panelforge.sources import files
from panelforge.streaming import bars as streaming


@pytest.fixture(scope="module")
def raw(spark):
    rng, rows = np.random.default_rng(1), []
    closed = set(nyse_holidays(2022, 2023))
    for t in ("aaa", "BBB", "THIN"):
        p, d = 50.0, dt.date(2022, 1, 3)
        for k in range(330):
            while d.weekday() > 4 or d in closed:
                d += dt.timedelta(1)
            p *= math.exp(rng.normal(0, 0.02))
            if t != "THIN" or k % 9 == 0:
                close = -p if k == 200 and t == "aaa" else p
                rows.append((d, t, p, p * 1.01, p * 0.99, close, 0 if k == 50 else 1000))
                if k == 10:
                    rows.append((d, t, p, p * 1.01, p * 0.99, p * 2, 1000))
            d += dt.timedelta(1)
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume long")


def test_all_steps(spark, raw, tmp_path):
    f = P.Folders(str(tmp_path))
    meta = {"aaa": {"currency": "USD", "marketCap": 5}, "BBB": {"currency": "EUR", "beta": 1.5}}
    r = P.run_ingestion(spark, raw, ["aaa", "BBB", "THIN", "NONE"], dt.date(2022, 1, 1), dt.date(2024, 1, 1), f, meta)
    assert r["tickers_failed"] == ["NONE"] and r["rows_fetched"] == raw.count()
    meta_file = json.loads(Path(f"{f.raw}/metadata.json").read_text())
    assert len(meta_file["aaa"]) == 9 and meta_file["aaa"]["beta"] is None
    Path(f"{f.raw}/metadata.json").write_text(json.dumps({k.upper(): v for k, v in meta_file.items()}))
    s = Settings(sharpe_window=60, beta_window=40, corr_window=40, train_initial=200, step=50, benchmark="BBB")
    report = P.run_cleaning(spark, f, s)
    assert report["actions"]["duplicates_removed"] == 2 and report["actions"]["invalid_price_rows_dropped"] == 1 and report["actions"]["tickers_dropped_low_coverage"] == ["THIN"]
    assert report["output"]["tickers"] == 2 and "EUR,USD" in report["currency_warning"]
    e = P.run_eda(spark, f, s)
    assert set(e["distribution_stats"]) == {"AAA", "BBB"} and e["correlations"]["matrix"]["AAA"]["AAA"] == 1 and e["charts"]["by_block"]["02_return_distributions"] == 4
    m = P.run_metrics(spark, f, s)
    assert m["invariants_broken"] == {} and m["per_ticker"]["BBB"]["beta_vs_benchmark"] is None and m["per_ticker"]["AAA"]["max_drawdown"] < 0
    c = P.run_forecasting(spark, f, [forecast.Scenario("rw", "naive_random_walk", "returns", 10, 0.95), forecast.Scenario("mean", "naive_mean", "returns", 10, 0.95), forecast.Scenario("bad", "magic", "returns", 10, 0.95)], s)
    assert set(c["best_model_per_ticker"]) == {"AAA", "BBB"} and list(c["scenarios_failed"]) == ["bad"] and c["stationarity"]["returns_stationary_count"] == 2
    k = P.run_monte_carlo(spark, f, [simulate.Scenario("gbm_x", "gbm", 5, 120), simulate.Scenario("bootstrap_x", "bootstrap", 5, 90), simulate.Scenario("bad", "block_bootstrap", 5, 100, 9999)], Settings(save_full_paths=True))
    assert list(k["scenarios_failed"]) == ["bad"] and k["correlation_matrix_health"]["is_positive_definite"] and "VaR" in k["method_comparison"].get("interpretation", "VaR") and len(k["warnings"]) == 1
    x = P.run_export(spark, f, s)
    assert x["csv_files_written"] == 6 and list(json.loads(Path(f"{f.reports}/pipeline_summary.json").read_text())["steps"]) == ["step_2_cleaning", "step_3_eda", "step_4_metrics", "step_5_forecasting", "step_6_monte_carlo"]
    assert list(P.sheets(spark, f)) == list(P.SHEETS)
    assert "sharpe" in P.sheets(spark, f)["Per-Ticker Metrics"].columns
    first = spark.read.parquet(f"{f.tables}/mc_metrics.parquet").collect()
    P.run_monte_carlo(spark, f, [simulate.Scenario("gbm_x", "gbm", 5, 120), simulate.Scenario("bootstrap_x", "bootstrap", 5, 90)])
    assert spark.read.parquet(f"{f.tables}/mc_metrics.parquet").collect() == first


def test_missing_inputs(spark, tmp_path):
    f = P.Folders(str(tmp_path))
    for step in (P.run_cleaning, P.run_eda, P.run_metrics):
        with pytest.raises(FileNotFoundError):
            step(spark, f)
    assert P.run_export(spark, f)["csv_files_written"] == 0
    assert files.read_metadata(spark, f"{tmp_path}/none.json").count() == 0
    with pytest.raises(ValueError):
        P.run_ingestion(spark, None, [], dt.date(2022, 1, 1), dt.date(2022, 1, 2), f)
    with pytest.raises(ValueError):
        P.run_ingestion(spark, None, ["A"], dt.date(2022, 1, 3), dt.date(2022, 1, 2), f)


def test_wide_to_long(spark):
    wide = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 3, None), ("2024-01-03", 1.5, 2.5, 4, None)], "date string, A_Open double, A_Close double, Volume_A int, B_Close double")
    rows = files.wide_to_long(wide, ["A", "B", "C"]).orderBy("date").collect()
    assert [(r.ticker, r.close, r.volume, r.high) for r in rows] == [("A", 2.0, 3, None), ("A", 2.5, 4, None)]
    assert files.wide_to_long(wide, ["Z"]).count() == 0


def test_scenario_files(spark, tmp_path):
    def write(name, text):
        Path(f"{tmp_path}/{name}").write_text(text)
        return f"{tmp_path}/{name}"

    a = files.read_forecast_scenarios(spark, write("a.csv", "scenario_name,model,target,horizon_days,confidence_level,tickers\nx_1,naive_mean,returns,30,0.95,all\n"))
    assert a == [forecast.Scenario("x_1", "naive_mean", "returns", 30, 0.95, "all")]
    b = files.read_simulation_scenarios(spark, write("b.csv", "scenario_name,method,horizon_days,n_simulations,block_size,drift_method,tickers,simulate_portfolio\nm,block_bootstrap,30,100,10,zero,all,false\n"))
    assert b == [simulate.Scenario("m", "block_bootstrap", 30, 100, 10, "zero", "all", False)]
    for text in ("scenario_name,model\nx,naive_mean\n", "scenario_name,model,target,horizon_days,confidence_level\n", "scenario_name,model,target,horizon_days,confidence_level\na b,naive_mean,returns,1,0.9\n", "scenario_name,model,target,horizon_days,confidence_level\nab,magic,returns,1,0.9\n"):
        with pytest.raises(ValueError):
            files.read_forecast_scenarios(spark, write("c.csv", text))
    for text in ("scenario_name,method,horizon_days,n_simulations\nx,magic,1,1\n", "scenario_name,method,horizon_days,n_simulations,drift_method\nx,gbm,1,1,up\n"):
        with pytest.raises(ValueError):
            files.read_simulation_scenarios(spark, write("d.csv", text))
    with pytest.raises(FileNotFoundError):
        files.read_forecast_scenarios(spark, f"{tmp_path}/none.csv")


def test_json_and_retry(tmp_path):
    assert files.sanitise({"a": float("nan"), "b": np.float64(2), "c": [np.int64(3), dt.date(2024, 1, 2)], "d": np.array([1.0, np.inf])}) == {"a": None, "b": 2.0, "c": [3, "2024-01-02"], "d": [1.0, None]}
    with pytest.raises(TypeError):
        files.sanitise(object())
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert files.with_retry(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(KeyError):
        files.with_retry(lambda: {}["x"], sleep=waits.append)


def test_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 5), "A", 1.0, 1), (dt.datetime(2024, 1, 1, 0, 50), "A", 3.0, 2), (dt.datetime(2024, 1, 1, 0, 30), "A", 2.0, 3), (dt.datetime(2024, 1, 1, 1, 10), "A", 5.0, 4), (dt.datetime(2024, 1, 1, 1, 10), "A", 5.0, 4), (dt.datetime(2024, 1, 1, 9, 0), "B", 9.0, 5)]
    spark.createDataFrame(rows, "ts timestamp, k string, v double, id long").coalesce(1).write.parquet(f"{tmp_path}/in")
    ticks = spark.readStream.schema("ts timestamp, k string, v double, id long").parquet(f"{tmp_path}/in")
    q = streaming.stream_bars(streaming.first_of_key(ticks, ["id"]), "k", "v", late=None).writeStream.format("memory").queryName("bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ticker, r.window_start.hour): (r.open, r.high, r.low, r.close, r.volume) for r in spark.sql("SELECT * FROM bars").collect()}
    assert got == {("A", 0): (1.0, 3.0, 1.0, 3.0, 3), ("A", 1): (5.0, 5.0, 5.0, 5.0, 1)}
