import datetime as dt
import math

import numpy as np
import pytest

from panelforge.config import Settings
from panelforge.operators import forecast as FC
from panelforge.operators import models, simulate
from panelforge.functions.rng import normal, scenario_seed, uniform
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def walk(spark):
    """Two tickers of 252 business days."""
    rng = np.random.default_rng(0)
    rows = []
    for t in ("AAA", "BBB"):
        p, d = 100.0, dt.date(2022, 1, 3)
        for _ in range(252):
            while d.weekday() > 4:
                d += dt.timedelta(1)
            p *= math.exp(rng.normal(0.001, 0.02))
            rows.append((d, t, p))
            d += dt.timedelta(1)
    prices = spark.createDataFrame(rows, "date date, ticker string, close double")
    from panelforge.operators.cleaning import compute_returns

    return prices.cache(), compute_returns(prices).cache()


# ── draws and paths ──────────────────────────────────────────────────────────
def test_draws(spark):
    df = spark.range(20000).select(uniform(F.lit(1), F.col("id")).alias("u"), normal(F.lit(1), F.col("id")).alias("z"))
    a = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(a[0] - 0.5) < 0.01 and 0 < a[1] and a[2] < 1 and abs(a[3]) < 0.03 and abs(a[4] - 1) < 0.02
    assert df.repartition(7).agg(F.sum("z")).first()[0] == pytest.approx(df.agg(F.sum("z")).first()[0])
    assert scenario_seed(42, "a") != scenario_seed(42, "b") and scenario_seed(42, "a") == scenario_seed(42, "a") < 2**32


def params(spark, mu, sigma, s0=100.0):
    p = spark.createDataFrame([("A", mu, sigma, 0.0, 0.0, 100)], "ticker string, mu_daily double, sigma_daily double, mu_annual double, sigma_annual double, n_observations long")
    return p, spark.createDataFrame([("A", s0)], "ticker string, s0 double")


def test_gbm_without_noise(spark):
    r = simulate.simulate_gbm(simulate.Scenario("x", "gbm", 5, 3), *params(spark, 0.01, 0.0), 1).collect()
    assert len(r) == 3 and all(x["values"] == pytest.approx([100 * math.exp(0.01 * k) for k in range(6)]) for x in r)


def test_gbm_converges(spark):
    paths = simulate.simulate_gbm(simulate.Scenario("x", "gbm", 5, 20000), *params(spark, 0.001, 0.02), 7)
    m = simulate.terminal(paths).agg(F.avg("t"), F.count("*")).first()
    assert m[1] == 20000 and m[0] == pytest.approx(100 * math.exp(5 * 0.001), rel=0.01)


def test_bootstrap(walk, spark):
    prices, returns = walk
    s0 = simulate.last_prices(prices)
    support = {round(r.simple_return, 9) for r in returns.where("ticker = 'AAA'").collect()}
    paths = simulate.simulate_bootstrap(simulate.Scenario("x", "bootstrap", 6, 50), returns, s0, 3).where("ticker = 'AAA'").collect()
    steps = {round(b / a - 1, 9) for p in paths for a, b in zip(p["values"], p["values"][1:], strict=False)}
    assert steps <= support and len(steps) > 50
    hist = [r.simple_return for r in returns.where("ticker = 'AAA'").orderBy("date").collect()]
    near = {(round(a, 9), round(b, 9)) for a, b in zip(hist, hist[1:] + hist[:1], strict=True)}
    blocks = simulate.simulate_bootstrap(simulate.Scenario("x", "block_bootstrap", 6, 50), returns, s0, 3, 3).where("ticker = 'AAA'").collect()
    for p in blocks:
        r = [round(b / a - 1, 9) for a, b in zip(p["values"], p["values"][1:], strict=False)]
        assert len(r) == 6 and all((r[k], r[k + 1]) in near for k in (0, 1, 3, 4))
    with pytest.raises(ValueError):
        simulate.simulate_bootstrap(simulate.Scenario("x", "block_bootstrap", 6, 5), returns, s0, 3, 251)
    one = returns.where("ticker = 'AAA'").limit(1)
    flat = simulate.simulate_bootstrap(simulate.Scenario("x", "bootstrap", 4, 2), one, s0, 3).first()
    assert len(set(flat["values"])) == 1


def test_correlated(walk):
    prices, returns = walk
    corr = np.array([[1, 0.8], [0.8, 1]])
    s = simulate.Scenario("x", "gbm", 4, 3000)
    paths = simulate.simulate_correlated(s, simulate.gbm_params(returns), simulate.last_prices(prices), corr, ["AAA", "BBB"], 5)
    one = {t: np.array([r["values"][1] / r["values"][0] for r in paths.where(F.col("ticker") == t).orderBy("simulation_id").collect()]) for t in ("AAA", "BBB")}
    assert np.corrcoef(np.log(one["AAA"]), np.log(one["BBB"]))[0, 1] == pytest.approx(0.8, abs=0.03)
    port = simulate.portfolio_paths(paths, {"AAA": 0.25, "BBB": 0.75}).orderBy("simulation_id").collect()
    assert port[0]["values"][0] == pytest.approx(1) and port[7]["values"][1] == pytest.approx(0.25 * one["AAA"][7] + 0.75 * one["BBB"][7])
    with pytest.raises(ValueError):
        simulate.simulate_correlated(s, simulate.gbm_params(returns), simulate.last_prices(prices), np.array([[1, np.nan], [np.nan, 1]]), ["AAA", "BBB"], 5)


def test_positive_definite():
    m = np.array([[1.0, 1, 0], [1, 1, 0], [0, 0, 1]])
    fixed = simulate.nearest_positive_definite(m)
    assert not simulate.is_positive_definite(m) and simulate.is_positive_definite(fixed) and np.allclose(np.diag(fixed), 1) and np.allclose(fixed, fixed.T)


def test_summaries_against_numpy(walk):
    prices, returns = walk
    paths = simulate.run_scenario(simulate.Scenario("s", "gbm", 8, 300, portfolio=True), prices, returns).cache()
    rows = paths.where("ticker = 'AAA'").collect()
    v = np.array([r["values"] for r in rows])
    s0 = rows[0].s0
    r = v[:, -1] / s0 - 1
    t = simulate.terminal_distribution(paths).where("ticker = 'AAA'").first()
    z = (v[:, -1] - v[:, -1].mean()) / v[:, -1].std()
    assert t.terminal_skew == pytest.approx((z**3).mean()) and t.terminal_kurtosis == pytest.approx((z**4).mean() - 3) and t.return_p5 == pytest.approx(np.percentile(r, 5))
    risk = {(x.ticker, x.metric_name): x.value for x in simulate.simulated_var_cvar(paths).collect()}
    assert risk["AAA", "var_95"] == pytest.approx(-np.percentile(r, 5)) and risk["AAA", "cvar_95"] == pytest.approx(-r[r <= np.percentile(r, 5)].mean())
    loss = {x.metric_name: x.value for x in simulate.loss_probabilities(paths).where("ticker = 'AAA'").collect()}
    assert set(loss) == {"prob_loss_20pct", "prob_loss_10pct", "prob_loss", "prob_gain_lt_10pct", "prob_gain_lt_20pct"} and loss["prob_loss"] == pytest.approx((r < 0).mean())
    low = (v / np.maximum.accumulate(v, axis=1) - 1).min(1)
    d = simulate.path_drawdowns(paths).where("ticker = 'AAA'").first()
    assert (d.mean_max_drawdown, d.p5_max_drawdown) == pytest.approx((low.mean(), np.percentile(low, 5)))
    q = simulate.path_percentiles(paths, dt.date(2022, 12, 24)).where("ticker = 'AAA' AND day_offset = 3").orderBy("percentile").collect()
    assert [x.value for x in q] == pytest.approx(np.percentile(v[:, 3], Settings().percentiles).tolist()) and q[0].date == dt.date(2022, 12, 29)
    assert {x.ticker for x in paths.select("ticker").distinct().collect()} == {"AAA", "BBB", "PORTFOLIO"}
    assert simulate.broken_invariants(simulate.simulated_var_cvar(paths)).count() == 0
    assert simulate.full_paths(paths).count() == 3 * 300 * 9
    again = simulate.run_scenario(simulate.Scenario("s", "gbm", 8, 300, portfolio=True), prices, returns).where("ticker = 'AAA'").orderBy("simulation_id").first()
    assert again["values"] == paths.where("ticker = 'AAA'").orderBy("simulation_id").first()["values"]


def test_names_and_choices(walk):
    assert simulate.parse_tickers(None, ["A", "B"]) == simulate.parse_tickers("all", ["A", "B"]) == (["A", "B"], [])
    assert simulate.parse_tickers("B, X", ["A", "B"]) == (["B"], ["X"])
    with pytest.raises(ValueError):
        simulate.parse_tickers("ALL!", ["A"])
    assert FC.parse_tickers("ALL", ["A"]) == (["A"], []) and FC.parse_tickers("a,zz", ["A"]) == (["A"], ["ZZ"])
    assert [simulate.parse_bool(x, True) for x in (None, "no", " Yes", True, "0")] == [True, False, True, True, False]
    with pytest.raises(ValueError):
        simulate.run_scenario(simulate.Scenario("s", "magic", 8, 3), *walk)
    assert "above" in simulate.interpretation([("gbm", 0.1), ("block_bootstrap", 0.9), ("bootstrap", 0.2)]) and simulate.interpretation([("gbm", -0.1), ("bootstrap", 0.2)]) is None


# ── forecasts ────────────────────────────────────────────────────────────────
def test_naive_models(spark):
    y = [1.0, 2.0, 4.0, 3.0]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(k), v) for k, v in enumerate(y)] + [("B", dt.date(2024, 1, 1), 1.0)], "ticker string, date date, y double")
    z, d = 1.9599639845400536, np.diff(y)
    for method, point, half in (("random_walk", [3, 3, 3], z * d.std(ddof=1) * np.sqrt([1, 2, 3])), ("drift", 3 + d.mean() * np.array([1, 2, 3]), z * d.std(ddof=1) * np.sqrt([1, 2, 3])), ("mean", [2.5] * 3, [z * np.std(y, ddof=1)] * 3)):
        rows = FC.naive(df, method, 3, 0.95).orderBy("step").collect()
        assert [r.forecast for r in rows] == pytest.approx(list(point)) and [r.upper_ci - r.forecast for r in rows] == pytest.approx(list(half))
    with pytest.raises(ValueError):
        FC.naive(df, "magic", 3, 0.95)


@pytest.mark.parametrize("n,init,step,h,expanding", [(20, 10, 3, 2, True), (12, 10, 3, 2, False), (11, 10, 3, 2, True), (30, 8, 5, 4, False)])
def test_folds(spark, n, init, step, h, expanding):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(k), float(k)) for k in range(n)], "ticker string, date date, y double")
    want, fold, end = [], 0, init
    while end + h <= n:
        want.append((fold, 0 if expanding else fold * step, end))
        fold, end = fold + 1, end + step
    assert [tuple(r)[1:] for r in FC.folds(df, init, step, h, expanding).orderBy("fold").collect()] == want
    rows = FC.walk_forward(df, "naive_random_walk", h, 0.95, Settings(train_initial=init, step=step, expanding=expanding)).collect()
    assert len(rows) == len(want) * h
    for r in rows:  # the last training value, and nothing later
        assert r.predicted == init + r.fold * step - 1 and r.fold_end_date < r.forecast_date


def test_metrics_of_forecasts(spark):
    rows = [("A", 0, 1.0, 0.5, 0.0, 2.0), ("A", 0, -1.0, 0.5, -0.5, 1.0), ("A", 1, 2.0, 1.0, 0.0, 2.0), ("A", 1, 0.0, 0.0, -1.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, fold long, actual double, predicted double, lower_ci double, upper_ci double")
    m = {r.metric_name: r.value for r in FC.forecast_metrics(df, spark.createDataFrame([("A",), ("Z",)], "ticker string")).where("ticker = 'A'").collect()}
    assert m["rmse"] == pytest.approx(math.sqrt((0.25 + 2.25 + 1) / 4)) and m["mape"] == pytest.approx((0.5 + 1.5 + 0.5) / 3 * 100)
    assert m["directional_accuracy"] == 0.75 and m["coverage_rate"] == 0.75 and m["n_folds"] == 2 and m["n_predictions"] == 4
    z = {r.metric_name: r.value for r in FC.forecast_metrics(df, spark.createDataFrame([("Z",)], "ticker string")).collect()}
    assert z["rmse"] is None and z["n_folds"] == 0


def test_best_models(spark):
    rows = [("s1", "A", "naive_random_walk", 2.0), ("s2", "A", "naive_mean", 1.0), ("s1", "B", "naive_random_walk", 1.0), ("s2", "B", "naive_mean", 1.0), ("s2", "C", "naive_mean", None), ("s2", "D", "naive_mean", 3.0)]
    df = spark.createDataFrame([(a, b, c, "rmse", v) for a, b, c, v in rows], "scenario_name string, ticker string, model_type string, metric_name string, value double")
    got = {r.ticker: (r.model, r.beats_random_walk) for r in FC.best_models(df).collect()}
    assert got == {"A": ("naive_mean", True), "B": ("naive_random_walk", None), "C": (None, None), "D": ("naive_mean", None)}


def ar(phi, n, seed=0):
    rng, y = np.random.default_rng(seed), [0.0]
    for _ in range(n - 1):
        y.append(phi * y[-1] + rng.normal())
    return np.array(y)


def test_adf():
    assert models.adf_p_value(-2.86154) == pytest.approx(0.05, abs=0.002) and models.adf_p_value(-3.43035) == pytest.approx(0.01, abs=0.001)
    assert models.adf(ar(0, 300))["p_value"] < 0.01 and models.adf(np.cumsum(ar(0, 300, 3)))["p_value"] > 0.05
    assert models.adf(np.ones(50)) is None and models.adf(np.arange(10.0)) is None


def test_arima():
    r = models.arima(ar(0.5, 300), 10, 0.95)
    p, d, q = r["order"]
    assert r["converged"] and d == 0 and p + q >= 1 and len(r["forecast"]) == 10
    assert (r["lower"] <= r["forecast"]).all() and (r["forecast"] <= r["upper"]).all()
    trend = models.arima(np.arange(200.0) + ar(0, 200), 5, 0.95)
    assert trend["order"][1] >= 1 and trend["forecast"][-1] > 195
    assert not models.arima(np.array([1.0, np.nan] * 20), 3, 0.95)["converged"]
    assert models.arima(np.ones(40), 3, 0.95)["forecast"] == pytest.approx([1, 1, 1])


def test_trend_and_seasons():
    days = np.arange(0, 700)
    y = 0.01 * days + np.sin(2 * np.pi * days / 7) + np.random.default_rng(0).normal(0, 0.1, 700)
    r = models.trend_seasonal(y, days, np.arange(700, 714), 0.95, yearly=False)
    assert np.abs(r["forecast"] - (0.01 * np.arange(700, 714) + np.sin(2 * np.pi * np.arange(700, 714) / 7))).max() < 0.35
    assert (r["lower"] <= r["forecast"]).all() and (r["forecast"] <= r["upper"]).all() and r["yearly"] is None


def test_scenarios(walk, spark):
    prices, returns = walk
    s = Settings(train_initial=150, step=40)
    f, m = FC.run_scenario(FC.Scenario("a", "arima_returns", "returns", 5, 0.95, "aaa"), prices, returns, s)
    f = f.orderBy("forecast_date").collect()
    assert len(f) == 5 and {r.ticker for r in f} == {"AAA"} and all(r.lower_ci <= r.forecast <= r.upper_ci for r in f) and all(r.forecast_date.weekday() < 5 for r in f)
    assert {r.metric_name for r in m.collect()} == set(FC.METRICS)
    short = returns.where("date < '2022-03-01'")
    assert FC.run_scenario(FC.Scenario("a", "naive_mean", "returns", 5, 0.95), prices, short, s)[0].count() == 0
    with pytest.raises(ValueError):
        FC.run_scenario(FC.Scenario("a", "magic", "returns", 5, 0.95), prices, returns, s)
    with pytest.raises(ValueError):
        FC.series(prices, returns, "volumes")
    bad = FC.fitted(FC.series(prices, returns, "returns").withColumn("y", F.when(F.col("date") == dt.date(2022, 1, 4), float("inf")).otherwise(F.col("y"))), "arima_returns", 3, 0.95).collect()
    assert not any(r.converged for r in bad) and len(bad) == 6


def test_custom_models(walk):
    prices, returns = walk
    FC.CUSTOM["last"] = lambda y, days, future, level: {"converged": True, "forecast": np.full(len(future), y[-1]), "lower": np.full(len(future), y[-1] - 1), "upper": np.full(len(future), y[-1] + 1)}
    try:
        rows = FC.walk_forward(FC.series(prices, returns, "prices"), "last", 3, 0.95, Settings(train_initial=150, step=40)).collect()
    finally:
        del FC.CUSTOM["last"]
    assert len(rows) == 2 * 3 * 3 and all(r.upper_ci - r.predicted == pytest.approx(1) for r in rows)


def test_stationarity(walk):
    rows = {(r.ticker, r.series_type): r for r in FC.stationarity(walk[1]).collect()}
    assert rows["AAA", "returns"].is_stationary and not rows["AAA", "log_prices"].is_stationary and rows["AAA", "returns"].critical_5pct == pytest.approx(-2.87, abs=0.01)
    few = FC.stationarity(walk[1].where("date < '2022-01-15'")).first()
    assert few.p_value is None and few.is_stationary is False


