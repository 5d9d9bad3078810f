import json
import math
import random

import numpy as np
import pytest

from panelforge.config import Settings
from panelforge.operators import metrics as M

_RNG = np.random.default_rng(11)
BENCH = _RNG.normal(0.001, 0.02, 10).round(4).tolist()
A, B = ((k * np.array(BENCH) + _RNG.normal(0, 0.01, 10)).round(4).tolist() for k in (1.4, -0.6))


def long(df):
    return {(r.ticker, r.metric_name): r.value for r in df.collect()}


def test_total_return_and_cagr(returns):
    m = long(M.return_metrics(returns(A=[0.01] * 5)))
    assert m["A", "total_return"] == pytest.approx(1.01**5 - 1)
    assert m["A", "cagr"] == pytest.approx(1.01**252 - 1)
    assert m["A", "mean_monthly"] == pytest.approx(0.21) and m["A", "pct_positive_days"] == 1


def test_var_and_cvar(returns):
    m = long(M.risk_metrics(returns(A=[-0.05, -0.03, 0.0, 0.02, 0.04], B=B)))
    assert m["A", "var_95"] == pytest.approx(0.046) and m["A", "cvar_95"] == pytest.approx(0.05)
    q = np.quantile(B, 1 - 0.95)
    assert m["B", "cvar_95"] == pytest.approx(abs(np.mean([x for x in B if x <= q])))
    assert m["B", "var_99"] >= m["B", "var_95"] and m["B", "max_drawdown"] <= 0


def test_downside_and_flat(returns):
    m = long(M.risk_metrics(returns(F=[0.0] * 20, O=[0.1, -0.2, 0.1], D=A)))
    assert m["F", "annual_vol"] == 0 and m["F", "downside_deviation"] is None and m["O", "downside_deviation"] is None
    assert m["D", "downside_deviation"] == pytest.approx(np.std([x for x in A if x < 0], ddof=1) * math.sqrt(252))
    adj = long(M.risk_adjusted(returns(F=[0.0] * 20)))
    assert adj == {("F", "sharpe"): None, ("F", "sortino"): None, ("F", "calmar"): None}


def plain(r):
    """Drawdowns of a growth path from 1, its longest run under water, and whether it ends on a peak."""
    p = np.concatenate([[1.0], np.cumprod(1 + np.array(r))])
    dd = p / np.maximum.accumulate(p) - 1
    best, begin = 0, None
    for k, x in enumerate(dd):
        if x < 0 and begin is None:
            begin = k
        elif x >= 0 and begin is not None:
            best, begin = max(best, k - begin), None
    if begin is not None:
        best = max(best, len(dd) - 1 - begin)
    return dd.min(), best, bool(dd[-1] >= 0)


def test_duration_against_a_loop(returns):
    r = random.Random(1)
    data = {f"T{k}": [r.gauss(0.001, 0.02) for _ in range(r.randrange(1, 60))] for k in range(25)} | {"UP": [0.01] * 5, "DOWN": [-0.01] * 4, "ONE": [-0.5]}
    got = {x.ticker: (x.max_drawdown, x.max_duration, x.recovered) for x in M.drawdown_duration(returns(**data)).collect()}
    for t, x in data.items():
        low, n, ok = plain(x)
        assert got[t] == (pytest.approx(low), n, ok), t


def test_drawdown_series(panel):
    rows = M.drawdown_series(panel(A=[100.0, 101.0, 99.0, 102.0], R=[float(x) for x in range(100, 110)])).orderBy("date").collect()
    assert [r.drawdown_pct for r in rows if r.ticker == "A"] == pytest.approx([0, 0, 99 / 101 - 1, 0])
    assert all(r.drawdown_pct == 0 for r in rows if r.ticker == "R")


def test_rolling(returns):
    s = Settings(sharpe_window=4, beta_window=4, corr_window=5)
    r = returns(A=A, BENCH=BENCH, SHORT=[0.1, 0.2, 0.3], FLAT=[0.01] * 10)
    rows = M.rolling_metrics(r, "BENCH", s).collect()
    by = {}
    for x in rows:
        by.setdefault((x.ticker, x.metric_name), []).append((x.date, x.value))
    assert len(by["A", "rolling_sharpe_4"]) == 7 and len(by["A", "rolling_corr_5"]) == 6
    assert not any(t == "SHORT" for t, _ in by) and ("FLAT", "rolling_sharpe_4") not in by
    assert all(v == pytest.approx(1) for _, v in by["BENCH", "rolling_beta_4"])
    last = max(by["A", "rolling_beta_4"])[1]
    assert last == pytest.approx(np.cov(A[-4:], BENCH[-4:])[0, 1] / np.var(BENCH[-4:], ddof=1))
    assert max(by["A", "rolling_corr_5"])[1] == pytest.approx(np.corrcoef(A[-5:], BENCH[-5:])[0, 1])
    assert max(by["A", "rolling_sharpe_4"])[1] == pytest.approx((np.mean(A[-4:]) - 0.04 / 252) / np.std(A[-4:], ddof=1) * math.sqrt(252))


def test_portfolio(returns):
    r = returns(A=A, B=B, BENCH=BENCH)
    one = M.portfolio_metrics(r, {"A": 0.3, "B": 0.7}, "BENCH").first()
    p = 0.3 * np.array(A) + 0.7 * np.array(B)
    assert one.total_return == pytest.approx(np.prod(1 + p) - 1) and one.annual_vol == pytest.approx(p.std(ddof=1) * math.sqrt(252))
    assert one.beta_vs_benchmark == pytest.approx(np.cov(p, BENCH)[0, 1] / np.var(BENCH, ddof=1))
    assert one.diversification_ratio == pytest.approx((0.3 * np.std(A, ddof=1) + 0.7 * np.std(B, ddof=1)) / p.std(ddof=1))
    assert json.loads(one.weights_used) == {"A": 0.3, "B": 0.7} and one.weights_strategy == "custom"
    alone = M.portfolio_metrics(returns(A=A)).first()
    assert alone.diversification_ratio == pytest.approx(1) and alone.beta_vs_benchmark is None and alone.weights_strategy == "equal"


def test_portfolio_needs_every_ticker(returns):
    r = returns(A=A, B=B[:6])
    assert M.portfolio_returns(r, {"A": 0.5, "B": 0.5}).count() == 6
    with pytest.raises(Exception, match="twice"):
        M.portfolio_returns(r.unionByName(r), {"A": 0.5, "B": 0.5}).collect()


@pytest.mark.parametrize("weights", [{"A": 1.0}, {"A": 0.5, "B": 0.4}, {"A": 0.5, "B": 0.3, "C": 0.2}])
def test_wrong_weights(weights):
    with pytest.raises(ValueError):
        M.resolve_weights(["A", "B"], weights)


def test_beta_per_ticker(returns):
    got = {r.ticker: r.beta for r in M.beta_per_ticker(returns(A=A, BENCH=BENCH, X=[0.1]), "BENCH").collect()}
    assert got["BENCH"] is None and got["X"] is None and got["A"] == pytest.approx(np.cov(A, BENCH)[0, 1] / np.var(BENCH, ddof=1))


def test_invariants_hold(returns):
    assert M.invariants(returns(A=A, B=B)).count() == 0


def test_broken_rules_are_named(spark):
    rows = [("OK", 0.1, 0.2, 0.15, -0.3), ("VAR", 0.2, 0.1, 0.2, 0.0), ("ALL", 0.3, 0.1, 0.2, 0.4)]
    got = M.broken_rules(spark.createDataFrame(rows, "ticker string, var_95 double, var_99 double, cvar_95 double, max_drawdown double"))
    assert {r.ticker: r.broken for r in got.collect()} == {"VAR": ["var_99<var_95"], "ALL": ["var_99<var_95", "cvar_95<var_95", "max_drawdown>0"]}
