import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import cleaning, eda

R = random.Random(42)
BASE = [R.gauss(0, 0.02) for _ in range(120)]
DATA = {"AAPL": BASE, "MSFT": [x + R.gauss(0, 0.004) for x in BASE], "XOM": [R.gauss(0, 0.02) for _ in range(120)], "FLAT": [0.01] * 120}


def test_distribution_against_pandas(returns):
    rows = {r.ticker: r for r in eda.distribution_stats(returns(**DATA, TINY=[0.1, 0.2])).collect()}
    for t in ("AAPL", "XOM"):
        s = pd.Series(DATA[t])
        assert rows[t].skew == pytest.approx(s.skew()) and rows[t].kurtosis == pytest.approx(s.kurtosis())
        z = (s - s.mean()) / s.std(ddof=0)
        jb = len(s) / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
        assert rows[t].jarque_bera_p == pytest.approx(math.exp(-jb / 2))
    assert rows["FLAT"].flat_lined and rows["FLAT"].skew == rows["FLAT"].kurtosis == 0
    assert rows["TINY"].skew is None and rows["TINY"].kurtosis is None and rows["TINY"].jarque_bera_p is None


def test_correlations(returns):
    r = returns(**DATA)
    m = {(x.ticker_a, x.ticker_b): x["corr"] for x in eda.correlation_matrix(r).collect()}
    assert len(m) == 16 and m["AAPL", "MSFT"] == m["MSFT", "AAPL"] == pytest.approx(np.corrcoef(DATA["AAPL"], DATA["MSFT"])[0, 1])
    assert m["AAPL", "AAPL"] == 1 and m["FLAT", "AAPL"] is None and m["FLAT", "FLAT"] is None
    top = eda.top_correlated_pairs(r, 2).collect()
    assert (top[0].a, top[0].b) == ("AAPL", "MSFT") and abs(top[0]["corr"]) >= abs(top[1]["corr"])
    assert eda.scatter(r, 1).count() == 120
    with pytest.raises(Exception, match="twice"):
        eda.correlation_pairs(r.unionByName(r), unique=True).collect()


def test_sectors(returns, spark):
    r = returns(**{k: DATA[k] for k in ("AAPL", "MSFT", "XOM")})
    s = spark.createDataFrame([("AAPL", "Tech"), ("MSFT", "Tech")], "ticker string, sector string")
    c = np.corrcoef([DATA[k] for k in ("AAPL", "MSFT", "XOM")])
    m = {(x.sector_a, x.sector_b): x["corr"] for x in eda.sector_corr_matrix(r, s).collect()}
    assert m["Tech", "Tech"] == pytest.approx(c[0, 1]) and m["Unknown", "Tech"] == pytest.approx((c[0, 2] + c[1, 2]) / 2) and m["Unknown", "Unknown"] is None
    assert {x.sector: x.avg_corr for x in eda.sector_avg_corr(r, s).collect()} == {"Tech": round(c[0, 1], 4), "Unknown": 0.0}


def test_moves_and_matches(returns):
    r = returns(A=[0.1, -0.3, 0.3, 0.05], B=[0.01, 0.02])
    top = [(x.ticker, x.simple_return) for x in eda.top_moves(r, 2).orderBy("ticker", "place").collect()]
    assert top == [("A", -0.3), ("A", 0.3), ("B", 0.02), ("B", 0.01)]
    got = {x.ticker: (x.eda_count, x.cleaning_count, x.overlap) for x in eda.outlier_match(r, cleaning.outlier_counts(r), 3).collect()}
    assert got == {"A": (3, 2, 2), "B": (2, 0, 0)}


def test_windows(panel, returns):
    p = eda.moving_averages(panel(A=[1.0, 2.0, 3.0, 4.0]), (2, 3)).orderBy("date").collect()
    assert [x.ma_2 for x in p] == [None, 1.5, 2.5, 3.5] and [x.ma_3 for x in p] == [None, None, 2.0, 3.0]
    v = eda.rolling_volatility(returns(A=BASE[:10], B=BASE[:4]), 5).collect()
    assert len(v) == 6 and {x.ticker for x in v} == {"A"}
    m = {x.month: x.volatility for x in eda.monthly_volatility(returns(A=BASE[:32]), 30).collect()}
    assert m["2024-01"] == pytest.approx(np.std(BASE[:31], ddof=1) * math.sqrt(252)) and m["2024-02"] is None


def test_flat_runs(panel):
    rows = eda.flat_runs(panel(A=[1.0, 1.0, 1.0, 2.0, 2.0, 3.0])).orderBy("date").collect()
    assert [(x.close, x.run_length) for x in rows] == [(1.0, 2), (1.0, 2), (2.0, 1)]


def test_chart_tables(returns):
    r = returns(**DATA)
    h = eda.histogram(r, 10).where("ticker = 'XOM'").orderBy("bin").collect()
    n, edges = np.histogram(DATA["XOM"], 10)
    assert [x.n for x in h] == n.tolist() and h[0].low == pytest.approx(edges[0]) and h[-1].high == pytest.approx(edges[-1])
    assert eda.histogram(r, 10).where("ticker = 'FLAT'").agg({"n": "sum"}).first()[0] == 120
    d = eda.density(r, 50).where("ticker = 'XOM'").orderBy("k").collect()
    x, bw = np.array(DATA["XOM"]), np.std(DATA["XOM"], ddof=1) * 120**-0.2
    assert d[7].y == pytest.approx(np.exp(-0.5 * ((d[7].x - x) / bw) ** 2).mean() / (bw * math.sqrt(2 * math.pi)))
    q = eda.qq(r).where("ticker = 'AAPL'").orderBy("i").collect()
    assert len(q) == 120 and q[0].ordered == min(DATA["AAPL"]) and q[0].theoretical == pytest.approx(-q[-1].theoretical) and q[0].slope > 0
    b = eda.box(r).where("ticker = 'XOM'").first()
    assert (b.q1, b.median, b.q3) == pytest.approx(tuple(np.percentile(DATA["XOM"], [25, 50, 75]))) and b.whisker_low >= b.q1 - 1.5 * (b.q3 - b.q1)


def test_counts(panel):
    r = eda.counts_and_ranges(panel(A=[1.0, 2.0], B=[1.0])).first()
    assert tuple(r) == (3, 2, dt.date(2024, 1, 2), dt.date(2024, 1, 3))
