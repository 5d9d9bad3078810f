"""Queries on price panels: cleaning, returns, metrics, rolling metrics, portfolios and exploration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, contracts, eda, metrics, simulate
from ..sources import bars as B
from ..sources import files
from . import sql as S

BENCHMARK = "3-MEDIUM"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, as engines add them up in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def nullable(prices: DataFrame) -> DataFrame:
    """Volumes as doubles, which every engine can hand over with nulls."""
    return prices.withColumn("volume", F.col("volume").cast("double"))


def query(name: str, oracle: str | None = None, digits: int = 6):
    def add(f):
        QUERIES[name] = lambda s, d: rounded(f(s, d), digits)
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def weekly(s: SparkSession, d: str) -> DataFrame:
    return cleaning.compute_returns(B.order_bars(s, d, "week"))


def monthly(s: SparkSession, d: str) -> DataFrame:
    return cleaning.compute_returns(B.nation_bars(s, d, "month"))


WEEK, MONTH = S.orders("week"), S.nations("month")
NULLABLE = "date, ticker, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume::DOUBLE AS volume"
BAR = "date, ticker, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume::BIGINT AS volume"


# ── sources and cleaning ─────────────────────────────────────────────────────
@query("bars_events", S.build(S.EVENTS, select=f"SELECT {BAR} FROM bars"))
def _(s, d):
    return B.event_bars(s, d)


@query("bars_orders", S.build(S.orders("day"), select=f"SELECT {BAR} FROM bars"))
def _(s, d):
    return B.order_bars(s, d, "day")


@query("bars_nation", S.build(S.nations("week"), select=f"SELECT {BAR} FROM bars"))
def _(s, d):
    return B.nation_bars(s, d, "week")


@query("wide_to_long", S.build(S.EVENTS, select=f"SELECT {BAR} FROM bars"))
def _(s, d):
    long = B.event_bars(s, d)
    names = sorted(r.ticker for r in long.select("ticker").distinct().collect())
    wide = long.groupBy("date").pivot("ticker", names).agg(*[F.first(c).alias(c.title()) for c in files.PRICE_COLUMNS[2:]])
    return files.wide_to_long(wide, names)


@query("contract_violations", S.build(WEEK, S.DIRTY, select="SELECT 'prices are positive' AS rule, count(*) FILTER (least(open, high, low, close) <= 0) AS n FROM dirty UNION ALL SELECT 'high is not below low', count(*) FILTER (high < low) FROM dirty"))
def _(s, d):
    broken = contracts.violations(B.dirty_bars(B.order_bars(s, d, "week")), "prices_clean")
    return s.createDataFrame(sorted(broken.items()), "rule string, n long")


@query("dedup_keep_first", "SELECT o_orderdate::DATE AS date, o_orderpriority AS ticker, min(o_orderkey) AS ordinal, round(arg_min(o_totalprice, o_orderkey), 6) AS close FROM orders GROUP BY 1, 2")
def _(s, d):
    raw = B.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderkey").alias("ordinal"), F.col("o_totalprice").alias("close"))
    return cleaning.dedup_keep_first(raw, "ordinal")


_GRID = "grid AS (SELECT days.date, t.ticker, open, high, low, close, volume FROM days CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars ON bars.date = days.date AND bars.ticker = t.ticker)"
_DAILY = (S.orders("day"), S.days(), _GRID)


@query("calendar_reindex", S.build(*_DAILY, select=f"SELECT {NULLABLE} FROM grid"))
def _(s, d):
    return nullable(cleaning.calendar_reindex(B.order_bars(s, d, "day")))


@query("bounded_ffill", S.build(*_DAILY, f"filled AS ({S.fill('grid', 3)})", select=f"SELECT {NULLABLE} FROM filled"))
def _(s, d):
    return nullable(cleaning.bounded_ffill(cleaning.calendar_reindex(B.order_bars(s, d, "day"))))


_FILLED = f"filled AS (SELECT * FROM ({S.fill('grid', 3)}) WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL)"


@query("fill_and_drop", S.build(*_DAILY, _FILLED, select=f"SELECT {NULLABLE} FROM filled"))
def _(s, d):
    return nullable(cleaning.fill_and_drop(cleaning.calendar_reindex(B.order_bars(s, d, "day"))))


@query("fill_counts", S.build(*_DAILY, select="SELECT ticker, count(*) FILTER (close IS NULL AND now IS NOT NULL) AS fills FROM (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS now FROM grid) GROUP BY ticker"))
def _(s, d):
    return cleaning.fill_counts(cleaning.calendar_reindex(B.order_bars(s, d, "day")))


@query("drop_invalid_prices", S.build(WEEK, S.DIRTY, select="SELECT date, ticker, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CASE WHEN volume >= 0 THEN volume::DOUBLE END AS volume FROM dirty WHERE least(open, high, low, close) > 0 AND high >= low"))
def _(s, d):
    return nullable(cleaning.drop_invalid_prices(B.dirty_bars(B.order_bars(s, d, "week"))))


_SHARE = "share AS (SELECT ticker, count(*) AS n_rows, count(*)::DOUBLE / (SELECT count(*) FROM days) AS coverage FROM bars GROUP BY ticker)"


@query("coverage", S.build(S.orders("day"), S.days(), _SHARE, select="SELECT ticker, n_rows, round(coverage, 6) AS coverage FROM share"))
def _(s, d):
    return cleaning.coverage(B.order_bars(s, d, "day"))


@query("enforce_coverage", S.build(S.nations("day"), S.days(), _SHARE, select=f"SELECT {BAR} FROM bars WHERE ticker IN (SELECT ticker FROM share WHERE coverage >= 0.25)"))
def _(s, d):
    return cleaning.enforce_coverage(B.nation_bars(s, d, "day"), 0.25)


@query("drop_tiny_tickers", S.build(S.nations("month"), select=f"SELECT {BAR} FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 70)"))
def _(s, d):
    return cleaning.drop_tiny(B.nation_bars(s, d, "month"), 70)


_CLEAN = (S.orders("day"), S.days(), _GRID, _FILLED, "good AS (SELECT * FROM filled WHERE least(open, high, low, close) > 0 AND high >= low)", S.days(name="left_days", source="good"), "final AS (SELECT * FROM good WHERE ticker IN (SELECT ticker FROM good GROUP BY ticker HAVING count(*)::DOUBLE / (SELECT count(*) FROM left_days) >= 0.8 AND count(*) >= 2))")


@query("clean_prices", S.build(*_CLEAN, select=f"SELECT {NULLABLE} FROM final"))
def _(s, d):
    return nullable(cleaning.clean(B.order_bars(s, d, "day")))


@query("clean_returns", S.build(*_CLEAN, select="SELECT date, ticker, round(close / prior - 1, 6) AS simple_return, round(ln(close / prior), 6) AS log_return FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prior FROM final) WHERE prior IS NOT NULL"))
def _(s, d):
    return cleaning.compute_returns(cleaning.clean(B.order_bars(s, d, "day")))


@query("compute_returns", S.build(S.EVENTS, S.RETURNS, select="SELECT date, ticker, round(r, 6) AS simple_return, round(lr, 6) AS log_return FROM rets"))
def _(s, d):
    return cleaning.compute_returns(B.event_bars(s, d))


@query("flag_outliers", S.build(S.EVENTS, S.RETURNS, select="SELECT date, ticker, round(r, 6) AS simple_return, round(lr, 6) AS log_return, 'abs_return_exceeds_threshold' AS reason FROM rets WHERE abs(r) > 0.25"))
def _(s, d):
    return cleaning.flag_outliers(cleaning.compute_returns(B.event_bars(s, d)))


@query("outlier_counts", S.build(WEEK, S.RETURNS, select="SELECT ticker, count(*) AS n_flagged FROM rets WHERE abs(r) > 0.25 GROUP BY ticker"))
def _(s, d):
    return cleaning.outlier_counts(weekly(s, d))


@query("zero_volume_days", S.build(*_DAILY, select=f"SELECT {NULLABLE} FROM grid WHERE coalesce(volume, 0) = 0"))
def _(s, d):
    return nullable(cleaning.zero_volume_days(cleaning.calendar_reindex(B.order_bars(s, d, "day"))))


@query("currency_mix", S.build(S.SECTORS, select="SELECT count(DISTINCT sector) AS n_currencies, string_agg(DISTINCT sector, ',' ORDER BY sector) AS currencies FROM sectors"))
def _(s, d):
    metadata = B.nation_sectors(s, d).withColumnRenamed("sector", "currency")
    return cleaning.currency_mix(metadata, metadata)


@query("last_prices", S.build(WEEK, select="SELECT ticker, round(arg_max(close, date), 6) AS s0, max(date) AS last_date FROM bars GROUP BY ticker"))
def _(s, d):
    return simulate.last_prices(B.order_bars(s, d, "week"))


@query("counts_and_ranges", S.build(WEEK, select="SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date FROM bars"))
def _(s, d):
    return eda.counts_and_ranges(B.order_bars(s, d, "week"))


# ── metrics ──────────────────────────────────────────────────────────────────
def _long(names: list[str], category: str, source: str, digits: int = 6) -> str:
    return f"SELECT ticker, metric_name, round(value, {digits}) AS value, '{category}' AS category FROM (UNPIVOT (SELECT ticker, {', '.join(names)} FROM {source}) ON {', '.join(names)} INTO NAME metric_name VALUE value)"


_RM = "rm AS (SELECT ticker, product(1 + r) - 1 AS total_return, pow(product(1 + r), 252.0 / count(r)) - 1 AS cagr, avg(r) AS mean_daily, avg(r) * 21 AS mean_monthly, avg(r) * 252 AS mean_annual, max(r) AS best_day, min(r) AS worst_day, avg((r > 0)::INT) AS pct_positive_days FROM rets GROUP BY ticker)"
_Q = "q AS (SELECT ticker, quantile_cont(r, 1 - 0.95::DOUBLE) AS q95, quantile_cont(r, 1 - 0.99::DOUBLE) AS q99 FROM rets GROUP BY ticker)"
_RISK = """risk AS (SELECT ticker, stddev_samp(r) AS daily_vol, stddev_samp(r) * sqrt(252) AS annual_vol, CASE WHEN count(*) FILTER (r < 0) > 1 THEN stddev_samp(r) FILTER (r < 0) * sqrt(252) END AS downside_deviation,
    abs(any_value(q95)) AS var_95, abs(any_value(q99)) AS var_99, abs(avg(r) FILTER (r <= q95)) AS cvar_95, least((SELECT min(dd) FROM dd WHERE dd.ticker = rets.ticker), 0) AS max_drawdown FROM rets JOIN q USING (ticker) GROUP BY ticker)"""
_ADJ = "adj AS (SELECT ticker, (mean_annual - 0.04) / nullif(annual_vol, 0) AS sharpe, (mean_annual - 0.04) / nullif(downside_deviation, 0) AS sortino, cagr / nullif(abs(max_drawdown), 0) AS calmar FROM rm JOIN risk USING (ticker))"
_ALL = (S.RETURNS, S.GROWTH, _RM, _Q, _RISK, _ADJ)


@query("return_metrics", S.build(S.EVENTS, S.RETURNS, _RM, select=_long(metrics.RETURN_METRICS, "return", "rm")))
def _(s, d):
    return metrics.return_metrics(cleaning.compute_returns(B.event_bars(s, d)))


@query("risk_metrics", S.build(WEEK, *_ALL, select=_long(metrics.risk_names(), "risk", "risk")))
def _(s, d):
    return metrics.risk_metrics(weekly(s, d))


@query("risk_adjusted", S.build(WEEK, *_ALL, select=_long(["sharpe", "sortino", "calmar"], "risk_adjusted", "adj")))
def _(s, d):
    return metrics.risk_adjusted(weekly(s, d))


@query("metrics_per_ticker", S.build(MONTH, *_ALL, select=" UNION ALL ".join([_long(metrics.RETURN_METRICS, "return", "rm", 3), _long(metrics.risk_names(), "risk", "risk", 3), _long(["sharpe", "sortino", "calmar"], "risk_adjusted", "adj", 3)])), 3)
def _(s, d):
    return metrics.metrics_per_ticker(monthly(s, d))


@query("metrics_sheet", S.build(WEEK, *_ALL, select="SELECT ticker, " + ", ".join(f"round({n}, 6) AS {n}" for n in ["sharpe", "sortino", "calmar"]) + " FROM adj"))
def _(s, d):
    return metrics.risk_adjusted(weekly(s, d)).groupBy("ticker").pivot("metric_name", ["sharpe", "sortino", "calmar"]).agg(F.first("value"))


@query("drawdown_series", S.build(WEEK, select="SELECT date, ticker, round(close, 6) AS close, round(max(close) OVER w, 6) AS running_peak, round(close / max(close) OVER w - 1, 6) AS drawdown_pct FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"))
def _(s, d):
    return metrics.drawdown_series(B.order_bars(s, d, "week"))


@query("drawdown_summary", S.build(WEEK, "x AS (SELECT ticker, close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS d FROM bars)", select="SELECT ticker, round(min(d), 6) AS max_drawdown, round(avg(d), 6) AS mean_drawdown FROM x GROUP BY ticker"))
def _(s, d):
    return metrics.drawdown_series(B.order_bars(s, d, "week")).groupBy("ticker").agg(F.min("drawdown_pct").alias("max_drawdown"), F.avg("drawdown_pct").alias("mean_drawdown"))


_DURATION = """isl AS (SELECT *, sum((dd >= 0)::INT) OVER (PARTITION BY ticker ORDER BY date) AS island, max(date) OVER (PARTITION BY ticker) AS last_date FROM dd),
    runs AS (SELECT ticker, island, count(*) FILTER (dd < 0) AS under, bool_or(date = last_date AND dd < 0) AS still FROM isl GROUP BY ALL)"""


@query("drawdown_duration", S.build(MONTH, S.RETURNS, S.GROWTH, _DURATION, select="SELECT ticker, round(least((SELECT min(dd) FROM dd WHERE dd.ticker = runs.ticker), 0), 6) AS max_drawdown, max(under - still::INT)::BIGINT AS max_duration, NOT bool_or(still) AS recovered FROM runs GROUP BY ticker"))
def _(s, d):
    return metrics.drawdown_duration(monthly(s, d))


@query("beta_vs_benchmark", S.build(WEEK, S.RETURNS, f"b AS (SELECT date, r AS b FROM rets WHERE ticker = '{BENCHMARK}')", select=f"SELECT ticker, CASE WHEN ticker <> '{BENCHMARK}' THEN round(covar_samp(r, b) / nullif(var_samp(b), 0), 6) END AS beta FROM rets JOIN b USING (date) GROUP BY ticker"))
def _(s, d):
    return metrics.beta_per_ticker(weekly(s, d), BENCHMARK)


# metrics with planted faults, as sound ones break no rule
_PLANTED = "planted AS (SELECT ticker, var_95, CASE WHEN ticker IN ('1-URGENT', '5-LOW') THEN var_95 / 2 ELSE var_99 END AS var_99, CASE WHEN ticker = '2-HIGH' THEN var_95 / 2 ELSE cvar_95 END AS cvar_95, CASE WHEN ticker = '5-LOW' THEN 0.25 ELSE max_drawdown END AS max_drawdown FROM risk)"


@query("metric_invariants", S.build(WEEK, *_ALL, _PLANTED, select="SELECT ticker, 'cvar_95<var_95' AS broken FROM planted WHERE cvar_95 < var_95 UNION ALL SELECT ticker, 'var_99<var_95' FROM planted WHERE var_99 < var_95 UNION ALL SELECT ticker, 'max_drawdown>0' FROM planted WHERE max_drawdown > 0"))
def _(s, d):
    t, half = F.col("ticker"), F.col("var_95") / 2
    planted = metrics.wide(weekly(s, d)).withColumns({"var_99": F.when(t.isin("1-URGENT", "5-LOW"), half).otherwise(F.col("var_99")), "cvar_95": F.when(t == "2-HIGH", half).otherwise(F.col("cvar_95")), "max_drawdown": F.when(t == "5-LOW", 0.25).otherwise(F.col("max_drawdown"))})
    return metrics.broken_rules(planted).select("ticker", F.explode("broken").alias("broken"))


_PORT = """names AS (SELECT DISTINCT ticker FROM rets WHERE ticker <> '3-MEDIUM'),
    day AS (SELECT date, sum(r) / (SELECT count(*) FROM names) AS p FROM rets WHERE ticker IN (SELECT ticker FROM names) GROUP BY date HAVING count(r) = (SELECT count(*) FROM names)),
    pq AS (SELECT quantile_cont(p, 1 - 0.95::DOUBLE) AS q95, quantile_cont(p, 1 - 0.99::DOUBLE) AS q99 FROM day),
    pg AS (SELECT date, product(1 + p) OVER (ORDER BY date) AS g FROM day),
    pd AS (SELECT g / greatest(1.0, max(g) OVER (ORDER BY date)) - 1 AS dd FROM pg),
    one AS (SELECT product(1 + p) - 1 AS total_return, count(*) AS n, avg(p) * 252 AS mean_annual, stddev_samp(p) AS sd, stddev_samp(p) FILTER (p < 0) AS down, any_value(q95) AS q95, any_value(q99) AS q99, avg(p) FILTER (p <= q95) AS t95, least((SELECT min(dd) FROM pd), 0) AS mdd FROM day, pq)"""


@query(
    "portfolio_metrics",
    S.build(
        WEEK, S.RETURNS, _PORT,
        select="""SELECT round(ln(1 + total_return), 6) AS log_total_return, round(252.0 / n * ln(1 + total_return), 6) AS log_cagr, round(sd * sqrt(252), 6) AS annual_vol, round((mean_annual - 0.04) / (sd * sqrt(252)), 6) AS sharpe,
        round((mean_annual - 0.04) / (down * sqrt(252)), 6) AS sortino, round(ln((pow(1 + total_return, 252.0 / n) - 1) / abs(mdd)), 6) AS log_calmar, round(mdd, 6) AS max_drawdown, round(abs(q95), 6) AS var_95, round(abs(q99), 6) AS var_99, round(abs(t95), 6) AS cvar_95,
        (SELECT round(covar_samp(p, r) / var_samp(r), 6) FROM day JOIN rets USING (date) WHERE ticker = '3-MEDIUM') AS beta_vs_benchmark,
        round((SELECT avg(s) FROM (SELECT stddev_samp(r) AS s FROM rets WHERE ticker <> '3-MEDIUM' GROUP BY ticker)) / sd, 6) AS diversification_ratio, 'equal' AS weights_strategy,
        '{' || (SELECT string_agg('"' || ticker || '": 0.25', ', ' ORDER BY ticker) FROM names) || '}' AS weights_used FROM one""",
    ),
)
def _(s, d):
    one = metrics.portfolio_metrics(weekly(s, d), benchmark=BENCHMARK)
    # these grow beyond any fixed number of digits here, so their logarithms are compared
    logs = {"total_return": F.ln(1 + F.col("total_return")), "cagr": F.ln(1 + F.col("cagr")), "calmar": F.ln("calmar")}
    return one.select(*[c for c in one.columns if c not in logs], *[x.alias(f"log_{c}") for c, x in logs.items()])


@query("portfolio_returns", S.build(MONTH, S.RETURNS, select="SELECT date, round(sum(r) / 25, 6) AS simple_return FROM rets GROUP BY date HAVING count(r) = 25"))
def _(s, d):
    r = monthly(s, d)
    names = sorted(x.ticker for x in r.select("ticker").distinct().collect())
    return metrics.portfolio_returns(r, metrics.resolve_weights(names, None))


# ── rolling ──────────────────────────────────────────────────────────────────
def _rolling(value: str, k: int, source: str = "rets") -> str:
    return f"SELECT date, ticker, round(v, 6) AS value FROM (SELECT date, ticker, CASE WHEN count(*) OVER w = {k} THEN {value} END AS v FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) WHERE v IS NOT NULL"


_JOINED = "j AS (SELECT rets.date, ticker, r, b FROM rets JOIN (SELECT date, r AS b FROM rets WHERE ticker = '3-MEDIUM') USING (date))"


@query("rolling_sharpe", S.build(WEEK, S.RETURNS, select=_rolling("(avg(r) OVER w - 0.04 / 252) / nullif(stddev_samp(r) OVER w, 0) * sqrt(252)", 90)))
def _(s, d):
    return metrics.rolling_sharpe(weekly(s, d))


@query("rolling_volatility_90", S.build(WEEK, S.RETURNS, select=_rolling("stddev_samp(r) OVER w * sqrt(252)", 90)))
def _(s, d):
    return metrics.rolling_volatility(weekly(s, d))


@query("rolling_beta", S.build(WEEK, S.RETURNS, _JOINED, select=_rolling("covar_samp(r, b) OVER w / nullif(var_samp(b) OVER w, 0)", 60, "j")))
def _(s, d):
    return metrics.rolling_beta(weekly(s, d), BENCHMARK)


@query("rolling_corr", S.build(WEEK, S.RETURNS, _JOINED, select=_rolling(S.corr("r", "b", " OVER w"), 60, "j")))
def _(s, d):
    return metrics.rolling_corr(weekly(s, d), BENCHMARK)


@query(
    "rolling_metrics",
    S.build(WEEK, S.RETURNS, _JOINED, select=" UNION ALL ".join(f"SELECT date, ticker, '{n}' AS metric_name, value FROM ({q})" for n, q in (
        ("rolling_sharpe_90", _rolling("(avg(r) OVER w - 0.04 / 252) / nullif(stddev_samp(r) OVER w, 0) * sqrt(252)", 90)), ("rolling_volatility_90", _rolling("stddev_samp(r) OVER w * sqrt(252)", 90)),
        ("rolling_beta_60", _rolling("covar_samp(r, b) OVER w / nullif(var_samp(b) OVER w, 0)", 60, "j")), ("rolling_corr_60", _rolling(S.corr("r", "b", " OVER w"), 60, "j"))))),
)
def _(s, d):
    return metrics.rolling_metrics(weekly(s, d), BENCHMARK)


# ── exploration ──────────────────────────────────────────────────────────────
@query(
    "distribution_stats",
    S.build(WEEK, S.RETURNS, "m AS (SELECT ticker, count(r) AS n, skewness(r) AS g1, kurtosis_pop(r) AS g2, skewness(r) * (count(r) - 2) / sqrt(count(r) * (count(r) - 1.0)) AS b1 FROM rets GROUP BY ticker)",
        select="SELECT ticker, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(skewness(r), 6) AS skew, round(kurtosis(r), 6) AS kurtosis, round(min(r), 6) AS min, round(max(r), 6) AS max, round(exp(-(any_value(m.n) / 6.0 * (any_value(b1) ^ 2 + any_value(g2) ^ 2 / 4)) / 2), 6) AS jarque_bera_p, stddev_samp(r) = 0 AS flat_lined FROM rets JOIN m USING (ticker) GROUP BY ticker"),
)
def _(s, d):
    return eda.distribution_stats(weekly(s, d))


@query("moving_average", S.build(WEEK, select="SELECT date, ticker, round(close, 6) AS close, " + ", ".join(f"CASE WHEN count(close) OVER w{k} = {k} THEN round(avg(close) OVER w{k}, 6) END AS ma_{k}" for k in (20, 50)) + " FROM bars WINDOW " + ", ".join(f"w{k} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (20, 50))))
def _(s, d):
    return eda.moving_averages(B.order_bars(s, d, "week"))


@query("volume_trend", S.build(WEEK, select="SELECT date, ticker, volume::DOUBLE AS volume FROM bars"))
def _(s, d):
    return eda.volume_trend(B.order_bars(s, d, "week"))


@query("rolling_volatility", S.build(WEEK, S.RETURNS, f"v AS ({_rolling('stddev_samp(r) OVER w * sqrt(252)', 30)})", select="SELECT date, ticker, value AS volatility FROM v"))
def _(s, d):
    return eda.rolling_volatility(weekly(s, d))


@query("monthly_volatility", S.build(WEEK, S.RETURNS, select="SELECT ticker, strftime(date, '%Y-%m') AS month, round(stddev_samp(r) * sqrt(252), 6) AS volatility FROM rets WHERE ticker IN (SELECT ticker FROM rets GROUP BY ticker HAVING count(*) >= 30) GROUP BY 1, 2"))
def _(s, d):
    return eda.monthly_volatility(weekly(s, d))


_PAIRS = f"pairs AS (SELECT x.ticker AS a, y.ticker AS b, CASE WHEN count(*) > 1 THEN {S.corr('x.r', 'y.r')} END AS corr FROM rets x JOIN rets y ON x.date = y.date AND x.ticker < y.ticker GROUP BY 1, 2)"


@query("correlation_matrix", S.build(MONTH, S.RETURNS, _PAIRS, select="SELECT a AS ticker_a, b AS ticker_b, round(corr, 6) AS corr FROM pairs UNION ALL SELECT b, a, round(corr, 6) FROM pairs UNION ALL SELECT ticker, ticker, CASE WHEN stddev_samp(r) > 0 THEN 1.0 END::DOUBLE FROM rets GROUP BY ticker"))
def _(s, d):
    return eda.correlation_matrix(monthly(s, d))


@query("correlation_matrix_log", S.build(WEEK, S.RETURNS, _PAIRS.replace("x.r", "x.lr").replace("y.r", "y.lr").replace("x.lrets", "x.rets"), select="SELECT a AS ticker_a, b AS ticker_b, round(corr, 6) AS corr FROM pairs UNION ALL SELECT b, a, round(corr, 6) FROM pairs UNION ALL SELECT ticker, ticker, CASE WHEN stddev_samp(lr) > 0 THEN 1.0 END::DOUBLE FROM rets GROUP BY ticker"))
def _(s, d):
    return eda.correlation_matrix(weekly(s, d), "log_return", unique=True)


@query("top_correlated_pairs", S.build(MONTH, S.RETURNS, _PAIRS, select="SELECT a, b, round(corr, 6) AS corr FROM pairs WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, a, b LIMIT 3"))
def _(s, d):
    return eda.top_correlated_pairs(monthly(s, d))


@query("scatter_top_pairs", S.build(MONTH, S.RETURNS, _PAIRS, "top AS (SELECT a, b FROM pairs WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, a, b LIMIT 3)", select="SELECT a, b, x.date, round(x.r, 6) AS x, round(y.r, 6) AS y FROM top JOIN rets x ON x.ticker = a JOIN rets y ON y.ticker = b AND y.date = x.date"))
def _(s, d):
    return eda.scatter(monthly(s, d))


_SEC = "sp AS (SELECT corr, s1.sector AS sa, s2.sector AS sb FROM pairs JOIN sectors s1 ON s1.ticker = a JOIN sectors s2 ON s2.ticker = b)"


@query("sector_corr_matrix", S.build(MONTH, S.RETURNS, _PAIRS, S.SECTORS, _SEC, select="SELECT sa AS sector_a, sb AS sector_b, round(avg(corr), 6) AS corr FROM (SELECT sa, sb, corr FROM sp UNION ALL SELECT sb, sa, corr FROM sp) GROUP BY 1, 2"))
def _(s, d):
    return eda.sector_corr_matrix(monthly(s, d), B.nation_sectors(s, d))


@query("sector_avg_corr", S.build(MONTH, S.RETURNS, _PAIRS, S.SECTORS, _SEC, select="SELECT sa AS sector, round(avg(corr), 4) AS avg_corr FROM sp WHERE sa = sb GROUP BY sa"))
def _(s, d):
    return eda.sector_avg_corr(monthly(s, d), B.nation_sectors(s, d))


@query("top_n_moves", S.build(WEEK, S.RETURNS, select="SELECT ticker, date, round(r, 6) AS simple_return, row_number() OVER w AS place FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY abs(r) DESC, date) QUALIFY row_number() OVER w <= 10"))
def _(s, d):
    return eda.top_moves(weekly(s, d))


@query("outlier_match", S.build(WEEK, S.RETURNS, "top AS (SELECT * FROM rets QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY abs(r) DESC, date) <= 10)", "c AS (SELECT ticker, count(*) AS n FROM rets WHERE abs(r) > 0.25 GROUP BY ticker)", select="SELECT ticker, count(*) AS eda_count, coalesce(any_value(n), 0) AS cleaning_count, count(*) FILTER (abs(r) > 0.25) AS overlap FROM top LEFT JOIN c USING (ticker) GROUP BY ticker"))
def _(s, d):
    return eda.outlier_match(weekly(s, d), cleaning.outlier_counts(weekly(s, d)))


@query("flat_price_runs", S.build(*_DAILY, _FILLED, "f AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY date) = 0, false) AS flat FROM filled)", "g AS (SELECT *, sum((NOT flat)::INT) OVER (PARTITION BY ticker ORDER BY date) AS run FROM f)", select="SELECT date, ticker, close, run_length FROM (SELECT date, ticker, round(close, 6) AS close, flat, sum(flat::INT) OVER (PARTITION BY ticker, run)::BIGINT AS run_length FROM g) WHERE flat"))
def _(s, d):
    return eda.flat_runs(cleaning.fill_and_drop(cleaning.calendar_reindex(B.order_bars(s, d, "day"))))


@query("return_histogram", S.build(WEEK, S.RETURNS, "e AS (SELECT ticker, min(r) AS lo, max(r) AS hi, count(r) AS m FROM rets GROUP BY ticker)", "h AS (SELECT ticker, least(floor((r - lo) / (hi - lo) * 50), 49)::BIGINT AS bin, count(*) AS n FROM rets JOIN e USING (ticker) GROUP BY 1, 2)", select="SELECT ticker, bin, round(lo + bin * ((hi - lo) / 50), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0) AS n, round(coalesce(n, 0) / (m * ((hi - lo) / 50)), 6) AS density FROM (SELECT *, unnest(range(50)) AS bin FROM e) LEFT JOIN h USING (ticker, bin)"))
def _(s, d):
    return eda.histogram(weekly(s, d))


@query("return_density", S.build(WEEK, S.RETURNS, "e AS (SELECT ticker, min(r) AS lo, max(r) AS hi, stddev_samp(r) * pow(count(r), -0.2) AS h FROM rets GROUP BY ticker)", "x AS (SELECT ticker, h, k, lo + (hi - lo) * k / 299 AS x FROM (SELECT *, unnest(range(300)) AS k FROM e))", select="SELECT ticker, k, round(x, 6) AS x, round(avg(exp(-0.5 * ((x - r) / h) ^ 2)) / (h * sqrt(2 * pi())), 6) AS y FROM x JOIN rets USING (ticker) GROUP BY ticker, k, x, h"))
def _(s, d):
    return eda.density(weekly(s, d))


_QQ = f"""o AS (SELECT ticker, r AS ordered, row_number() OVER (PARTITION BY ticker ORDER BY r) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM rets),
    p AS (SELECT *, CASE WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o WHERE n >= 30),
    points AS (SELECT *, {S.normal_quantile('p')} AS theoretical FROM p), line AS (SELECT ticker, regr_slope(ordered, theoretical) AS slope, regr_intercept(ordered, theoretical) AS intercept FROM points GROUP BY ticker)"""


@query("return_qq", S.build(WEEK, S.RETURNS, _QQ, select="SELECT ticker, i, round(theoretical, 6) AS theoretical, round(ordered, 6) AS ordered, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM points JOIN line USING (ticker)"))
def _(s, d):
    return eda.qq(weekly(s, d))


@query("return_box", S.build(WEEK, S.RETURNS, "q AS (SELECT ticker, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS q3 FROM rets GROUP BY ticker)", "i AS (SELECT *, r >= q1 - 1.5 * (q3 - q1) AND r <= q3 + 1.5 * (q3 - q1) AS inside FROM rets JOIN q USING (ticker))", select="SELECT ticker, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(r) FILTER (inside), 6) AS whisker_low, round(max(r) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM i GROUP BY ALL"))
def _(s, d):
    return eda.box(weekly(s, d))

