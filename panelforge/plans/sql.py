"""Pieces of DuckDB's SQL that the oracle queries share."""

from __future__ import annotations

from ..functions.calendar import nyse_holidays
from ..functions.stats import FAR, MIDDLE, TAIL

EVENTS = "bars AS (SELECT ts::DATE AS date, event_type AS ticker, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"


def orders(grain: str) -> str:
    return f"bars AS (SELECT date_trunc('{grain}', o_orderdate)::DATE AS date, o_orderpriority AS ticker, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2)"


def nations(grain: str) -> str:
    return f"bars AS (SELECT date_trunc('{grain}', o_orderdate)::DATE AS date, n_name AS ticker, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


RETURNS = "rets AS (SELECT date, ticker, close / nullif(lag(close) OVER w, 0) - 1 AS r, CASE WHEN close / nullif(lag(close) OVER w, 0) > 0 THEN ln(close / nullif(lag(close) OVER w, 0)) END AS lr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date) QUALIFY lag(close) OVER w IS NOT NULL)"
SECTORS = "sectors AS (SELECT n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)"
DIRTY = """dirty AS (SELECT date, ticker, open, CASE WHEN date_diff('day', DATE '1990-01-01', date) % 11 = 3 THEN low - 1 ELSE high END AS high, low,
    CASE WHEN date_diff('day', DATE '1990-01-01', date) % 13 = 5 THEN -close ELSE close END AS close, CASE WHEN date_diff('day', DATE '1990-01-01', date) % 17 = 7 THEN -1 ELSE volume END AS volume FROM bars)"""
GROWTH = """grown AS (SELECT ticker, date, r, product(1 + r) OVER (PARTITION BY ticker ORDER BY date) AS growth FROM rets),
    dd AS (SELECT ticker, date, growth / greatest(1.0, max(growth) OVER (PARTITION BY ticker ORDER BY date)) - 1 AS dd FROM grown)"""


def days(first: int = 1993, last: int = 2026, name: str = "days", source: str = "bars") -> str:
    """Trading days of the span of a table of bars."""
    closed = ", ".join(f"DATE '{d}'" for d in nyse_holidays(first, last))
    return f"{name} AS (SELECT d::DATE AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM {source}) WHERE isodow(d) < 6 AND d::DATE NOT IN ({closed}))"


def fill(source: str, k: int) -> str:
    """Each price filled from at most k rows before."""
    w = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
    cols = ", ".join(f"last_value({c} IGNORE NULLS) OVER {w} AS {c}" for c in ("open", "high", "low", "close"))
    return f"SELECT date, ticker, {cols}, volume FROM {source}"


def build(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def normal_quantile(p: str) -> str:
    """The standard normal quantile by algorithm AS 241."""

    def polynomial(coefficients: tuple[float, ...], x: str) -> str:
        out = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    share = lambda pair, x: f"{polynomial(pair[0], x)} / {polynomial(pair[1], x)}"
    q, depth = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * ({share(MIDDLE, f'(0.180625::DOUBLE - {q} * {q})')}) WHEN {depth} <= 5 THEN sign({q}) * ({share(TAIL, f'({depth} - 1.6::DOUBLE)')}) ELSE sign({q}) * ({share(FAR, f'({depth} - 5)')}) END"


def corr(x: str, y: str, over: str = "") -> str:
    return f"covar_samp({x}, {y}){over} / nullif(stddev_samp({x}){over} * stddev_samp({y}){over}, 0)"
