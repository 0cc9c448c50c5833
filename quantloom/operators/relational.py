"""Plain relational steps on a panel: breadth, top-k, tails, thinning, clipping, sets, semi and anti joins, next values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def minimum_breadth(panel: DataFrame, least: int = 20, value: str = "close") -> DataFrame:
    """The rows of bars at which at least so many symbols have a value."""
    n = panel.filter(F.col(value).isNotNull()).groupBy("bar_idx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return panel.join(n.select("bar_idx"), "bar_idx", "left_semi")


def top_k(panel: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The k rows of greatest value at each bar, ties to the smaller symbol."""
    w = Window.partitionBy("bar_idx").orderBy(F.col(by).desc(), "symbol")
    return panel.filter(F.col(by).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tail(panel: DataFrame, k: int = 10) -> DataFrame:
    """The last k rows of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("bar_idx").desc())
    return panel.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def best_of(panel: DataFrame, by: str) -> DataFrame:
    """The symbol of greatest value at each bar, in one aggregation."""
    return panel.filter(F.col(by).isNotNull()).groupBy("bar_idx").agg(F.max_by("symbol", F.struct(F.col(by), F.col("symbol"))).alias("symbol"), F.max(by).alias(by))


def thin(panel: DataFrame, every: int = 7) -> DataFrame:
    """Every so manieth bar from the first."""
    first = panel.agg(F.min("bar_idx").alias("__lo"))
    return panel.join(F.broadcast(first)).filter((F.col("bar_idx") - F.col("__lo")) % every == 0).drop("__lo")


def winsorised(panel: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """value clipped to quantiles of its bar."""
    w = Window.partitionBy("bar_idx")
    lo, hi = F.percentile(value, low).over(w), F.percentile(value, high).over(w)
    return panel.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), lo), hi)))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row in order of those with equal keys."""
    rest = F.struct(order, *[c for c in rows.columns if c not in (*keys, order)])
    return rows.groupBy(*keys).agg(F.max(rest).alias("__r")).select(*keys, "__r.*")


def following(panel: DataFrame, value: str) -> DataFrame:
    """panel with next_bar and next_value: the nearest later bar of the symbol that has a value."""
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(1, Window.unboundedFollowing)
    x = F.first(F.when(F.col(value).isNotNull(), F.struct("bar_idx", value)), ignorenulls=True).over(w)
    return panel.withColumn("__x", x).withColumn("next_bar", F.col("__x.bar_idx")).withColumn("next_value", F.col(f"__x.{value}")).drop("__x")


def rank_turnover(panel: DataFrame, value: str) -> DataFrame:
    """symbol, autocorr: the lag-1 correlation of a value, and turnover, its mean absolute step."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    d = panel.withColumn("__x", F.lag(value).over(w)).filter(F.col("__x").isNotNull() & F.col(value).isNotNull())
    return d.groupBy("symbol").agg(F.corr(value, "__x").alias("autocorr"), F.avg(F.abs(F.col(value) - F.col("__x"))).alias("turnover"))


def _busy(panel: DataFrame) -> DataFrame:
    return panel.groupBy("symbol").agg(F.avg("quote_volume").alias("v")).filter("v is not null").select("symbol", "v")


def _half(panel: DataFrame, upper: bool) -> DataFrame:
    b = _busy(panel)
    mid = b.agg(F.percentile("v", 0.5).alias("m"))
    return b.join(F.broadcast(mid)).filter(F.col("v") >= F.col("m") if upper else F.col("v") < F.col("m")).select("symbol")


def _named(panel: DataFrame) -> DataFrame:
    return panel.select("symbol").distinct().filter("symbol like '%3'")


def _r6(c: str):
    return F.round(c, 6).alias(c)


_VOL = "v AS (SELECT symbol, avg(quote_volume) AS v FROM panel GROUP BY symbol HAVING avg(quote_volume) IS NOT NULL), up AS (SELECT symbol FROM v WHERE v >= (SELECT quantile_cont(v, 0.5) FROM v)), three AS (SELECT DISTINCT symbol FROM panel WHERE symbol LIKE '%3')"

#: Query: a function of the panel, and SQL after a common table expression `panel`.
STEPS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "breadth_filter": (lambda p: minimum_breadth(p).select("symbol", "bar_idx", "close"), "SELECT symbol, bar_idx, close FROM panel WHERE bar_idx IN (SELECT bar_idx FROM panel GROUP BY bar_idx HAVING count(close) >= 20)"),
    "top_by_bar": (lambda p: top_k(p, "quote_volume").select("bar_idx", "symbol", "rank"), ", k AS (SELECT bar_idx, symbol, CAST(row_number() OVER (PARTITION BY bar_idx ORDER BY quote_volume DESC, symbol) AS INTEGER) AS rank FROM panel WHERE quote_volume IS NOT NULL) SELECT * FROM k WHERE rank <= 3"),
    "tail_by_symbol": (lambda p: tail(p).select("symbol", "bar_idx", "close"), "SELECT symbol, bar_idx, close FROM (SELECT *, max(bar_idx) OVER (PARTITION BY symbol) AS m FROM panel) x WHERE bar_idx > m - 10"),
    "best_by_bar": (lambda p: best_of(p, "quote_volume"), "SELECT bar_idx, symbol, quote_volume FROM (SELECT *, row_number() OVER (PARTITION BY bar_idx ORDER BY quote_volume DESC, symbol DESC) AS k FROM panel WHERE quote_volume IS NOT NULL) x WHERE k = 1"),
    "thinned_bars": (lambda p: thin(p).select("symbol", "bar_idx", "close"), "SELECT symbol, bar_idx, close FROM panel WHERE (bar_idx - (SELECT min(bar_idx) FROM panel)) % 7 = 0"),
    "winsorised": (lambda p: winsorised(p, "close").select("symbol", "bar_idx", _r6("close")), "SELECT p.symbol, p.bar_idx, round(CASE WHEN close < lo THEN lo WHEN close > hi THEN hi ELSE close END, 6) AS close FROM panel p JOIN (SELECT bar_idx, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM panel GROUP BY bar_idx) q USING (bar_idx)"),
    "keep_last_by_month": (lambda p: keep_last(p.withColumn("month", F.floor(F.col("bar_idx") / 4)).select("symbol", "month", "bar_idx", "close"), ["symbol", "month"], "bar_idx"), "SELECT symbol, CAST(floor(bar_idx / 4) AS BIGINT) AS month, max(bar_idx) AS bar_idx, arg_max(struct_pack(c := close), bar_idx).c AS close FROM panel GROUP BY ALL"),
    "next_value": (lambda p: following(p, "close").select("symbol", "bar_idx", "next_bar", "next_value"), "SELECT p.symbol, p.bar_idx, min(q.bar_idx) AS next_bar, arg_min(q.close, q.bar_idx) AS next_value FROM panel p LEFT JOIN panel q ON q.symbol = p.symbol AND q.bar_idx > p.bar_idx AND q.bar_idx <= p.bar_idx + 60 AND q.close IS NOT NULL GROUP BY p.symbol, p.bar_idx"),
    "signal_persistence": (lambda p: rank_turnover(p.withColumn("x", F.log("close")), "x").select("symbol", _r6("autocorr"), _r6("turnover")), ", x AS (SELECT symbol, ln(close) AS a, lag(ln(close)) OVER (PARTITION BY symbol ORDER BY bar_idx) AS b FROM panel) SELECT symbol, round(corr(a, b), 6) AS autocorr, round(avg(abs(a - b)), 6) AS turnover FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY symbol"),
    "symbols_union": (lambda p: _half(p, True).union(_named(p)).distinct(), f", {_VOL} SELECT symbol FROM up UNION SELECT symbol FROM three"),
    "symbols_intersect": (lambda p: _half(p, True).intersect(_named(p)), f", {_VOL} SELECT symbol FROM up INTERSECT SELECT symbol FROM three"),
    "symbols_except": (lambda p: _half(p, True).exceptAll(_named(p)), f", {_VOL} SELECT symbol FROM up EXCEPT SELECT symbol FROM three"),
    "symbols_semi": (lambda p: p.join(_half(p, True), "symbol", "left_semi").groupBy("symbol").agg(F.count("close").alias("n")), f", {_VOL} SELECT symbol, count(close) AS n FROM panel WHERE symbol IN (SELECT symbol FROM up) GROUP BY symbol"),
    "symbols_anti": (lambda p: p.join(_half(p, True), "symbol", "left_anti").groupBy("symbol").agg(F.count("close").alias("n")), f", {_VOL} SELECT symbol, count(close) AS n FROM panel WHERE symbol NOT IN (SELECT symbol FROM up) GROUP BY symbol"),
}
