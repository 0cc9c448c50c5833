"""Maps the star-schema tables to bars and back-of-book columns on a dense weekly grid, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF_SYMBOL = "Brand#11"
_KEYS = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
#: Weekly aggregates of line items; {first} and {last} are the dialect's first and last price in key order.
_AGGS = {
    "open": "{first}",
    "high": "max(price)",
    "low": "min(price)",
    "close": "{last}",
    "volume": "sum(l_quantity)",
    "quote_volume": "sum(l_extendedprice)",
    "taker_buy_base": "sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)",
    "n_trades": "CAST(count(1) AS DOUBLE)",
    "funding": "(avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) - avg(CASE WHEN l_returnflag = 'A' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) * 0.0001",
    "oi_step": "sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)",
    "premium": "(avg(l_discount) - 0.05) * 0.001",
    "basis": "(avg(l_tax) - 0.04) * 0.01",
    "imb_1pct": "(sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END)) / sum(l_quantity)",
    "imb_5pct": "(sum(CASE WHEN l_suppkey % 2 = 1 THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE 0 END)) / sum(l_quantity)",
    "micro_tilt": "avg(l_discount) - 0.05",
    "book_slope": "avg(l_tax)",
    "depth_withdraw": "avg(CASE WHEN l_discount > 0.05 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END)",
    "imb_vol": "stddev_samp(l_discount)",
    "depth_total": "sum(l_extendedprice)",
    "n_snap": "CAST(count(1) AS DOUBLE)",
    "ofi_usd": "sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END)",
    "notional": "sum(l_extendedprice)",
    "buy_frac": "sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice)",
    "aggr_imb": "sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) / sum(l_quantity)",
    "kyle_lambda": "CASE WHEN count(1) > 2 THEN regr_slope(price, l_quantity) END",
    "sign_ac1": "CASE WHEN count(1) > 2 THEN covar_samp(l_discount, l_tax) * 1000 END",
    "roll_bps": "stddev_samp(price) / avg(price)",
    "big_imb": "sum(CASE WHEN l_quantity >= 40 THEN CASE WHEN l_returnflag = 'R' THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE CAST(0 AS DOUBLE) END) / count(1)",
    "realised_vol": "stddev_samp(l_quantity) / avg(l_quantity)",
    "vwap": "sum(l_extendedprice) / sum(l_quantity)",
    "liq_long": "sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END)",
    "liq_short": "sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END)",
    "liq_total": "sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END)",
}

def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each brand and week that has line items; bar_idx counts weeks from the first."""
    li, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) / 7).cast("long")
    rows = li.join(part.select("p_partkey", F.col("p_brand").alias("symbol")), li.l_partkey == F.col("p_partkey"))
    rows = rows.select("*", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), week.alias("bar_idx"))
    key = f"struct({', '.join(_KEYS)})"
    aggs = [F.expr(a.format(first=f"min_by(price, {key})", last=f"max_by(price, {key})")).alias(n) for n, a in _AGGS.items()]
    return rows.groupBy("symbol", "bar_idx").agg(*aggs)


def densify(bars: DataFrame) -> DataFrame:
    """All symbols at all bars between the first and the last; the grid's rows come from two small aggregates."""
    ends = bars.agg(F.min("bar_idx").alias("lo"), F.max("bar_idx").alias("hi"))
    symbols = bars.select("symbol").distinct()
    return symbols.join(F.broadcast(ends)).select("symbol", F.explode(F.sequence("lo", "hi")).alias("bar_idx")).withColumn("ts", F.col("bar_idx"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir)
    out = densify(bars).join(bars, ["symbol", "bar_idx"], "left")
    run = F.expr("20.0D * avg(volume) OVER (PARTITION BY symbol) + sum(oi_step) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)")
    out = out.withColumn("oi_usd", F.when(F.col("close").isNotNull(), run)).withColumn("mark", F.col("close")).withColumn("index_price", F.expr("close * (1 + basis)"))
    ref = F.expr(f"max(CASE WHEN symbol = '{REF_SYMBOL}' THEN lr END) OVER (PARTITION BY ts)")
    out = out.withColumn("lr", F.expr("ln(close) - lag(ln(close), 1) OVER (PARTITION BY symbol ORDER BY bar_idx)"))
    return out.withColumn("ref_ret", ref).drop("lr", "oi_step", "basis")


def panel_sql() -> str:
    order = ", ".join(_KEYS)
    aggs = ", ".join(f"{a.format(first=f'first(price ORDER BY {order})', last=f'last(price ORDER BY {order})')} AS {n}" for n, a in _AGGS.items())
    return f"""(
    WITH rows_ AS (SELECT p_brand AS symbol, li.*, l_extendedprice / l_quantity AS price,
        CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS bar_idx
        FROM lineitem li JOIN part ON l_partkey = p_partkey),
    weekly AS (SELECT symbol, bar_idx, {aggs} FROM rows_ GROUP BY symbol, bar_idx),
    grid AS (SELECT s.symbol, t.bar_idx, t.bar_idx AS ts FROM (SELECT DISTINCT symbol FROM weekly) s
        CROSS JOIN (SELECT unnest(generate_series((SELECT min(bar_idx) FROM weekly), (SELECT max(bar_idx) FROM weekly))) AS bar_idx) t),
    full_ AS (SELECT g.symbol, g.bar_idx, g.ts, {', '.join('b.' + n for n in _AGGS)},
        CASE WHEN b.close IS NOT NULL THEN CAST(20.0 AS DOUBLE) * avg(b.volume) OVER (PARTITION BY g.symbol) + sum(b.oi_step) OVER (PARTITION BY g.symbol ORDER BY g.bar_idx ROWS UNBOUNDED PRECEDING) END AS oi_usd,
        b.close AS mark, b.close * (1 + b.basis) AS index_price,
        ln(b.close) - lag(ln(b.close), 1) OVER (PARTITION BY g.symbol ORDER BY g.bar_idx) AS lr
        FROM grid g LEFT JOIN weekly b ON g.symbol = b.symbol AND g.bar_idx = b.bar_idx)
    SELECT *, max(CASE WHEN symbol = '{REF_SYMBOL}' THEN lr END) OVER (PARTITION BY ts) AS ref_ret FROM full_)"""
