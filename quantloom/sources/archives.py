"""Batch readers of market archives: CSV files, plain or one to a zip, of candles, trades, funding, depth, quotes, open
interest and liquidations. Files may or may not have a header; columns go by position, except where a kind says otherwise.

Every reader adds `symbol`, the file name up to its first "-", puts times in microseconds back to milliseconds, and leaves
one row for each key. Any store that Spark reads will do.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.floats import ratio


@dataclass(frozen=True)
class Kind:
    """columns: name and type, in order of the file. time: the column that dates a row, epoch milliseconds unless text. key: what
    rows are unique by (none: whole rows)."""

    columns: tuple[tuple[str, str], ...]
    time: str
    key: tuple[str, ...] = ()
    text_time: bool = False
    named: bool = False


def _cols(spec: str) -> tuple[tuple[str, str], ...]:
    return tuple((x.split(":") + ["double"])[:2] for x in spec.split())  # type: ignore[misc]


# The files' columns, in their order.
_CANDLE = _cols("open_time:bigint open high low close volume close_time:bigint quote_volume trades:bigint taker_buy_base taker_buy_quote ignore:string")
KINDS = {
    "candles": Kind(_CANDLE, "open_time", ("open_time",)),
    "index_candles": Kind(_CANDLE, "open_time", ("open_time",)),
    "trades": Kind(_cols("agg_id:bigint price qty first_id:bigint last_id:bigint ts:bigint is_buyer_maker:boolean"), "ts", ("agg_id",)),
    "funding": Kind(_cols("calc_time:bigint funding_interval_hours last_funding_rate"), "calc_time", ("calc_time",)),
    "depth": Kind(_cols("timestamp:string percentage depth notional"), "timestamp", ("timestamp", "percentage"), text_time=True),
    "quotes": Kind(_cols("update_id:bigint best_bid_price best_bid_qty best_ask_price best_ask_qty transaction_time:bigint event_time:bigint"), "transaction_time", ("update_id",)),
    "metrics": Kind(_cols("create_time:string sum_open_interest sum_open_interest_value count_long_short_ratio sum_taker_long_short_vol_ratio"), "create_time", ("create_time",), text_time=True, named=True),
    "liquidations": Kind(_cols("time:bigint side:string last_fill_quantity average_price"), "time", named=True),
}
#: Epoch values above this are microseconds (as milliseconds, it is the year 5138).
MICROSECONDS = 100_000_000_000_000


def _unzipped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, header, line) of zipped or plain files; header is the file's first line."""
    for p in parts:
        for path, content in zip(p["path"], p["content"], strict=True):
            raw = bytes(content)
            if raw[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    raw = z.read(z.namelist()[0])
            lines = raw.decode("utf-8", "replace").splitlines()
            if lines:
                yield pd.DataFrame({"path": path, "header": lines[0], "line": lines})


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """path, header, line of every file at path (a folder, file or pattern). A file is one task's; archives are a day's or a
    month's each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(_unzipped, "path string, header string, line string")


def parse(lines: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind from path, header and line. A line whose first field is no number is a header where times are numbers;
    where they are text, one that names the time column. Fields that don't parse are null; rows without a time go."""
    k = KINDS[kind]
    field = F.transform(F.split("line", ","), lambda x: F.trim(x))
    if k.named:
        head = F.transform(F.split("header", ","), lambda x: F.trim(x))
        at = lambda i, c: F.get("__f", F.array_position(head, c).cast("int") - 1)
    else:
        at = lambda i, c: F.get("__f", F.lit(i))
    d = lines.withColumn("__f", field)
    first = F.get("__f", F.lit(0))
    d = d.filter(F.col("line") != F.col("header")) if k.named else d.filter(~F.lower(first).isin([c for c, _ in k.columns])) if k.text_time else d.filter(first.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE]-?[0-9]+)?$"))

    def typed(x: Column, t: str) -> Column:
        if t == "boolean":
            return F.lower(x).isin("true", "1")
        return x if t == "string" else x.try_cast("double").cast("bigint") if t == "bigint" else x.try_cast("double")

    symbol = F.regexp_extract("path", r"([^/]+?)-[^/]*$", 1).alias("symbol")
    d = d.select(symbol, *[typed(at(i, c), t).alias(c) for i, (c, t) in enumerate(k.columns)])
    if k.text_time:
        d = d.withColumn("dt", F.col(k.time).try_cast("timestamp"))
    else:
        ms = F.when(F.col(k.time) > MICROSECONDS, F.floor(F.col(k.time) / 1000)).otherwise(F.col(k.time))
        d = d.withColumn(k.time, ms).withColumn("dt", F.timestamp_millis(k.time))
    d = d.filter(F.col("dt").isNotNull())
    return d.dropDuplicates(["symbol", *k.key] if k.key else None).drop("ignore")


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return parse(lines_of(spark, path), kind)


def quote_spreads(quotes: DataFrame) -> DataFrame:
    mid = (F.col("best_bid_price") + F.col("best_ask_price")) / 2
    return quotes.withColumn("mid", mid).withColumn("spread_bps", ratio(F.col("best_ask_price") - F.col("best_bid_price"), mid) * 1e4)


def quote_stats(quotes: DataFrame) -> DataFrame:
    """By symbol: updates, quartiles of the spread where it is above 0 and below 200 basis points, updates a second, the mean and
    median time between them (gaps of a minute or more left out), and the median notional at the bid."""
    w = Window.partitionBy("symbol").orderBy("transaction_time", "update_id")
    q = quote_spreads(quotes).withColumn("__gap", (F.col("transaction_time") - F.lag("transaction_time").over(w)) / 1000)
    s = F.when((F.col("spread_bps") > 0) & (F.col("spread_bps") < 200), F.col("spread_bps"))
    gap = F.when((F.col("__gap") >= 0) & (F.col("__gap") < 60), F.col("__gap"))
    return q.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_updates"), *[F.percentile(s, p).alias(n) for p, n in ((0.5, "spread_bps_median"), (0.25, "spread_bps_p25"), (0.75, "spread_bps_p75"))],
        (F.percentile(s, 0.5) / 2).alias("half_spread_bps_median"), (1 / F.nullif(F.avg(gap), F.lit(0.0))).alias("quote_update_hz"),
        F.percentile(F.col("best_bid_qty") * F.col("best_bid_price"), 0.5).alias("bid_notional_median"), F.percentile(gap, 0.5).alias("time_at_touch_median"), F.avg(gap).alias("mean_gap"),
    )


def hourly_metrics(metrics: DataFrame) -> DataFrame:
    """The last open interest and ratios of each hour."""
    last = lambda c, n: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("dt"))).alias(n)
    return metrics.groupBy("symbol", F.date_trunc("hour", "dt").alias("ts")).agg(last("sum_open_interest_value", "oi_usd"), last("sum_open_interest", "oi_contracts"), last("count_long_short_ratio", "lsr_accounts"), last("sum_taker_long_short_vol_ratio", "taker_lsr"))


def hourly_liquidations(events: DataFrame, contract_usd: float = 100.0) -> DataFrame:
    """By symbol and hour, hours without any between the first and the last included: notional sold (longs closed) and bought,
    number, mean price by size, total and imbalance."""
    usd = F.col("last_fill_quantity") * F.lit(contract_usd)
    g = events.groupBy("symbol", F.date_trunc("hour", "dt").alias("ts")).agg(
        F.sum(F.when(F.col("side") == "SELL", usd).otherwise(0.0)).alias("sold"), F.sum(F.when(F.col("side") == "BUY", usd).otherwise(0.0)).alias("bought"),
        F.count("last_fill_quantity").alias("n"), (F.sum(F.col("average_price") * F.col("last_fill_quantity")) / F.nullif(F.sum("last_fill_quantity"), F.lit(0.0))).alias("vwap"),
    )
    ends = g.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    grid = ends.select("symbol", F.explode(F.expr("sequence(a, z, interval 1 hour)")).alias("ts"))
    d = grid.join(g, ["symbol", "ts"], "left").fillna(0, ["sold", "bought", "n"])
    total = F.col("sold") + F.col("bought")
    return d.withColumn("total", total).withColumn("imbalance", (F.col("sold") - F.col("bought")) / F.nullif(total, F.lit(0.0)))
