"""Bars and online filters on streams of trades, for Structured Streaming; the same plans run on batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trade_bars(trades: DataFrame, *, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of trades (symbol, ts, seq, price, qty, sold) by event time. Trades later than `late` are dropped, and a
    trade that comes twice within that time counts once; a bar goes out when the watermark passes its end."""
    t = trades.withWatermark("ts", late)
    t = t.dropDuplicatesWithinWatermark(["symbol", "seq"]) if trades.isStreaming else t.dropDuplicates(["symbol", "seq"])
    nz, at = F.col("price") * F.col("qty"), F.struct("ts", "seq")
    signed = F.when(F.col("sold"), -nz).otherwise(nz)
    bars = t.groupBy("symbol", F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n_trades"), F.sum(nz).alias("notional"), F.sum(signed).alias("ofi_usd"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"))
    return bars.select("symbol", F.col("w.start").alias("bar"), F.col("w.end").alias("bar_end"), "n_trades", "notional", "ofi_usd", "open", "high", "low", "close")


def online_level(prices: DataFrame, *, q_over_r: float = 1e-2, noise: float = 1e-4) -> DataFrame:
    """A Kalman level of log prices (symbol, ts, seq, price) that keeps two numbers a symbol as state: symbol, ts, seq, level, z.
    Rows of a batch are taken in order of ts, seq; what came in earlier batches is not revised."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(parts)).sort_values(["ts", "seq"])
        level, var = state.get if state.exists else (math.log(p.price.iloc[0]), 1.0)
        rows = []
        for x in p.price.tolist():
            var += q_over_r * noise
            s, gap = var + noise, math.log(x) - level
            level += var / s * gap
            var *= 1 - var / s
            rows.append((level, gap / math.sqrt(s)))
        state.update((level, var))
        yield pd.DataFrame({"symbol": key[0], "ts": p.ts, "seq": p.seq, "level": [a for a, _ in rows], "z": [b for _, b in rows]})

    ok = prices.select("symbol", "ts", "seq", "price").filter("price > 0")
    return ok.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, seq long, level double, z double", "level double, var double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all there is now and returns what it wrote to path. A run that is repeated goes on from its checkpoint."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def events_as_trades(spark: SparkSession, sf_dir: str, *, streaming: bool = True, **options) -> DataFrame:
    """The events table as trades of event types; odd users sell."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).options(**options) if streaming else spark.read
    e = reader.parquet(f"{sf_dir}/events.parquet*") if streaming else reader.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (1 + F.col("user_id") % 7).cast("double").alias("qty"), (F.col("user_id") % 2 == 1).alias("sold"))
