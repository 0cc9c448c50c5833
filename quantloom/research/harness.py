"""Checks that a signal looks at no later bar, parameter grids, gates and a log of runs."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Signal = Callable[[DataFrame], DataFrame]


def _gaps(a: DataFrame, b: DataFrame, upto: int, value: str, tol: float) -> DataFrame:
    x, y = (d.filter(F.col("bar_idx") <= upto).select("symbol", "bar_idx", F.col(value).alias(n)) for d, n in ((a, "x"), (b, "y")))
    j = x.join(y, ["symbol", "bar_idx"], "full")
    gap = F.when(F.col("x").isNull() & F.col("y").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col("x") - F.col("y")), F.lit(float("inf"))))
    return j.agg(F.lit(upto).alias("bar_idx"), F.max(gap).alias("max_gap"), F.coalesce(F.max(gap) <= tol, F.lit(True)).alias("passed"))


def future_perturbation(panel: DataFrame, signal: Signal, bars: list[int], *, value: str = "score", columns=("open", "high", "low", "close"), tol: float = 1e-9) -> DataFrame:
    """For each bar: by how much the signal up to it changes when all later prices are multiplied by seeded noise."""
    base, out = signal(panel), None
    for t in bars:
        noise = 1 + (F.pmod(F.xxhash64("symbol", "bar_idx", F.lit(t)), F.lit(1000)) / 1000.0)
        moved = panel.withColumns({c: F.when(F.col("bar_idx") > t, F.col(c) * noise).otherwise(F.col(c)) for c in columns if c in panel.columns})
        g = _gaps(base, signal(moved), t, value, tol)
        out = g if out is None else out.unionByName(g)
    return out


def prefix_stability(panel: DataFrame, signal: Signal, bars: list[int], *, value: str = "score", tol: float = 1e-9) -> DataFrame:
    """For each bar: by how much the signal of the panel cut off after it differs from that of the whole."""
    base, out = signal(panel), None
    for t in bars:
        g = _gaps(base, signal(panel.filter(F.col("bar_idx") <= t)), t, value, tol)
        out = g if out is None else out.unionByName(g)
    return out


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """All combinations, the last name fastest."""
    return [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]


def run_grid(run: Callable[..., DataFrame], grid: dict[str, list]) -> DataFrame:
    """run(**parameters) of each combination, with params as JSON, in one DataFrame that Spark plans as a whole."""
    out = None
    for p in expand_grid(grid):
        d = run(**p).withColumn("params", F.lit(json.dumps(p, sort_keys=True)))
        out = d if out is None else out.unionByName(d)
    return out


@dataclass(frozen=True)
class Gates:
    """What figures must reach. A figure that is missing fails its gate."""

    least: dict[str, float] = field(default_factory=lambda: {"n_trades": 100, "sharpe_ann": 0.5, "profit_factor": 1.1})
    most: dict[str, float] = field(default_factory=dict)

    def judge(self, figures: DataFrame) -> DataFrame:
        """figures with failed (names of gates) and verdict (accept or reject)."""
        fails = [F.when(~F.coalesce(F.col(k) >= v, F.lit(False)), F.lit(k)) for k, v in self.least.items()]
        fails += [F.when(~F.coalesce(F.col(k) <= v, F.lit(False)), F.lit(k)) for k, v in self.most.items()]
        d = figures.withColumn("failed", F.array_compact(F.array(*fails)))
        return d.withColumn("verdict", F.when(F.size("failed") == 0, "accept").otherwise("reject"))


def rank_runs(runs: DataFrame, by: str = "sharpe_ann") -> DataFrame:
    """runs with place, the best first; missing figures last, ties to the smaller params."""
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), "params")))


class Log:
    """Runs in an append-only Parquet table: id (a digest of kind and parameters), kind, params and figures as JSON, and the
    time. Each writer adds files of its own."""

    SCHEMA = "id string, kind string, params string, figures string, at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def id_of(kind: str, params: dict) -> str:
        return hashlib.sha256(json.dumps([kind, params], sort_keys=True).encode()).hexdigest()[:16]

    def add(self, kind: str, params: dict, figures: dict) -> str:
        key = self.id_of(kind, params)
        row = [(key, kind, json.dumps(params, sort_keys=True), json.dumps(figures, sort_keys=True))]
        d = self.spark.createDataFrame(row, "id string, kind string, params string, figures string").withColumn("at", F.current_timestamp())
        d.coalesce(1).write.mode("append").parquet(self.path)
        return key

    def runs(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def latest(self) -> DataFrame:
        """The last entry of each id."""
        rest = F.struct("at", "kind", "params", "figures")
        return self.runs().groupBy("id").agg(F.max(rest).alias("r")).select("id", "r.kind", "r.params", "r.figures", "r.at")

    def trials(self) -> DataFrame:
        """kind and the number of different parameters tried, which deflated figures must take into account."""
        return self.runs().groupBy("kind").agg(F.countDistinct("id").alias("trials"))
