"""Queries of the panel engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import studies
from quantloom.functions.expr import Node, op
from quantloom.operators import features, formulas, market, recursive
from quantloom.plans.compile import Plan
from quantloom.sources import adapters

#: Hourly windows are divided by this on the weekly grid.
SCALE = 14
NO_SQL = {"T10", "R06"} | features.NO_SQL
TABLES = ("events", "orders", "customer", "lineitem", "part")


def _rounded(x: Node) -> Node:
    return op("round({0}, 5)", x)


def _nodes() -> dict[str, Node]:
    return {k: formulas.build(k, SCALE) for k in formulas.REGISTRY} | features.FEATURES


def groups(size: int = 5) -> dict[str, list[str]]:
    """Query name: signals, those of one division or family together; signals without a SQL twin stand alone."""
    out: dict[str, list[str]] = {}
    by: dict[str, list[str]] = {}
    for k, (division, _, _) in formulas.REGISTRY.items():
        by.setdefault(division, []).append(k)
    by["feature"] = list(features.FEATURES)
    for family, names in by.items():
        plain = [n for n in names if n not in NO_SQL]
        for i in range(0, len(plain), size):
            part = plain[i : i + size]
            out[f"{family}_{part[0]}_{part[-1]}" if family != "feature" else f"features_{i // size + 1:02d}"] = part
        out |= {f"{family}_{n}": [n] for n in names if n in NO_SQL}
    return out


def signals(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    nodes = _nodes()
    return Plan({n: _rounded(nodes[n]) for n in names}, "spark").apply(adapters.panel(spark, sf_dir))


def signals_sql(names: list[str]) -> str:
    nodes = _nodes()
    return Plan({n: _rounded(nodes[n]) for n in names}, "duck").sql(f"{adapters.panel_sql()} src")


def market_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    adapters.panel(spark, sf_dir).createOrReplaceTempView("quantloom_panel")
    return spark.sql(market.text(name, "spark", "quantloom_panel"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: partial(signals, names=v) for k, v in groups().items()}
    out |= {k: partial(market_query, name=k) for k in market.NAMES}
    out |= studies.QUERIES
    return out | {k: partial(lambda spark, sf_dir, f: f(adapters.panel(spark, sf_dir)), f=f) for k, f in recursive.OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: signals_sql(v) for k, v in groups().items() if not set(v) & NO_SQL}
    return out | {k: market.duck_sql(k) for k in market.NAMES} | studies.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel position of each brand by month-like bars: scan, resample, densify, window, cross-section."""
    out = Plan({"T05": _rounded(formulas.REGISTRY["T05"][1](n=4))}, "spark").apply(adapters.panel(spark, sf_dir))
    return out.filter(F.col("symbol").isNotNull())
