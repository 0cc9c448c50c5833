"""Compiles expressions to window stages, for Spark DataFrames and as SQL text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quantloom.functions.expr import Node


class Plan:
    """Levels of window columns: a window over a window needs the inner one as a column of the level below."""

    def __init__(self, outputs: dict[str, Node], dialect: str):
        self.duck = dialect == "duck"
        self.names: dict[Node, str] = {}
        self.levels: list[list[tuple[str, Node]]] = []
        self._level: dict[Node, int] = {}
        self._text: dict[Node, str] = {}
        for x in outputs.values():
            self._visit(x)
        self.outputs = {k: self.text(v) for k, v in outputs.items()}

    def _visit(self, x: Node) -> int:
        if x in self._level:
            return self._level[x]
        below = max((self._visit(a) for a in x.args), default=0)
        if x.kind in ("ts", "cs", "ew"):
            below += 1
            while len(self.levels) < below:
                self.levels.append([])
            self.names[x] = f"w{len(self.names)}"
            self.levels[below - 1].append((self.names[x], x))
        self._level[x] = below
        return below

    def text(self, x: Node) -> str:
        """The expression in terms of columns of the levels below."""
        if x in self.names:
            return self.names[x]
        if x not in self._text:
            form = x.duck if self.duck and x.duck is not None else x.text
            self._text[x] = x.text if x.kind == "col" else form.format(*[self.text(a) for a in x.args])
        return self._text[x]

    def window(self, x: Node) -> str:
        args = [self.text(a) for a in x.args]
        form = x.duck if self.duck and x.duck is not None else x.text
        if x.kind == "cs":
            if x.text == "rank":
                return f"CASE WHEN {args[0]} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY ts ORDER BY {args[0]} NULLS LAST) AS DOUBLE) END"
            if x.text == "ties":
                return f"CAST(count(1) OVER (PARTITION BY ts, {args[0]}) AS DOUBLE)"
            if form.startswith("CAST("):
                return f"CAST({form[5:].split(' AS ')[0].format(*args)} OVER (PARTITION BY ts) AS DOUBLE)"
            return f"{form.format(*args)} OVER (PARTITION BY ts)"
        if x.kind == "ew":
            return self._closed_ew(args[0], x)
        if not x.n:
            return f"{form.format(*args)} OVER (PARTITION BY symbol ORDER BY bar_idx)"
        frame = f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {x.n - 1} PRECEDING AND CURRENT ROW)"
        if form.startswith("CAST("):
            agg = f"CAST({form[5:].split(' AS ')[0].format(*args)} {frame} AS DOUBLE)"
        else:
            agg = f"{form.format(*args)} {frame}"
        if x.mp <= 1 and "count(" in form:
            return agg
        return f"CASE WHEN count({args[0]}) {frame} >= {x.mp} THEN {agg} END"

    def _closed_ew(self, a: str, x: Node) -> str:
        """The recursion in closed form, for short grids: the powers stay within a double."""
        q = 1.0 - x.alpha
        run = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"
        if x.adjust:
            return f"(sum({a} * pow({q!r}, -bar_idx)) {run} / nullif(sum(CASE WHEN {a} IS NOT NULL THEN pow({q!r}, -bar_idx) END) {run}, 0))"
        raise NotImplementedError("the recursion without adjustment has no closed form over gaps")

    def sql(self, source: str, keys: tuple[str, ...] = ("symbol", "bar_idx")) -> str:
        q = source
        for level in self.levels:
            q = f"(SELECT *, {', '.join(f'{self.window(x)} AS {n}' for n, x in level)} FROM {q})"
        return f"SELECT {', '.join([*keys, *(f'{t} AS {k}' for k, t in self.outputs.items())])} FROM {q}"

    def apply(self, df: DataFrame, keys: tuple[str, ...] = ("symbol", "bar_idx")) -> DataFrame:
        for level in self.levels:
            ew = [(n, x) for n, x in level if x.kind == "ew"]
            rest = [(n, x) for n, x in level if x.kind != "ew"]
            if rest:
                df = df.selectExpr("*", *[f"{self.window(x)} AS {n}" for n, x in rest])
            if ew:
                df = recursions(df, [(n, self.text(x.args[0]), x.alpha, x.adjust) for n, x in ew])
        return df.selectExpr(*keys, *[f"{t} AS {k}" for k, t in self.outputs.items()])


def ewm(x: np.ndarray, alpha: float, adjust: bool) -> np.ndarray:
    """Exponential mean over places; a gap keeps the value and ages the weights."""
    out = np.full(len(x), np.nan)
    q, num, den = 1.0 - alpha, 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        den *= q
        num *= q
        if v == v:
            w = 1.0 if adjust or den == 0.0 else alpha
            num += w * v
            den += w
            if not adjust:
                num, den = num / den, 1.0
        if den > 0.0:
            out[i] = num / den
    return out


def recursions(df: DataFrame, todo: list[tuple[str, str, float, bool]]) -> DataFrame:
    """Adds exponential means, one pass over each symbol in time order."""
    df = df.selectExpr("*", *[f"CAST({t} AS DOUBLE) AS {n}" for n, t, _, _ in todo])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        for n, _, alpha, adjust in todo:
            pdf[n] = ewm(pdf[n].to_numpy(float), alpha, adjust)
            pdf[n] = pdf[n].astype(object).where(pdf[n].notna(), None)
        return pdf

    return df.groupBy("symbol").applyInPandas(run, df.schema)
