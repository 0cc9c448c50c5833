"""Time-series expressions over a dense (symbol, bar_idx, ts) grid.

An expression is a small tree that plans.compile turns into chained window stages, for Spark or as SQL text. Missing values are
null throughout: every division guards its denominator, logarithms exist for positive numbers only, and a rolling value
exists where its frame holds at least `mp` values.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    """kind: col, map (elementwise text with {0}, {1} …), ts (window by symbol), cs (window by ts) or ew (recursion)."""

    kind: str
    text: str
    args: tuple[Node, ...] = ()
    duck: str | None = None
    n: int = 0
    mp: int = 0
    alpha: float = 0.0
    adjust: bool = True

    def __add__(self, o):
        return op("({0} + {1})", self, o)

    def __radd__(self, o):
        return op("({1} + {0})", self, o)

    def __sub__(self, o):
        return op("({0} - {1})", self, o)

    def __rsub__(self, o):
        return op("({1} - {0})", self, o)

    def __mul__(self, o):
        return op("({0} * {1})", self, o)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return op("({0} / nullif({1}, 0.0D))", self, o, duck="({0} / nullif({1}, 0.0))")

    def __rtruediv__(self, o):
        return lit(o) / self

    def __neg__(self):
        return op("(-{0})", self)

    def __gt__(self, o):
        return op("coalesce({0} > {1}, false)", self, o)

    def __lt__(self, o):
        return op("coalesce({0} < {1}, false)", self, o)

    def __ge__(self, o):
        return op("coalesce({0} >= {1}, false)", self, o)

    def __and__(self, o):
        return op("({0} AND {1})", self, o)


def lit(v) -> Node:
    if isinstance(v, Node):
        return v
    return Node("map", f"{float(v)!r}D", duck=f"CAST({float(v)!r} AS DOUBLE)")


def op(text: str, *args, duck: str | None = None) -> Node:
    return Node("map", text, tuple(lit(a) for a in args), duck)


def col(name: str) -> Node:
    return Node("col", name)


def L(x):  # noqa: N802
    return op("CASE WHEN {0} > 0 THEN ln({0}) END", x)


def absx(x):
    return op("abs({0})", x)


def sgn(x):
    return op("CAST(sign({0}) AS DOUBLE)", x)


def sqrt0(x):
    return op("sqrt(CASE WHEN {0} < 0 THEN 0.0D ELSE {0} END)", x, duck="sqrt(CASE WHEN {0} < 0 THEN 0.0 ELSE {0} END)")


def tanh(x):
    return op("tanh({0})", x)


def pos(x):
    return where_null(x, x > 0, x, 0.0)


def neg(x):
    return where_null(x, x < 0, x, 0.0)


def clip(x, lo, hi):
    return op("CASE WHEN {0} < {1} THEN {1} WHEN {0} > {2} THEN {2} ELSE {0} END", x, lo, hi)


def where(cond, a, b):
    """A null condition is false."""
    return op("CASE WHEN {0} THEN {1} ELSE {2} END", cond, a, b)


def where_null(x, cond, a, b):
    """As where(), but null where x is."""
    return op("CASE WHEN {0} IS NULL THEN NULL WHEN {1} THEN {2} ELSE {3} END", x, cond, a, b)


def flag(cond):
    return where(cond, 1.0, 0.0)


def only(cond, x):
    """x where the condition holds, else null."""
    return op("CASE WHEN {0} THEN {1} END", cond, x)


def lag(x, k: int):
    return Node("ts", f"lag({{0}}, {k})" if k >= 0 else f"lead({{0}}, {-k})", (lit(x),)) if k else lit(x)


def d(x, k: int):
    return lit(x) - lag(x, k)


def roll(agg: str, x, n: int, mp: int | None = None, y=None, duck: str | None = None) -> Node:
    return Node("ts", agg, (lit(x),) if y is None else (lit(x), lit(y)), duck, n=n, mp=n if mp is None else max(1, mp))


def M(x, n, mp=None):  # noqa: N802
    return roll("avg({0})", x, n, mp)


def S(x, n, mp=None):  # noqa: N802
    return roll("stddev_samp({0})", x, n, mp)


def V(x, n, mp=None):  # noqa: N802
    return roll("var_samp({0})", x, n, mp)


def SUM(x, n, mp=None):  # noqa: N802
    return roll("sum({0})", x, n, mp)


def MIN(x, n, mp=None):  # noqa: N802
    return roll("min({0})", x, n, mp)


def MAX(x, n, mp=None):  # noqa: N802
    return roll("max({0})", x, n, mp)


def MED(x, n, mp=None):  # noqa: N802
    return roll("percentile({0}, 0.5D)", x, n, mp, duck="quantile_cont({0}, 0.5)")


def COUNT(x, n):  # noqa: N802
    return roll("CAST(count({0}) AS DOUBLE)", x, n, 0, duck="CAST(count({0}) AS DOUBLE)")


def SK(x, n, mp=None):  # noqa: N802
    """Bias-corrected skewness."""
    c = COUNT(x, n)
    raw = roll("skewness({0})", x, n, max(3, n if mp is None else mp), duck="skewness({0})")
    return op("({0} * sqrt({1} * ({1} - 1)) / nullif({1} - 2, 0.0D))", raw, c, duck="{0}")


def KU(x, n, mp=None):  # noqa: N802
    """Bias-corrected excess kurtosis."""
    c = COUNT(x, n)
    raw = roll("kurtosis({0})", x, n, max(4, n if mp is None else mp), duck="kurtosis({0})")
    return op("(({1} - 1) / nullif(({1} - 2) * ({1} - 3), 0.0D) * (({1} + 1) * {0} + 6))", raw, c, duck="{0}")


def _both(x, y):
    return op("CASE WHEN {1} IS NOT NULL THEN {0} END", x, y)


def COV(x, y, n, mp=None):  # noqa: N802
    """Over rows where both are present."""
    return roll("covar_samp({0}, {1})", _both(x, y), n, mp, y=_both(y, x))


def CORR(x, y, n, mp=None):  # noqa: N802
    a, b = _both(x, y), _both(y, x)
    return COV(x, y, n, mp) / (S(a, n, mp) * S(b, n, mp))


def SLOPE(y, n, mp=None):  # noqa: N802
    """Least-squares slope on time."""
    return roll("regr_slope({0}, {1})", y, n, mp, y=col("bar_idx"))


def ARGPOS(x, n: int, largest: bool):  # noqa: N802
    """Place (from 0) of the first largest or smallest value in the frame."""
    by = "-" if not largest else ""
    at = roll(f"max_by(bar_idx, struct({by}{{0}}, -bar_idx))", x, n, duck=f"arg_max(bar_idx, CAST(round({by}{{0}} * 1000000) AS HUGEINT) * 100000 - bar_idx)")
    return op(f"CAST({{0}} - ({{1}} - {n - 1}) AS DOUBLE)", at, col("bar_idx"))


def cs(text: str, x) -> Node:
    return Node("cs", text, (lit(x),))


def xm(x):
    return cs("avg({0})", x)


def xs(x):
    return cs("stddev_samp({0})", x)


def X(x):  # noqa: N802
    """Cross-sectional z-score."""
    return (lit(x) - xm(x)) / xs(x)


def Z(x, n, mp=None):  # noqa: N802
    """Trailing z-score, clipped at 4."""
    m = max(5, n // 2) if mp is None else mp
    return clip((lit(x) - M(x, n, m)) / S(x, n, m), -4.0, 4.0)


def RANK(x):  # noqa: N802
    """Average rank by ts over the number of values; null ranks as null."""
    r = Node("cs", "rank", (lit(x),))
    t = Node("cs", "ties", (lit(x),))
    return (r + (t - 1.0) / 2.0) / cs("CAST(count({0}) AS DOUBLE)", x)


def EW(x, n=None, alpha=None, halflife=None, adjust=True):  # noqa: N802
    a = alpha if alpha is not None else 2.0 / (n + 1) if n is not None else 1.0 - 0.5 ** (1.0 / halflife)
    return Node("ew", "ew", (lit(x),), alpha=a, adjust=adjust)


def half(n: int) -> int:
    return max(1, n // 2)
