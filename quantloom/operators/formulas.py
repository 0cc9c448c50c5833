"""The registry of signal formulas: eight divisions of twenty, each a score by (symbol, bar).

A formula is a function from its windows to an expression. Windows are numbers of grid rows; DEFAULTS has those of hourly
(or quarter-hourly) bars, and scaled() shortens them for coarser grids.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from quantloom.functions.expr import (
    ARGPOS,
    CORR,
    COV,
    EW,
    KU,
    MAX,
    MED,
    MIN,
    SK,
    SLOPE,
    SUM,
    L,
    M,
    Node,
    S,
    V,
    X,
    Z,
    absx,
    clip,
    col,
    d,
    flag,
    half,
    lag,
    neg,
    only,
    op,
    pos,
    sgn,
    sqrt0,
    where,
    where_null,
    xm,
    xs,
)

REGISTRY: dict[str, tuple[str, Callable[..., Node], dict[str, float]]] = {}

c, h, l, o, v, qv = (col(x) for x in ("close", "high", "low", "open", "volume", "quote_volume"))  # noqa: E741
tbb, oi, f, pr, mark, index = (col(x) for x in ("taker_buy_base", "oi_usd", "funding", "premium", "mark", "index_price"))
imb1, imb5, tilt, slope, withdraw, imb_vol, depth, n_snap = (col(x) for x in ("imb_1pct", "imb_5pct", "micro_tilt", "book_slope", "depth_withdraw", "imb_vol", "depth_total", "n_snap"))
ofi, notional, bf, aggr, kyle, ac1, roll_bps, big, rv, vwap, n_trades = (col(x) for x in ("ofi_usd", "notional", "buy_frac", "aggr_imb", "kyle_lambda", "sign_ac1", "roll_bps", "big_imb", "realised_vol", "vwap", "n_trades"))
r = d(L(c), 1)
ref = col("ref_ret")
DIVISIONS = ("trend", "volatility", "depth", "flow", "interest", "carry", "volume", "regime")
_N = {x: i for i, x in enumerate("TVBOICUR")}


def formula(name: str, **params):
    """Registers a formula under its id; the first letter is the division."""

    def keep(fn):
        REGISTRY[name] = (DIVISIONS[_N[name[0]]], fn, params)
        return fn

    return keep


def scaled(params: dict[str, float], by: int) -> dict[str, float]:
    """The windows of a formula that has one above 30: whole numbers from 12 on are divided by `by`, 4 at least, and keep
    their order."""
    windows = sorted((x, k) for k, x in params.items() if isinstance(x, int) and not isinstance(x, bool) and x >= 12)
    out, last = dict(params), (0, 3)
    if windows and windows[-1][0] > 30:
        for x, k in windows:
            out[k] = last[1] if x == last[0] else max(last[1] + 1, x // by)
            last = (x, out[k])
    return out


def build(name: str, by: int = 1) -> Node:
    _, fn, params = REGISTRY[name]
    return fn(**(scaled(params, by) if by > 1 else params))


def _all(defs: dict[str, tuple[Callable[..., Node], dict]]):
    for name, (fn, params) in defs.items():
        formula(name, **params)(fn)


def pct(x, k):
    return x / lag(x, k) - 1.0


def wma(x, w):
    """Linear weights 1 .. w, newest heaviest."""
    t = col("bar_idx")
    weighted = SUM(op("({0} * {1})", t, x), w) - (t - float(w)) * SUM(x, w)
    return weighted / (w * (w + 1) / 2)


def rs_hurst(x, n, least):
    """Rescaled range over the frame: ln(R/S) / ln(count); R from the path of deviations, by running sums inside the frame."""
    vals = Node("ts", "collect_list({0})", (x,), n=n, mp=least)
    mean = op("aggregate({0}, 0.0D, (a, y) -> a + y) / size({0})", vals)
    sd = op("sqrt(aggregate({0}, 0.0D, (a, y) -> a + (y - {1}) * (y - {1})) / size({0}))", vals, mean)
    span = op(
        "aggregate({0}, named_struct('s', 0.0D, 'hi', CAST('-Infinity' AS DOUBLE), 'lo', CAST('Infinity' AS DOUBLE)), (a, y) -> named_struct('s', a.s + y - {1}, 'hi', greatest(a.hi, a.s + y - {1}), 'lo', least(a.lo, a.s + y - {1})), a -> a.hi - a.lo)",
        vals,
        mean,
    )
    n_ = op("CAST(size({0}) AS DOUBLE)", vals)
    return L(span / sd) / L(n_)


def beta(y, x, n, mp=None):
    m = half(n) if mp is None else mp
    return COV(y, x, n, m) / V(x, n, m)


def variance_ratio(x, q, n):
    return V(SUM(x, q), n) / float(q) / V(x, n)


mkt = xm(r)
rs_term = L(h / c) * L(h / o) + L(l / c) * L(l / o)


def _dmi(n):
    up, dn = d(h, 1), -d(l, 1)
    plus = where((up > dn) & (up > 0.0), up, 0.0)
    minus = where((dn > up) & (dn > 0.0), dn, 0.0)
    return X((M(plus, n) - M(minus, n)) / M(h - l, n))


def _kama(n, fast, slow):
    er = absx(d(c, n)) / SUM(absx(d(c, 1)), n)
    a, b = 2.0 / (fast + 1), 2.0 / (slow + 1)
    sc = er * (a - b) + b
    return X(sc * sc * sgn(d(c, n)))


def _macd(fast, slow, sig):
    m = EW(c, fast) - EW(c, slow)
    return X((m - EW(m, sig)) / c)


def _tema(n):
    e1 = EW(c, n)
    e2 = EW(e1, n)
    return X((3.0 * e1 - 3.0 * e2 + EW(e2, n)) / c - 1.0)


def _mid(n):
    return (MAX(h, n) + MIN(l, n)) / 2.0


def _cmo(n):
    up, dn = SUM(pos(d(c, 1)), n), SUM(pos(-d(c, 1)), n)
    return X((up - dn) / (up + dn))


_all(
    {
        "T01": (lambda k: X(d(L(c), k) / S(pct(c, 1), k, half(k))), {"k": 168}),
        "T02": (lambda k, skip: X(lag(L(c), skip) - lag(L(c), k)), {"k": 720, "skip": 24}),
        "T03": (_macd, {"fast": 12, "slow": 26, "sig": 9}),
        "T04": (lambda fast, slow: X(M(c, fast) / M(c, slow) - 1.0), {"fast": 24, "slow": 168}),
        "T05": (lambda n: X((c - MIN(l, n)) / (MAX(h, n) - MIN(l, n)) - 0.5), {"n": 168}),
        "T06": (lambda n: X((ARGPOS(h, n, True) - ARGPOS(l, n, False)) / float(n)), {"n": 100}),
        "T07": (_dmi, {"n": 48}),
        "T08": (lambda n: X((SUM(absx(h - lag(l, 1)), n) - SUM(absx(l - lag(h, 1)), n)) / SUM(h - l, n)), {"n": 48}),
        "T09": (_kama, {"n": 100, "fast": 2, "slow": 30}),
        "T10": (lambda n: X((rs_hurst(r, n, min(40, half(n))) - 0.5) * sgn(d(L(c), half(n)))), {"n": 240}),
        "T11": (lambda n, q: X((variance_ratio(r, q, n) - 1.0) * sgn(SUM(r, max(1, n // 4)))), {"n": 240, "q": 8}),
        "T12": (_tema, {"n": 48}),
        "T13": (lambda conv, base: X((_mid(conv) - _mid(base)) / c), {"conv": 9, "base": 26}),
        "T14": (lambda n, mult: X((c - ((h + l) / 2.0 - mult * M(h - l, n))) / c), {"n": 24, "mult": 3.0}),
        "T15": (_cmo, {"n": 48}),
        "T16": (lambda n: X(d(EW(EW(EW(L(c), n), n), n), 1)), {"n": 30}),
        "T17": (lambda fast, slow: X((EW(c, fast) - EW(c, slow)) / EW(c, slow)), {"fast": 24, "slow": 96}),
        "T18": (lambda n: X(((h - EW(c, n)) + (l - EW(c, n))) / c), {"n": 26}),
        "T19": (lambda a, b, w: X(wma(c / lag(c, a) - 1.0 + c / lag(c, b) - 1.0, w)), {"a": 294, "b": 168, "w": 60}),
        "T20": (lambda n: X(SLOPE(L(c), n) / S(r, n)), {"n": 120}),
    }
)


def _yang_zhang(n):
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    return -X(sqrt0(V(L(o / lag(c, 1)), n) + k * V(L(c / o), n) + (1 - k) * M(rs_term, n)))


def _gk(n):
    return -X(sqrt0(M(0.5 * L(h / l) * L(h / l) - (2 * math.log(2) - 1) * L(c / o) * L(c / o), n)))


def _semivar(n, sign=1.0, eps=0.0):
    up, dn = SUM(pos(r) * pos(r), n), SUM(neg(r) * neg(r), n)
    return sign * X((up - dn) / (up + dn + eps))


def _bipower(n):
    rv_, bv = SUM(r * r, n), math.pi / 2 * SUM(absx(r) * lag(absx(r), 1), n)
    return -X(pos(rv_ - bv) / rv_)


def _residual(n, mp=None):
    return r - beta(r, mkt, n, mp) * mkt


def _downside(n):
    x, y = only(mkt < 0.0, mkt), only(mkt < 0.0, r)
    return -X(COV(y, x, n, n // 4) / V(x, n, n // 4))


_all(
    {
        "V01": (lambda n: -X(S(r, n, half(n))), {"n": 720}),
        "V02": (_yang_zhang, {"n": 168}),
        "V03": (lambda n: -X(sqrt0(M(L(h / l) * L(h / l), n) / (4 * math.log(2)))), {"n": 168}),
        "V04": (_gk, {"n": 168}),
        "V05": (lambda n: -X(sqrt0(M(rs_term, n))), {"n": 168}),
        "V06": (lambda lam: -X(sqrt0(EW(r * r, alpha=1 - lam))), {"lam": 0.94}),
        "V07": (lambda fast, slow: -X(S(r, fast) / S(r, slow)), {"fast": 48, "slow": 336}),
        "V08": (lambda a, b, m: -X(sqrt0(0.4 * SUM(r * r, a) + 0.35 * SUM(r * r, b) / 5.0 + 0.25 * SUM(r * r, m) / 22.0)), {"a": 24, "b": 120, "m": 528}),
        "V09": (_semivar, {"n": 336}),
        "V10": (_bipower, {"n": 336}),
        "V11": (lambda n, m: -X(S(S(r, n), m, half(m))), {"n": 168, "m": 720}),
        "V12": (lambda n: -X(M(h - l, n) / c), {"n": 48}),
        "V13": (lambda n: -X(2.0 * S(c, n) / M(c, n)), {"n": 96}),
        "V14": (lambda n: -X(M(h - l, n) / EW(c, n)), {"n": 96}),
        "V15": (lambda n: -X(EW(h - l, n) / lag(EW(h - l, n), n) - 1.0), {"n": 48}),
        "V16": (lambda n: -X(S(_residual(n), n, half(n))), {"n": 504}),
        "V17": (_downside, {"n": 504}),
        "V18": (lambda n: -X(MAX(r, n)), {"n": 168}),
        "V19": (lambda n: -X(SK(r, n, half(n))), {"n": 504}),
        "V20": (lambda n: -X(KU(r, n, half(n))), {"n": 504}),
    }
)
_all(
    {
        "B01": (lambda k: X(M(imb1, k, 1)), {"k": 3}),
        "B02": (lambda k: -X(M(imb1, k, 1)), {"k": 1}),
        "B03": (lambda k: X(M(imb5, k, 1)), {"k": 3}),
        "B04": (lambda k: X(M(tilt, k, 1)), {"k": 1}),
        "B05": (lambda k: -X(tilt - M(tilt, k, 2)), {"k": 6}),
        "B06": (lambda k: -X(M(slope, k, 1)), {"k": 3}),
        "B07": (lambda k: X(-M(slope, k, 2) * sgn(d(L(c), k))), {"k": 3}),
        "B08": (lambda k: -X(M(withdraw, k, 1) * sgn(d(L(c), k))), {"k": 3}),
        "B09": (lambda k: -X(M(imb_vol, k, 1) * sgn(d(L(c), k))), {"k": 3}),
        "B10": (lambda k: -X(L(M(depth, k, 1))), {"k": 12}),
        "B11": (lambda k, n: X(M(-(L(depth) - M(L(depth), n, half(n))), k, 1)), {"k": 6, "n": 96}),
        "B12": (lambda k: X(d(imb1, k)), {"k": 6}),
        "B13": (lambda n: -X(Z(imb1, n)), {"n": 96}),
        "B14": (lambda k: X(M(imb1 - imb5, k, 1)), {"k": 3}),
        "B15": (lambda k: X(M(imb1 * L(depth), k, 1)), {"k": 3}),
        "B16": (lambda k: X(-M(neg(withdraw), k, 1) * sgn(d(L(c), k))), {"k": 12}),
        "B17": (lambda k: -X(M(imb_vol, k, 1)), {"k": 12}),
        "B18": (lambda k: -X(M(n_snap, k, 1)), {"k": 12}),
        "B19": (lambda k: X(M(tilt, k, 1) * sgn(M(imb1, k, 1))), {"k": 3}),
        "B20": (lambda k, n: X(d(Z(imb5, n), k)), {"k": 6, "n": 96}),
    }
)
share = ofi / notional


def _propagator(lags):
    w = [(i + 1) ** -0.5 for i in range(lags)]
    out = (w[0] / sum(w)) * share
    for i in range(1, lags):
        out = out + (w[i] / sum(w)) * lag(share, i)
    return X(out)


def _absorption(k, n):
    flow, move = SUM(share, k, 1), absx(d(L(c), k))
    return X(absx(flow) * sgn(flow) * clip(1.0 - move / M(move, n), -1.0, 1.0))


_all(
    {
        "O01": (lambda k: X(SUM(ofi, k, 1) / SUM(notional, k, 1)), {"k": 3}),
        "O02": (lambda k: -X(SUM(ofi, k, 1) / SUM(notional, k, 1)), {"k": 1}),
        "O03": (lambda k: X(SUM((2.0 * bf - 1.0) * notional, k, 1) / SUM(notional, k, 1)), {"k": 12}),
        "O04": (lambda k: X(M(aggr, k, 1)), {"k": 3}),
        "O05": (lambda n: -X(M(absx(2.0 * bf - 1.0), n, half(n))), {"n": 48}),
        "O06": (lambda n: -X(M(L(absx(kyle)), n, half(n))), {"n": 48}),
        "O07": (lambda n: -X(M(roll_bps, n, half(n))), {"n": 48}),
        "O08": (lambda n: X(M(ac1, n, half(n)) * sgn(SUM(ofi, n, 1))), {"n": 48}),
        "O09": (lambda k: X(M(big, k, 1)), {"k": 6}),
        "O10": (lambda k: -X(M(big, k, 1)), {"k": 3}),
        "O11": (lambda k, n: -X(M(Z(L(n_trades), n), k, 1)), {"k": 12, "n": 96}),
        "O12": (lambda halflife: X(EW(share, halflife=halflife)), {"halflife": 8}),
        "O13": (lambda n: -X(M(ac1, n, half(n))), {"n": 96}),
        "O14": (_propagator, {"lags": 12}),
        "O15": (lambda k: X(M((c - vwap) / c, k, 1)), {"k": 3}),
        "O16": (lambda k: -X(M((c - vwap) / c, k, 1)), {"k": 6}),
        "O17": (lambda n: -X(M(absx(r) / notional, n, half(n))), {"n": 96}),
        "O18": (lambda n: -X(M(rv, n, half(n))), {"n": 96}),
        "O19": (lambda k, n: X(M(share, k, 1) / S(share, n, half(n))), {"k": 3, "n": 96}),
        "O20": (_absorption, {"k": 6, "n": 96}),
    }
)
loi = L(oi)


def _moves(k):
    return d(L(c), k), d(loi, k)


def _cover(k):
    p, q = _moves(k)
    return -X((flag((p > 0.0) & (q < 0.0)) - flag((p < 0.0) & (q < 0.0))) * absx(p))


def _pressed(k, rising):
    p, q = _moves(k)
    return X(flag((p < 0.0) & ((q > 0.0) if rising else (q < 0.0))) * absx(p))


def _breadth(k):
    x = d(loi, k)
    return -X(x * xm(where_null(x, x > 0.0, 1.0, 0.0)))


_all(
    {
        "I01": (lambda n: -X(L(oi / M(qv, n, half(n)))), {"n": 168}),
        "I02": (lambda k: -X(d(loi, k)), {"k": 24}),
        "I03": (lambda k: X(d(loi, k)), {"k": 24}),
        "I04": (lambda k: X(sgn(d(loi, k)) * sgn(d(L(c), k)) * absx(d(loi, k)) * sgn(d(L(c), k))), {"k": 24}),
        "I05": (_cover, {"k": 24}),
        "I06": (lambda n: -X(Z(loi, n)), {"n": 720}),
        "I07": (lambda k: -X(absx(d(oi, k)) / SUM(qv, k, half(k))), {"k": 24}),
        "I08": (lambda k: -X(d(d(loi, k), k)), {"k": 12}),
        "I09": (lambda n: -X(Z(L(oi / qv), n)), {"n": 168}),
        "I10": (lambda k, n: X(M(d(loi, k), n, half(n)) / S(d(loi, k), n, half(n))), {"k": 72, "n": 336}),
        "I11": (lambda k: -X(d(loi, k) - xm(d(loi, k))), {"k": 24}),
        "I12": (lambda n: -X(Z(d(loi, 1), n)), {"n": 336}),
        "I13": (lambda k, n: -X(d(loi, k) * Z(S(r, n, half(n)), n)), {"k": 24, "n": 336}),
        "I14": (lambda k: -X(d(loi, k) * sgn(M(f, k, 1))), {"k": 24}),
        "I15": (lambda n: -X(L(M(oi, n, half(n)))), {"n": 168}),
        "I16": (lambda n: X(L(SUM(qv, n, half(n)) / oi)), {"n": 168}),
        "I17": (lambda k: _pressed(k, False), {"k": 12}),
        "I18": (lambda k: _pressed(k, True), {"k": 12}),
        "I19": (_breadth, {"k": 24}),
        "I20": (lambda n: -X(loi - M(loi, n, half(n))), {"n": 720}),
    }
)
b = mark / index - 1.0


def _mean_breadth(k):
    g = M(f, k, 1)
    return -X(g * xm(where_null(g, g > 0.0, 1.0, 0.0)))


def _regime(k, n):
    g = M(f, k, 1)
    return -X(g * sgn(Z(xm(g), n)))


_all(
    {
        "C01": (lambda k: -X(M(f, k, 1)), {"k": 3}),
        "C02": (lambda k: X(M(f, k, 1)), {"k": 24}),
        "C03": (lambda n: -X(Z(f, n)), {"n": 720}),
        "C04": (lambda k: -X(d(f, k)), {"k": 8}),
        "C05": (lambda k, trail: X(M(f - M(f, trail, half(trail)), k, 1)), {"k": 24, "trail": 168}),
        "C06": (lambda k: -X(M(pr, k, 1)), {"k": 8}),
        "C07": (lambda k: -X(M(b, k, 1)), {"k": 8}),
        "C08": (lambda k: X(d(b, k)), {"k": 48}),
        "C09": (lambda n: -X(S(f, n, half(n))), {"n": 336}),
        "C10": (lambda n: -X(SK(f, n, half(n))), {"n": 720}),
        "C11": (lambda n: -X(f - M(f, n, half(n))), {"n": 336}),
        "C12": (lambda k: -X(M(f, k, 1) * -sgn(d(L(c), k))), {"k": 48}),
        "C13": (lambda k, n: -X(M(f, k, 1) / S(r, n, half(n))), {"k": 3, "n": 336}),
        "C14": (_mean_breadth, {"k": 24}),
        "C15": (lambda k: -X(M(f, k, 1) - xm(M(f, k, 1))), {"k": 24}),
        "C16": (lambda n: -X(SUM(f, n, half(n))), {"n": 168}),
        "C17": (lambda n: -X(S(pr, n, half(n))), {"n": 336}),
        "C18": (lambda n: -X(Z(b, n)), {"n": 720}),
        "C19": (_regime, {"k": 24, "n": 720}),
        "C20": (lambda k, m: X(-X(M(f, k, 1)) + X(d(L(c), m))), {"k": 3, "m": 336}),
    }
)
imbalance = (2.0 * tbb / v - 1.0) * qv


def _mfi(n):
    flow = (h + l + c) / 3.0 * qv
    move = d((h + l + c) / 3.0, 1)
    up, dn = SUM(where(move > 0.0, flow, 0.0), n), SUM(where(move < 0.0, flow, 0.0), n)
    return -X(up / (up + dn))


_all(
    {
        "U01": (lambda n, m: X(L(M(qv, n, half(n)) / M(qv, m, half(m)))), {"n": 168, "m": 720}),
        "U02": (lambda n: -X(L(SUM(qv, n, half(n)))), {"n": 168}),
        "U03": (lambda fast, slow: X(M(qv, fast) / M(qv, slow)), {"fast": 48, "slow": 336}),
        "U04": (lambda n: X(SUM(sgn(r) * qv, n) / SUM(qv, n)), {"n": 168}),
        "U05": (lambda k, n: -X(d(L(c), k) * pos(Z(L(qv), n))), {"k": 24, "n": 336}),
        "U06": (lambda n: X(M(tbb / v - 0.5, n, half(n))), {"n": 168}),
        "U07": (lambda n: -X(M(tbb / v - 0.5, n, half(n))), {"n": 48}),
        "U08": (lambda n: X(M(absx(r) / qv, n, half(n))), {"n": 720}),
        "U09": (lambda n: X(Z(L(qv), n)), {"n": 336}),
        "U10": (lambda n: -X(S(L(qv), n, half(n))), {"n": 720}),
        "U11": (_mfi, {"n": 168}),
        "U12": (lambda n: -X(c / (SUM(c * qv, n) / SUM(qv, n)) - 1.0), {"n": 168}),
        "U13": (lambda n: -X(Z(L(absx(r) / qv), n)), {"n": 336}),
        "U14": (lambda n: -X(CORR(absx(r), L(qv), n, half(n))), {"n": 336}),
        "U15": (lambda n: -X(L(M(qv, n, half(n)))), {"n": 720}),
        "U16": (lambda n, m: X(SUM(qv, n) / MED(SUM(qv, n), m, half(m))), {"n": 168, "m": 1440}),
        "U17": (lambda k: X(SUM(imbalance, k) / SUM(qv, k)), {"k": 72}),
        "U18": (lambda n, m: X(SUM(qv, n) / MAX(SUM(qv, n), m, half(m)) * sgn(d(L(c), n))), {"n": 168, "m": 720}),
        "U19": (lambda n: -X(beta(r, xm(absx(r) / qv), n)), {"n": 720}),
        "U20": (lambda n: -X(L(absx(beta(r, imbalance, n)))), {"n": 336}),
    }
)


def _risk(n):
    level = M(xs(r), n, half(n))
    return X(beta(r, mkt, n) * -sgn(d(level, n)))


def _vol_switch(n, m):
    hi = where(Z(S(r, n), m) > 0.0, 1.0, -1.0)
    return X(-hi * SUM(r, n))


def _cusum(n, k):
    z = (r - M(r, n, half(n))) / S(r, n, half(n))
    return X(SUM(pos(z - k), max(1, n // 4)))


def _dispersion(n):
    x = M(xs(r), n, half(n))
    return X(SUM(r, n) * sgn((x - M(x, 2 * n, n)) / S(x, 2 * n, n)))


def _corr_regime(n):
    rho = CORR(r, mkt, n, half(n))
    return X(-rho * sgn(d(xm(rho), n)))


def _idio_mom(k, n):
    e = _residual(n)
    return X(SUM(e, k) / S(e, n, half(n)))


_all(
    {
        "R01": (lambda n: X(beta(r, mkt, n) * sgn(M(mkt, n, half(n)))), {"n": 720}),
        "R02": (_vol_switch, {"n": 168, "m": 1440}),
        "R03": (_risk, {"n": 336}),
        "R04": (_cusum, {"n": 336, "k": 0.5}),
        "R05": (lambda n, q: X(-pos(1.0 - variance_ratio(r, q, n)) * SUM(r, max(1, n // 8))), {"n": 336, "q": 8}),
        "R06": (lambda n: X((rs_hurst(r, n, min(60, half(n))) - 0.5) * SUM(r, max(1, n // 4))), {"n": 480}),
        "R07": (lambda n: X(c / MAX(c, n, half(n)) - 1.0), {"n": 720}),
        "R08": (lambda s, m: -X(S(r, s) / S(r, m, half(m))), {"s": 168, "m": 1440}),
        "R09": (lambda k: X(d(L(c), k) - xm(d(L(c), k))), {"k": 336}),
        "R10": (lambda n: -X(beta(r, ref, n)), {"n": 720}),
        "R11": (lambda lag_, n: X(beta(r, ref, n) * lag(ref, lag_)), {"lag_": 1, "n": 336}),
        "R13": (lambda k: X(lag(SUM(r, k) - xm(SUM(r, k)), max(1, k // 4))), {"k": 168}),
        "R14": (_dispersion, {"n": 336}),
        "R15": (_corr_regime, {"n": 336}),
        "R16": (_idio_mom, {"k": 336, "n": 504}),
        "R17": (lambda n: -X(beta(r, mkt, n) - xm(beta(r, mkt, n))), {"n": 720}),
        "R18": (lambda n: -X(CORR(r, ref, n, half(n))), {"n": 504}),
        "R20": (lambda n: X((CORR(r, lag(mkt, 1), n, half(n)) - CORR(r, mkt, n, half(n))) * sgn(SUM(mkt, max(1, n // 8)))), {"n": 336}),
    }
)
