"""Ordered recursions and replicate statistics: grouped pandas where no window expresses them."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_symbol(panel: DataFrame, fn, schema: str, gaps: bool = False) -> DataFrame:
    d = panel.select("symbol", "bar_idx", "close", "funding")
    return (d if gaps else d.filter("close IS NOT NULL")).groupBy("symbol").applyInPandas(lambda p: fn(p.sort_values("bar_idx")), schema)


def local_level(panel: DataFrame, q_over_r: float = 1e-5) -> DataFrame:
    """Kalman filter of a level of log closes: y = level + noise; z is the innovation over its deviation. The state's variance
    starts at 1, the noise is the variance of y's changes, and a missing close counts as the symbol's mean."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y = np.log(p["close"].to_numpy(float))
        steps = np.diff(y)
        rv = float(np.nanvar(steps)) if np.isfinite(steps).any() else 1.0
        rv = rv if rv > 0 else 1.0
        y = np.where(np.isnan(y), np.nanmean(y), y) if np.isfinite(y).any() else np.zeros(len(y))
        level, var, out = y[0], 1.0, []
        for v in y.tolist():
            var += q_over_r * rv
            s = var + rv
            e = v - level
            gain = var / s
            level += gain * e
            var *= 1 - gain
            out.append((level, e / np.sqrt(s)))
        return pd.DataFrame({"symbol": p["symbol"], "bar_idx": p["bar_idx"], "level": np.round([a for a, _ in out], 8), "z": np.round([b for _, b in out], 8)})

    return _by_symbol(panel, run, "symbol string, bar_idx long, level double, z double", gaps=True)


def hysteresis(panel: DataFrame, enter: float = 1.0, leave: float = 0.25, n: int = 52) -> DataFrame:
    """A position against funding: it opens at the opposite sign when |z| reaches `enter`, closes when |z| falls below `leave` or z
    turns, at the earliest reopens at the next bar, and is held where z is missing. z is over the last n bars, this one
    included; bars with fewer than half of them have none."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        f = p["funding"].astype(float)
        w = f.rolling(n, min_periods=n // 2)
        sd = w.std(ddof=1)
        z = ((f - w.mean()) / sd.where(sd > 0)).to_numpy()
        now, out = 0, []
        for v in z.tolist():
            if v == v:
                if now:
                    now = 0 if -now * v < leave else now
                elif abs(v) >= enter:
                    now = -int(np.sign(v))
            out.append(now)
        return pd.DataFrame({"symbol": p["symbol"], "bar_idx": p["bar_idx"], "state": np.array(out, np.int64)})

    return _by_symbol(panel, run, "symbol string, bar_idx long, state long", gaps=True)


def ewma_variance(panel: DataFrame, lam: float = 0.94, warmup: int = 50) -> DataFrame:
    """Variance recursion of log returns, missing ones as 0, that starts from the mean of the first `warmup` squares, or of
    all where there are fewer."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r2 = np.nan_to_num(np.diff(np.log(p["close"].to_numpy(float)), prepend=np.nan)) ** 2
        v = float(r2[:warmup].mean()) if len(r2) >= warmup else float(r2.mean()) or 1e-8
        out = []
        for x in r2.tolist():
            v = lam * v + (1 - lam) * x
            out.append(v)
        return pd.DataFrame({"symbol": p["symbol"], "bar_idx": p["bar_idx"], "variance": np.round(out, 12)})

    return _by_symbol(panel, run, "symbol string, bar_idx long, variance double", gaps=True)


def _wide(p: pd.DataFrame) -> pd.DataFrame:
    """Log returns, bars x symbols; NaN where either close is missing."""
    close = p.groupby(["bar_idx", "symbol"])["close"].mean().unstack("symbol").sort_index()
    return np.log(close.where(close > 0)).diff()


def _across(x: pd.DataFrame) -> pd.DataFrame:
    """Standardised across symbols."""
    sd = x.std(axis=1)
    return x.sub(x.mean(axis=1), axis=0).div(sd.where(sd > 1e-12), axis=0)


def _components(w: np.ndarray) -> np.ndarray | None:
    """Principal directions of a window, the largest loading of each positive; None where there are none."""
    try:
        v = np.linalg.svd(w - w.mean(0), full_matrices=False)[2]
    except np.linalg.LinAlgError:
        return None
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def pca_scores(returns: pd.DataFrame, n: int = 48, k: int = 3, refit: int = 12, lookback: int = 24) -> dict[str, pd.DataFrame]:
    """What pca_signals returns, as frames of bars x symbols. Components are fitted on the n bars before a refit and hold
    until the next one."""
    r = returns.fillna(0.0)
    x = r.to_numpy()
    loading, residual, last = (np.full(x.shape, np.nan) for _ in range(3))
    for t in range(n, len(x), refit):
        if (v := _components(x[t - n : t])) is None:
            continue
        now = slice(t, min(t + refit, len(x)))
        flat = x[now] - x[now].mean(axis=1, keepdims=True)
        loading[now] = v[0]
        residual[now] = flat - flat @ v[:k].T @ v[:k]
    step = max(1, lookback // 8)
    for t in range(lookback, len(x), step):
        w = x[t - lookback : t]
        v = _components(w)
        end = w[-1] - w.mean(0)
        last[t : t + step] = 0.0 if v is None else end @ v[:k].T @ v[:k] - end
    frame = lambda a: pd.DataFrame(a, r.index, r.columns)
    cum = frame(residual).cumsum()
    return {
        "loading": frame(loading),
        "residual": frame(residual),
        "R12": -_across(cum - cum.rolling(n // 2, min_periods=n // 4).mean()),
        "R19": -_across(frame(loading)),
        "f_xcoin_pca_residual": _across(frame(last).where(returns.notna())),
    }


def pca_signals(panel: DataFrame, n: int = 48, k: int = 3, refit: int = 12, lookback: int = 24) -> DataFrame:
    """The signals that need principal components, at all bars of the grid (null before the first refit): loading on the
    first component and residual of the market-neutral return after k; R12, the cumulated residual against its mean, and
    R19, the loading, both faded and standardised across symbols; f_xcoin_pca_residual, the residual of the last bar of
    windows of `lookback` bars, refitted every eighth of it, for symbols that trade.

    The sign of a component is free; here its largest loading is positive. One group: the returns matrix of all symbols,
    bars x symbols."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = {c: x.round(8 if c in ("loading", "residual") else 5).stack(future_stack=True) for c, x in pca_scores(_wide(p), n, k, refit, lookback).items()}
        return pd.DataFrame(out).reset_index()[["symbol", "bar_idx", *out]]

    one = panel.select("symbol", "bar_idx", "close").withColumn("g", F.lit(0))
    return one.groupBy("g").applyInPandas(run, "symbol string, bar_idx long, loading double, residual double, R12 double, R19 double, f_xcoin_pca_residual double")


def spectral_entropy(panel: DataFrame, n: int = 64) -> DataFrame:
    """Shannon entropy of the power spectrum of the trailing n returns."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r = np.diff(np.log(p["close"].to_numpy()), prepend=np.nan)
        out = np.full(len(r), np.nan)
        for i in range(n, len(r)):
            w = r[i - n + 1 : i + 1]
            power = np.abs(np.fft.rfft(w - w.mean())) ** 2
            q = power / power.sum()
            out[i] = -(q[q > 0] * np.log(q[q > 0])).sum()
        return pd.DataFrame({"symbol": p["symbol"], "bar_idx": p["bar_idx"], "entropy": np.round(out, 8)})

    return _by_symbol(panel, run, "symbol string, bar_idx long, entropy double")


def run_length(panel: DataFrame, cap: int = 10) -> DataFrame:
    """Signed length of the present run of moves, 0 on its first bar."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        s = np.sign(np.diff(p["close"].to_numpy(), prepend=p["close"].iloc[0]))
        n, out = 0, []
        for i, v in enumerate(s):
            n = n + 1 if i and v == s[i - 1] else 0
            out.append(max(-cap, min(cap, int(n * v))))
        return pd.DataFrame({"symbol": p["symbol"], "bar_idx": p["bar_idx"], "run": np.array(out, np.int64)})

    return _by_symbol(panel, run, "symbol string, bar_idx long, run long")


def accept_trades(trades: pd.DataFrame, slots: int = 8, cooldown: int = 6) -> pd.DataFrame:
    """Greedy acceptance in order of entry, ties by symbol: a free slot, then the symbol's cooldown."""
    open_until: list[int] = []
    last: dict[str, int] = {}
    keep = []
    for row in trades.sort_values(["i0", "symbol"]).itertuples():
        open_until = [x for x in open_until if x > row.i0]
        ok = len(open_until) < slots and row.i0 >= last.get(row.symbol, -(10**9)) + cooldown
        keep.append(ok)
        if ok:
            open_until.append(row.i1)
            last[row.symbol] = row.i1
    return trades.sort_values(["i0", "symbol"]).loc[np.array(keep, bool)]


def symbol_bootstrap(panel: DataFrame, replicates: int = 200, block: int = 8, seed: int = 5) -> DataFrame:
    """Circular block bootstrap of each symbol's mean return: quantiles and the share at or below zero."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r = np.diff(np.log(p["close"].to_numpy()))
        name = p["symbol"].iloc[0]
        if len(r) < 2:
            return pd.DataFrame({"symbol": [name], "q05": [np.nan], "q95": [np.nan], "below": [np.nan]})
        rng = np.random.default_rng([seed, *name.encode()])
        starts = rng.integers(0, len(r), (replicates, -(-len(r) // block)))
        idx = (starts[:, :, None] + np.arange(block)) % len(r)
        m = r[idx.reshape(replicates, -1)[:, : len(r)]].mean(1)
        return pd.DataFrame({"symbol": [name], "q05": [np.quantile(m, 0.05)], "q95": [np.quantile(m, 0.95)], "below": [(m <= 0).mean()]})

    return _by_symbol(panel, run, "symbol string, q05 double, q95 double, below double")


def overfitting_probability(panel: DataFrame, s: int = 8) -> DataFrame:
    """Combinatorially symmetric cross-validation over symbols as configurations: block sums once, combined per split."""
    n = F.count("r")
    r = panel.selectExpr("symbol", "bar_idx", "ln(close) - lag(ln(close), 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS r").filter("r IS NOT NULL")
    top = panel.agg((F.max("bar_idx") + 1).alias("top"))
    sums = r.crossJoin(F.broadcast(top)).withColumn("block", F.floor(F.col("bar_idx") * s / F.col("top"))).groupBy("symbol", "block").agg(n.alias("n"), F.sum("r").alias("a"), F.sum(F.col("r") * F.col("r")).alias("b"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        cube = {c: p.pivot_table(index="block", columns="symbol", values=c).fillna(0.0).to_numpy() for c in "nab"}
        logits = []
        for half in combinations(range(len(cube["n"])), len(cube["n"]) // 2):
            other = [i for i in range(len(cube["n"])) if i not in half]

            def perf(rows):
                k, a, b = (cube[c][list(rows)].sum(0) for c in "nab")
                var = np.maximum(b / k - (a / k) ** 2, 1e-18)
                return a / k / np.sqrt(var)

            best = int(np.argmax(perf(half)))
            out = perf(other)
            w = ((out < out[best]).sum() + 1) / (len(out) + 1)
            logits.append(np.log(w / (1 - w)))
        return pd.DataFrame({"splits": [len(logits)], "pbo": [float(np.mean(np.array(logits) <= 0))]})

    return sums.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "splits long, pbo double")


def expected_max_sharpe(trials: int, variance: float) -> float:
    """Expected maximum of so many independent trials' Sharpe ratios; 0 for one trial."""
    if trials < 2 or variance <= 0:
        return 0.0
    nd, g = NormalDist(), 0.5772156649015329
    return variance**0.5 * ((1 - g) * nd.inv_cdf(1 - 1 / trials) + g * nd.inv_cdf(1 - 1 / (trials * np.e)))


def deflated_sharpe(panel: DataFrame, trials: int | None = None) -> DataFrame:
    """Probability that a symbol's Sharpe ratio is above the expected maximum of the trials: as many as there are symbols, or
    `trials`, with the symbols' variance of ratios. Moments come from one aggregation."""
    r = panel.selectExpr("symbol", "ln(close) - lag(ln(close), 1) OVER (PARTITION BY symbol ORDER BY bar_idx) AS r")
    m = r.groupBy("symbol").agg(F.count("r").alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("sk"), (F.kurtosis("r") + 3).alias("ku"))
    all_ = m.agg(F.count("sr").alias("__k"), F.coalesce(F.var_samp("sr"), F.lit(0.0)).alias("__v"))

    def run(it):
        for p in it:
            bar = np.array([expected_max_sharpe(int(trials or k), float(v)) for k, v in zip(p["__k"], p["__v"], strict=True)])
            z = (p.sr - bar) * np.sqrt(p.n - 1) / np.sqrt(np.maximum(1 - p.sk * p.sr + (p.ku - 1) / 4 * p.sr**2, 1e-12))
            yield pd.DataFrame({"symbol": p.symbol, "sharpe": p.sr, "dsr": [NormalDist().cdf(x) if x == x else None for x in z]})

    return m.join(F.broadcast(all_)).mapInPandas(run, "symbol string, sharpe double, dsr double")


OPERATORS = {
    f.__name__: f
    for f in (local_level, hysteresis, ewma_variance, pca_signals, spectral_entropy, run_length, symbol_bootstrap, overfitting_probability, deflated_sharpe)
}
