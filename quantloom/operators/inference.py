"""Cross-validation with purging, serial correlation and power, surrogates, and tests between models."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_N = NormalDist()


def ranked(df: DataFrame, *order: str, parts: int = 32) -> DataFrame:
    """df with __rank, the place of each row from 0 in order of the columns, and __n, the number of rows. Rows are dealt by
    range and numbered in their partitions; only the partitions' counts are summed in one task."""
    d = df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    counts = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("__p")
    base = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"), F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__n"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return d.withColumn("__in", within).join(F.broadcast(base), F.col("__p") == F.col("__q")).withColumn("__rank", F.col("__b") + F.col("__in")).drop("__p", "__q", "__b", "__in")


def split_of(rank: Column, n: Column, k: int) -> Column:
    """Which of k nearly equal parts a rank is in, from 0; the first n % k parts have one more."""
    size, extra = F.floor(n / F.lit(k)), n % F.lit(k)
    edge = extra * (size + 1)
    return F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(extra + F.floor((rank - edge) / F.greatest(size, F.lit(1)))).cast("int")


def _purged(labels: DataFrame, tests: DataFrame, embargo: float, name: str) -> DataFrame:
    """labels with a row for each test set (name, parts, a, b): role is test, purged, embargo or train."""
    gap = F.round(F.lit(embargo) * F.col("__last"))
    d = labels.join(F.broadcast(tests))
    test = F.array_contains("parts", F.col("part"))
    role = F.when(test, "test").when((F.col("i0") <= F.col("b")) & (F.col("a") <= F.col("i1")), "purged").when((F.col("i0") > F.col("b")) & (F.col("i0") <= F.col("b") + gap), "embargo").otherwise("train")
    return d.withColumn("role", role).drop("parts", "part", "__last")


def _parts(labels: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    d = ranked(labels, "i0", "symbol", "i1")
    d = d.withColumn("part", split_of(F.col("__rank"), F.col("__n"), k)).drop("__rank", "__n")
    last = labels.agg(F.max("i1").alias("__last"))
    ends = d.groupBy("part").agg(F.min("i0").alias("a"), F.max("i1").alias("b"))  # k rows
    return d.join(F.broadcast(last)), ends


def purged_kfold(labels: DataFrame, *, splits: int = 5, embargo: float = 0.01) -> DataFrame:
    """labels (symbol, i0, i1, ...; unique by these) once for each fold, with fold and role. Folds are parts in order of i0. Of
    the others, labels that overlap the fold's span are purged, and those that start within embargo * (the last i1) bars
    after it are left out, too."""
    d, ends = _parts(labels, splits)
    return _purged(d, ends.select(F.col("part").alias("fold"), F.array("part").alias("parts"), "a", "b"), embargo, "fold")


def cpcv(labels: DataFrame, *, groups: int = 6, test: int = 2, embargo: float = 0.01) -> DataFrame:
    """Combinatorial purged folds: labels once for each choice of `test` of the groups, with fold (like 0-3) and role."""
    d, ends = _parts(labels, groups)
    choices = F.array(*[F.struct(F.lit("-".join(map(str, c))).alias("fold"), F.array(*map(F.lit, c)).alias("parts")) for c in itertools.combinations(range(groups), test)])
    t = ends.select("a", "b", "part", F.explode(choices).alias("c")).filter(F.array_contains("c.parts", F.col("part")))
    t = t.groupBy(F.col("c.fold").alias("fold"), F.col("c.parts").alias("parts")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return _purged(d, t, embargo, "fold")


def fold_counts(folds: DataFrame) -> DataFrame:
    """A row for each fold: how many labels have each role, and how many of the training ones overlap the test span, which a
    clean split has none of."""
    n = lambda r: F.count(F.when(F.col("role") == r, 1)).alias(r)
    leak = (F.col("role") == "train") & (F.col("i0") <= F.col("b")) & (F.col("a") <= F.col("i1"))
    return folds.groupBy("fold").agg(*[n(r) for r in ("train", "test", "purged", "embargo")], F.count(F.when(leak, 1)).alias("leaked"))


def walk_forward(n: int, train: int, test: int, step: int | None = None) -> Iterator[tuple[range, range]]:
    """Rolling windows of `train` observations and the `test` after them."""
    step = step or test
    for start in range(0, n - train - test + 1, step):
        yield range(start, start + train), range(start + train, start + train + test)


def walk_forward_bars(panel: DataFrame, *, train: int = 104, test: int = 26) -> DataFrame:
    """window, train_from, train_to, test_from, test_to (bar_idx, inclusive) over the panel's bars."""
    ends = panel.agg(F.min("bar_idx").alias("lo"), (F.max("bar_idx") - F.min("bar_idx") + 1).alias("n"))
    k = F.floor((F.col("n") - F.lit(train + test)) / F.lit(test))
    d = ends.filter(k >= 0).select("lo", F.explode(F.sequence(F.lit(0).cast("long"), k)).alias("window"))
    at = F.col("lo") + F.col("window") * F.lit(test)
    return d.select("window", at.alias("train_from"), (at + train - 1).alias("train_to"), (at + train).alias("test_from"), (at + train + test - 1).alias("test_to"))


# power


def required_n_sharpe(target: float, *, alpha: float = 0.05, power: float = 0.8, two_sided: bool = True) -> int | None:
    """Observations that show a Sharpe ratio of `target` a period; None where no number does."""
    if target <= 0:
        return None
    return math.ceil(((_N.inv_cdf(1 - alpha / (2 if two_sided else 1)) + _N.inv_cdf(power)) / target) ** 2)


def required_n_ic(target: float, *, alpha: float = 0.05, power: float = 0.8, two_sided: bool = True) -> int | None:
    """Observations that show a correlation of `target`, by Fisher's z."""
    r = abs(target)
    if not 0 < r < 1:
        return None
    return math.ceil(((_N.inv_cdf(1 - alpha / (2 if two_sided else 1)) + _N.inv_cdf(power)) / math.atanh(r)) ** 2 + 3)


def overlap_deflation(horizon: int, step: int = 1) -> float:
    """Share of independent samples among labels of `horizon` bars taken every `step` bars."""
    return 1.0 if horizon <= 1 else min(1.0, step / horizon)


def autocorr_inflation(series: DataFrame, by: str = "symbol", order: str = "bar_idx", value: str = "r") -> DataFrame:
    """by, n, vif: by how much serial correlation inflates the variance of the mean, with Bartlett weights up to the lag
    ceil(4 (n / 100)^(2/9)), n - 2 at most; 1 for under ten values or a constant. Missing values are skipped."""
    s = series.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, value)))[value].alias("__x"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    s = s.withColumn("n", F.size("__x").cast("long")).withColumn("__m", total(F.col("__x")) / F.col("n"))
    s = s.withColumn("__x", F.transform("__x", lambda v: v - F.col("__m"))).withColumn("__d", total(F.transform("__x", lambda v: v * v)))
    lags = F.least(F.ceil(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))), F.col("n") - 2).cast("int")
    rho = lambda k: total(F.zip_with(F.slice("__x", k + 1, F.size("__x")), F.slice("__x", F.lit(1), F.size("__x") - k), lambda a, b: a * b)) / F.col("__d")
    vif = F.aggregate(F.sequence(F.lit(1), lags), F.lit(1.0), lambda t, k: t + 2 * (1 - k / (lags + 1.0)) * rho(k))
    vif = F.when((F.col("n") < 10) | (F.col("__d") == 0), F.lit(1.0)).otherwise(F.greatest(vif, F.lit(1e-6)))
    return s.select(by, "n", vif.alias("vif"))


def power_verdict(series: DataFrame, *, target: float, horizon: int = 1, step: int = 1, value: str = "r", **test) -> DataFrame:
    """symbol, n, vif, overlap, effective_n, required_n, powered: whether a series is long enough to show `target`."""
    need = required_n_sharpe(target, **test)
    d = autocorr_inflation(series, value=value).withColumn("overlap", F.lit(overlap_deflation(horizon, step)))
    d = d.withColumn("effective_n", F.greatest(F.col("n") * F.col("overlap") / F.col("vif"), F.lit(0.0))).withColumn("required_n", F.lit(need).cast("long"))
    return d.withColumn("powered", F.coalesce(F.col("effective_n") >= F.col("required_n"), F.lit(False)))


# surrogates


def circular_blocks(y: np.ndarray, block: int, rng: np.random.Generator) -> np.ndarray:
    """As many values as y has, in blocks that start anywhere and wrap around."""
    starts = rng.integers(0, len(y), -(-len(y) // block))
    return y[((starts[:, None] + np.arange(block)) % len(y)).ravel()[: len(y)]]


def permuted_blocks(y: np.ndarray, block: int, rng: np.random.Generator) -> np.ndarray:
    """The consecutive blocks of y in random order."""
    n = -(-len(y) // block)
    return np.concatenate([y[i * block : (i + 1) * block] for i in rng.permutation(n)])


def surrogate_threshold(metric: Callable[[np.ndarray, np.ndarray], float], feature, label, *, draws: int = 500, block: int = 24, seed: int = 0, mode: str = "permute") -> dict:
    """The metric of (feature, label) against that of labels shuffled in blocks."""
    rng, x, y = np.random.default_rng(seed), np.asarray(feature, float), np.asarray(label, float)
    shuffle = {"permute": permuted_blocks, "circular": circular_blocks}[mode]
    seen = float(metric(x, y))
    null = np.array([metric(x, shuffle(y, block, rng)) for _ in range(draws)])
    null = null[np.isfinite(null)]
    if not len(null):
        return {"observed": seen, "null_mean": math.nan, "null_std": math.nan, "q95": math.nan, "q99": math.nan, "p_value": 1.0, "clears_noise": False}
    q95, q99 = (float(np.quantile(null, q)) for q in (0.95, 0.99))
    return {"observed": seen, "null_mean": float(null.mean()), "null_std": float(null.std(ddof=1)) if len(null) > 1 else math.nan, "q95": q95, "q99": q99, "p_value": float((np.sum(null >= seen) + 1) / (len(null) + 1)), "clears_noise": seen > q99}


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.corrcoef(x, y)[0, 1]) if len(x) > 2 and x.std() > 0 and y.std() > 0 else math.nan


def surrogates(pairs: DataFrame, *, draws: int = 200, block: int = 8, seed: int = 3, mode: str = "permute") -> DataFrame:
    """pairs: symbol, bar_idx, x, y. For each symbol, the correlation of x and y against block surrogates of y."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values("bar_idx")
        out = surrogate_threshold(_correlation, p.x, p.y, draws=draws, block=block, seed=seed, mode=mode) if len(p) > 2 else {}
        return pd.DataFrame([{k: v for k, v in out.items()}]).assign(symbol=p.symbol.iloc[0])[["symbol", *out]] if out else pd.DataFrame()

    return pairs.select("symbol", "bar_idx", "x", "y").groupBy("symbol").applyInPandas(run, "symbol string, observed double, null_mean double, null_std double, q95 double, q99 double, p_value double, clears_noise boolean")


# between models


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution, to 1e-7: a rational approximation of the tail."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(x))
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = F.lit(0.0)
    for v in reversed(c):
        poly = (poly + F.lit(v)) * t
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def diebold_mariano(losses: DataFrame, *, h: int = 1, by: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """losses: by, order, a, b. For each series: n, mean_diff of a - b, dm_stat with a variance of h - 1 weighted lags, and
    p_value of both sides. Under three values: null; a variance that isn't positive: 0 and 1."""
    w = Window.partitionBy(by).orderBy(order)
    d = losses.withColumn("__d", F.col("a") - F.col("b")).filter(F.col("__d").isNotNull() & ~F.isnan("__d"))
    d = d.withColumn("__x", F.col("__d") - F.avg("__d").over(Window.partitionBy(by)))
    d = d.withColumns({f"__l{k}": F.lag("__x", k).over(w) for k in range(1, h)})
    lrv = F.avg(F.col("__x") * F.col("__x"))
    for k in range(1, h):
        lrv = lrv + F.lit(2 * (1 - k / h)) * F.avg(F.col("__x") * F.col(f"__l{k}"))
    g = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("mean_diff"), lrv.alias("__v"))
    stat = F.when(F.col("n") < 3, F.lit(None).cast("double")).when(F.col("__v") <= 0, 0.0).otherwise(F.col("mean_diff") / F.sqrt(F.col("__v") / F.col("n")))
    g = g.withColumn("dm_stat", stat)
    return g.select(by, "n", "mean_diff", "dm_stat", F.when(F.col("__v") <= 0, 1.0).otherwise(2 * (1 - normal_cdf(F.abs("dm_stat")))).alias("p_value"))


def stationary_bootstrap(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """n indices below n in runs of geometric length, `block` in the mean, that wrap around."""
    new = rng.random(n) < 1.0 / max(block, 1.0)
    new[0] = True
    start = rng.integers(0, n, n)
    at = np.flatnonzero(new)
    run = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return (np.repeat(start[at], np.diff(np.append(at, n))) + run) % n


def spa_test(bench, models, *, draws: int = 1000, block: float = 10.0, seed: int = 0) -> dict:
    """Superior predictive ability, the consistent variant: the chance of the greatest studentised gain over `bench` (losses)
    if no model (a column of `models`) beats it."""
    rng = np.random.default_rng(seed)
    gain = np.asarray(bench, float)[:, None] - np.asarray(models, float)
    t, k = gain.shape
    mean, se = gain.mean(0), gain.std(0, ddof=1) / math.sqrt(t)
    se = np.where(se == 0, np.inf, se)
    best = max(0.0, float((mean / se).max()))
    centre = np.where(mean >= -math.sqrt(2 * math.log(math.log(max(t, 3)))) * se, mean, 0.0)
    hits = sum(float(((gain[stationary_bootstrap(t, block, rng)].mean(0) - centre) / se).max(initial=0.0)) >= best for _ in range(draws))
    return {"spa_p_value": hits / draws, "max_t": best, "n_models": k}


def model_confidence_set(losses, *, alpha: float = 0.1, draws: int = 1000, block: float = 10.0, seed: int = 0) -> dict:
    """The models (columns of losses) that the range statistic does not tell from the best: the worst goes while equal
    ability is rejected. p-values are those of the steps, made monotone; those that stay have 1."""
    rng, x = np.random.default_rng(seed), np.asarray(losses, float)
    t, k = x.shape
    boot = np.stack([x[stationary_bootstrap(t, block, rng)].mean(0) for _ in range(draws)])
    mean, alive, step = x.mean(0), list(range(k)), {}
    while len(alive) > 1:
        m, b = mean[alive], boot[:, alive]
        diff = m[:, None] - m
        noise = (b[:, :, None] - b[:, None, :]) - diff
        sd = np.sqrt(noise.var(0, ddof=1))
        sd[sd == 0] = np.inf
        p = float(np.mean((np.abs(noise) / sd).max((1, 2)) >= (np.abs(diff) / sd).max()))
        worst = alive[int(np.argmax(m))]
        step[worst] = p
        if p > alpha:
            break
        alive.remove(worst)
    top, pvals = 0.0, {}
    for m, p in step.items():
        pvals[m] = top = max(top, p)
    return {"mcs": sorted(alive), "elimination": step, "p_values": pvals | dict.fromkeys(alive, 1.0)}


def compare_models(losses: DataFrame, models: list[str], bench: str, *, draws: int = 300, block: float = 10.0, seed: int = 1) -> DataFrame:
    """losses: symbol, bar_idx, bench and a column for each model. A row for each symbol and model: whether it is in the
    confidence set, its p-value, and the symbol's p-value of superior ability over bench. One symbol's bars go to a task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values("bar_idx")
        if len(p) < 10:
            return pd.DataFrame({"symbol": [], "model": [], "in_set": [], "p_value": [], "spa_p_value": []})
        s = spa_test(p[bench], p[models], draws=draws, block=block, seed=seed)
        c = model_confidence_set(p[models], draws=draws, block=block, seed=seed)
        return pd.DataFrame({"symbol": p.symbol.iloc[0], "model": models, "in_set": [i in c["mcs"] for i in range(len(models))], "p_value": [c["p_values"][i] for i in range(len(models))], "spa_p_value": s["spa_p_value"]})

    return losses.select("symbol", "bar_idx", bench, *models).groupBy("symbol").applyInPandas(run, "symbol string, model string, in_set boolean, p_value double, spa_p_value double")


def expected_max_t(trials: int) -> float:
    """What the greatest of so many independent t statistics without an edge comes to in the mean; 0 for one."""
    if trials < 2:
        return 0.0
    g = 0.5772156649015329
    return (1 - g) * _N.inv_cdf(1 - 1 / trials) + g * _N.inv_cdf(1 - 1 / (trials * math.e))
