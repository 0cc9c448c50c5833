"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are lifted so that the largest inner product becomes the smallest distance, rotated at random, and cut into groups
of AXES coordinates; each group, shifted, is ordered along a Hilbert curve. Spark range-partitions every ordering. A query is
compared with the rows that stand within `width` places of its own place, in each ordering; the results merge and rerank.

The width is not guessed: for a bounded sample of queries (SAMPLE) the true neighbours are found by one linear scan and
looked up in the orderings, and the width is the smallest at which the sample reaches `recall`. Where vectors have structure
it is narrow; where they have none, as with isotropic noise in many dimensions, no ordering can be narrow, and it comes out
as a share of the table.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._common import Stages

AXES, BITS, ORDERINGS = 8, 7, 8
#: Sampled queries, and vectors from which the scale of each axis is fitted.
SAMPLE, FIT = 128, 4096
#: Rows of an ordering that are scored together.
BLOCK = 4096


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (n, axes) with coordinates of so many bits."""
    x = x.astype(np.int64).T.copy()
    axes = len(x)
    for q in (1 << i for i in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(axes):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, t)
            x[i] ^= t
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << i for i in range(bits - 1, 0, -1)):
        t ^= np.where((x[axes - 1] & q) != 0, q - 1, 0)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _matrix(arr: pa.Array) -> np.ndarray:
    values, off = T.list_at(arr) if not pa.types.is_fixed_size_list(arr.type) else (arr.flatten().to_numpy(zero_copy_only=False), None)
    return values.astype(np.float64).reshape(len(arr), -1) if len(arr) else np.zeros((0, 0))


class Curves:
    """Fitted on a sample: the lift's radius, the rotations, scales and shifts. Small; sent with the tasks."""

    def __init__(self, sample: np.ndarray, radius: float, orderings: int, seed: int):
        d = sample.shape[1] + 1
        self.radius = radius
        self.axes = min(AXES, d)
        rng = np.random.default_rng(seed)
        rows = []
        while len(rows) * self.axes < orderings * self.axes:
            q = np.linalg.qr(rng.standard_normal((d, d)))[0]
            rows += [q[i : i + self.axes] for i in range(0, d - self.axes + 1, self.axes)]
        self.rotations = np.concatenate(rows[:orderings])
        y = self.lift(sample) @ self.rotations.T
        self.low = y.mean(0) - 3.5 * (y.std(0) + 1e-12)
        self.step = 7.0 * (y.std(0) + 1e-12) / (1 << BITS) * 1.25
        self.shift = rng.random(len(self.low)) * 0.2 * (1 << BITS)
        self.orderings = orderings

    def lift(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        if query:
            return np.hstack([v * (self.radius / np.maximum(norm, 1e-300)), np.zeros((len(v), 1))])
        return np.hstack([v, np.sqrt(np.maximum(self.radius**2 - norm**2, 0))])

    def keys(self, v: np.ndarray, query: bool) -> np.ndarray:
        """(orderings, n)"""
        y = (self.lift(v, query) @ self.rotations.T - self.low) / self.step + self.shift
        y = np.clip(y, 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert(y[:, i * self.axes : (i + 1) * self.axes], BITS) for i in range(self.orderings)])


def _orders(batches, curves: Curves):
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            c = b.slice(lo, 4096)
            ids, v, asks = T.ids(c, "vec_id"), _matrix(T.col(c, "v")), T.col(c, "asks").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            rank = T.col(c, "copy").to_numpy()
            col = T.col(c, "v")
            for query in (False, True):
                which = np.flatnonzero(asks if query else rank >= 0)
                if not len(which):
                    continue
                take = pa.array(which)
                for r, key in enumerate(curves.keys(v[which], query)):
                    n = len(which)
                    yield pa.record_batch([pa.array(np.full(n, r, np.int32)), pa.array(key), pa.array(np.full(n, query)), pa.array(ids[which]), col.take(take)], ["r", "key", "query", "vec_id", "v"])


def _number(batches):
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int64)), pa.array(at + np.arange(n))], [*b.schema.names, "part", "at"])
        at += n


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best: largest score, then smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    near = near[np.isfinite(scores[near])]
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _exact(approx: np.ndarray, query: np.ndarray, cands: np.ndarray, ids: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """_top() by row-wise sums, which give equal vectors equal scores wherever they stand; approx, from a matrix product,
    may differ by its place in the block and only preselects, with a margin above its error."""
    near = np.flatnonzero(np.isfinite(approx))
    if len(near) > k:
        margin = 4 * len(query) * np.finfo(float).eps * float(np.linalg.norm(query)) * longest
        kth = np.partition(approx[near], len(near) - k)[len(near) - k]
        near = near[approx[near] >= kth - margin]
    score = (cands[near] * query).sum(axis=1)
    best = _top(score, ids[near], k)
    return near[best], score[best]


def _scan(batches, queries: np.ndarray, own: np.ndarray, k: int):
    """The best of each batch for a few queries."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, v = T.ids(b, "vec_id"), _matrix(T.col(b, "v"))
        s = v @ queries.T
        for j in range(len(own)):
            x = np.where(ids == own[j], -np.inf, s[:, j])
            best = _top(x, ids, k)
            yield pa.record_batch([pa.array(np.full(len(best), own[j])), pa.array(ids[best]), pa.array(x[best])], ["query_id", "vec_id", "score"])


def _windows(batches, width: int, k: int):
    """From rows (r, block, query, rank, vec_id, v) ordered, candidates of a block before its queries."""
    now, ranks, ids, vecs, mat = None, [], [], [], None
    for b in batches:
        if not b.num_rows:
            continue
        r, block, query, rank, vid, v = T.ids(b, "r"), T.ids(b, "block"), T.col(b, "query").to_numpy(zero_copy_only=False), T.ids(b, "rank"), T.ids(b, "vec_id"), _matrix(T.col(b, "v"))
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])]))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(r)], strict=True):
            if now != (r[a], block[a]):
                now, ranks, ids, vecs, mat = (r[a], block[a]), [], [], [], None
            if not query[a]:
                ranks.append(rank[a:z])
                ids.append(vid[a:z])
                vecs.append(v[a:z])
                continue
            if not ranks:
                continue
            if mat is None:
                cv = np.concatenate(vecs)
                mat = np.concatenate(ranks), np.concatenate(ids), cv, float(np.linalg.norm(cv, axis=1).max())
            cr, ci, cv, norms = mat
            for lo in range(a, z, 256):
                hi = min(z, lo + 256)
                s = v[lo:hi] @ cv.T
                s[np.abs(rank[lo:hi, None] - cr[None, :]) > width] = -np.inf
                s[vid[lo:hi, None] == ci[None, :]] = -np.inf
                q_out, i_out, s_out = [], [], []
                for j in range(hi - lo):
                    best, score = _exact(s[j], v[lo + j], cv, ci, k, norms)
                    q_out.append(np.full(len(best), vid[lo + j]))
                    i_out.append(ci[best])
                    s_out.append(score)
                yield pa.record_batch([pa.array(np.concatenate(q_out)), pa.array(np.concatenate(i_out)), pa.array(np.concatenate(s_out))], ["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows whose vector is not null or zero and holds finite numbers only."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~zero)


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, recall: float = 0.96, orderings: int = ORDERINGS, seed: int = 11) -> DataFrame:
    """The k rows of largest inner product for each query: rows whose vec_id is divisible by `every`.

    vectors: vec_id (unique), embedding (array of numbers); other columns are ignored. Each length is a table of its own.
    Returns query_id, rank (from 1), vec_id, score (the inner product in double precision); nearest first, ties to the
    smaller vec_id. A query is no candidate of its own; with fewer candidates than k, all are returned.

    Null ids, null and zero vectors, and those that hold null or numbers that are not finite take no part. Equal vectors:
    only the k + 1 smallest ids can be among the k nearest of any query, so only those are candidates. Rows that repeat a
    vec_id count once. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    st = Stages(spark, "nearest")
    v = st.save(usable(vectors).dropDuplicates(["vec_id"]))
    longest = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    # one row for each length
    facts = v.groupBy(F.size("v").alias("d")).agg(longest.alias("m")).orderBy("d").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, f in enumerate(facts):
        found = _nearest(st, v.filter(F.size("v") == f["d"]), float(f["m"]), k, every, recall, orderings, seed)
        out = out.unionByName(found) if i else found
    return out


def _nearest(st: Stages, v: DataFrame, longest: float, k: int, every: int, recall: float, orderings: int, seed: int) -> DataFrame:
    """nearest() of vectors (vec_id, v) of one length; longest: the greatest norm."""
    spark = v.sparkSession
    # equal vectors: a limit by rank that is applied before the shuffle, too
    w = Window.partitionBy(F.xxhash64("v"), F.xxhash64("v", F.lit(1))).orderBy("vec_id")
    asks = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    first = v.withColumn("copy", F.row_number().over(w)).filter(F.col("copy") <= k + 1)
    cand = st.save(first.select("vec_id", "v", F.col("copy").cast("long").alias("copy")))
    # queries that are no candidates come in with copy -1
    queries = v.filter(asks).join(cand.select("vec_id", "copy"), "vec_id", "left").filter("copy is null").select("vec_id", "v", F.lit(-1).cast("long").alias("copy"))
    rows = cand.unionByName(queries).withColumn("asks", asks)
    fit = cand.orderBy(F.xxhash64("vec_id")).limit(FIT).select("v").toPandas()["v"]
    curves = Curves(np.stack([np.asarray(x, float) for x in fit]), longest, orderings, seed)
    ordered = rows.mapInArrow(partial(_orders, curves=curves), "r int, key long, query boolean, vec_id long, v array<double>")
    ordered = ordered.repartitionByRange("r", "key", "query", "vec_id").sortWithinPartitions("r", "key", "query", "vec_id")
    ordered = st.save(ordered.mapInArrow(_number, "r int, key long, query boolean, vec_id long, v array<double>, part long, at long"))
    # one row for each partition
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for row in sizes:
        starts.append((row["part"], before))
        before += row["n"]
    offset = spark.createDataFrame(starts, "part long, before long")
    ranked = ordered.join(F.broadcast(offset), "part").withColumn("rank", F.col("at") + F.col("before")).drop("at", "before", "part")
    width = _width(st, cand, v.filter(asks), ranked, k, recall)
    block = F.floor(F.col("rank") / BLOCK)
    c = ranked.filter("not query").select("r", block.alias("block"), "query", "rank", "vec_id", "v")
    q = ranked.filter("query").select("r", F.explode(F.sequence(F.floor((F.col("rank") - width) / BLOCK), F.floor((F.col("rank") + width) / BLOCK))).alias("block"), "query", "rank", "vec_id", "v")
    both = c.unionByName(q).repartition("r", "block").sortWithinPartitions("r", "block", "query", "rank")
    found = both.mapInArrow(partial(_windows, width=width, k=k), "query_id long, vec_id long, score double")
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _width(st: Stages, cand: DataFrame, queries: DataFrame, ranked: DataFrame, k: int, recall: float) -> int:
    """The smallest width at which sampled queries find `recall` of their true neighbours."""
    some = queries.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()
    if not len(some):
        return 1
    own = some["vec_id"].to_numpy(np.int64)
    true = _best(cand.mapInArrow(partial(_scan, queries=np.stack([np.asarray(x, float) for x in some["v"]]), own=own, k=k), "query_id long, vec_id long, score double"), k)
    true = st.save(true.select("query_id", "vec_id"))  # SAMPLE * k rows at most
    places = ranked.select("r", "query", "vec_id", "rank")
    a = places.filter("query").join(F.broadcast(true.select(F.col("query_id").alias("vec_id")).distinct()), "vec_id").select("r", F.col("vec_id").alias("query_id"), F.col("rank").alias("qr"))
    b = places.filter("not query").join(F.broadcast(true), "vec_id").select("r", "query_id", "vec_id", F.col("rank").alias("cr"))
    gap = a.join(b, ["r", "query_id"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("qr") - F.col("cr"))).alias("gap"))
    got = gap.agg(F.percentile("gap", recall).alias("w")).first()["w"]
    return max(int(got or 0) + 1, k)  # k places a side hold k candidates, if there are as many
