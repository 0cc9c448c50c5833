"""Grouping steps shared by the duplicate operators: equal texts, shared keys, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._common import Stages


def classes(sketches: DataFrame, *prints: str) -> DataFrame:
    """doc_id, rep (the smallest id with the same prints) and copies (how many ids): one row for each id. Ids are unique."""
    ids = sketches.select("doc_id", *prints)
    g = ids.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return ids.join(g.hint("merge"), list(prints)).select("doc_id", "rep", "copies")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables that hold whole runs of equal keys, with the runs' first rows (and the end)."""
    kept: list[pa.RecordBatch] = []
    rows, need = 0, 50_000
    for b in batches:
        kept.append(b)
        rows += b.num_rows
        if rows < need:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        first = _firsts(t, keys)
        cut = int(first[-1])
        if cut:
            yield t.slice(0, cut), np.append(first[:-1], cut)
            t = t.slice(cut)
        need = 50_000 if cut else 2 * rows  # a run longer than the buffer: wait until it doubles
        kept, rows = t.to_batches(), t.num_rows
    t = pa.Table.from_batches(kept).combine_chunks() if kept else None
    if t is not None and t.num_rows:
        yield t, np.append(_firsts(t, keys), t.num_rows)


def _firsts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id), ordered by key, whose key has another row."""
    last_key = last_doc = None
    told = False
    for b in batches:
        if not b.num_rows:
            continue
        k, d = T.ids(b, "key"), T.ids(b)
        like_next = np.zeros(len(k), bool)
        like_next[:-1] = k[:-1] == k[1:]
        like_prev = np.zeros(len(k), bool)
        like_prev[1:] = like_next[:-1]
        like_prev[0] = last_key is not None and k[0] == last_key
        head_k, head_d = ([last_key], [last_doc]) if like_prev[0] and not told else ([], [])
        hit = like_next | like_prev
        yield pa.record_batch([pa.array(np.append(np.array(head_k, np.int64), k[hit])), pa.array(np.append(np.array(head_d, np.int64), d[hit]))], ["key", "doc_id"])
        last_key, last_doc, told = k[-1], d[-1], bool(hit[-1])


def shared_keys(sketches: DataFrame, cls: DataFrame | None, st: Stages) -> DataFrame:
    """doc_id, keys: of each document (the first of its class), those of its keys that another one has too.

    sketches: doc_id, keys (array<long>, distinct in a document). Keys are dealt by hash and ordered in the partition, and
    Python sees one batch at a time, so that no group of a key is ever held.
    """
    s = sketches.select("doc_id", "keys").filter(F.size("keys") > 0)
    if cls is not None:
        s = s.join(cls.filter("doc_id = rep").select("doc_id").hint("merge"), "doc_id")
    rows = s.select(F.explode("keys").alias("key"), "doc_id").repartition("key").sortWithinPartitions("key")
    hit = rows.mapInArrow(_shared, "key long, doc_id long")
    return st.save(hit.groupBy("doc_id").agg(F.array_distinct(F.collect_list("key")).alias("keys")))


def components(edges: DataFrame, st: Stages) -> DataFrame:
    """v, component (smallest id reachable) for each id in edges (a, b), by alternating large and small stars."""
    e = st.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = st.save(small.filter("a <> b").distinct())
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        st.drop(e)
        e = new
        if now == mark:
            break
        mark = now
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "v").unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())


