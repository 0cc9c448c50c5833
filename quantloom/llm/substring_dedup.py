"""Substring dedup by difference-cover anchors.

D = {0, 1, 3, 9} is a difference cover modulo 13: any difference of two places is a difference of two members. So wherever
a run of words starts in two texts, some place less than 13 words on is at a cover position of both. Only the anchors, short
runs of words at cover positions, are hashed and dealt over the cluster; a match of `window` words always contains an
anchor that both places share. Windows that contain a shared anchor are then extended to the whole window and compared by
128-bit hashes over the cluster; within a text, the windows found are looked up again by 64 of those bits.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import _text as T
from ._common import Stages, numbered
from ._groups import classes, shared_keys

U = np.uint64
# A perfect difference cover modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
_AT_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(w: T.Words, window: int) -> np.ndarray:
    return w.grams(window - PERIOD + 1)


def _places(n: int, window: int) -> np.ndarray:
    """Cover positions of a text of n words at which an anchor fits."""
    at = np.arange(max(0, n - (window - PERIOD)))
    return at[_AT_COVER[at % PERIOD]]


def _sketch(batches, window: int):
    for b in T.pieces(batches):
        w = T.Words(T.col(b, "text"))
        g = _anchors(w, window)
        f1, f2 = w.fingerprints()
        keys = [np.unique(g[a + _places(z - a, window)]) if z - a >= window else np.zeros(0, U) for a, z in w.texts()]
        yield pa.record_batch([T.ints(T.ids(b)), pa.array(w.n), T.ints(f1), T.ints(f2), T.longs(keys)], ["doc_id", "n", "f1", "f2", "keys"])


def _windows(w: T.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return w.grams(window, 0), w.grams(window, 1)


def _candidates(batches, window: int):
    """(w1, w2, doc_id) of each distinct window of a text that contains one of its shared anchors."""
    for b in T.pieces(batches):
        w = T.Words(T.col(b, "text"))
        g, (h1, h2) = _anchors(w, window), _windows(w, window)
        shared, off = T.list_at(T.col(b, "keys"))
        shared = shared.view(U)
        docs, out1, out2, out_d = T.ids(b), [], [], []
        for i, (a, z) in enumerate(w.texts()):
            m = z - a - window + 1
            if m <= 0:
                continue
            at = _places(z - a, window)
            hit = np.zeros(z - a + 1, np.int64)
            hit[1 + at[np.isin(g[a + at], shared[off[i] : off[i + 1]])]] = 1
            run = np.cumsum(hit)
            # an anchor fits into the windows that start up to PERIOD - 1 words before it
            ok = np.flatnonzero(run[PERIOD : PERIOD + m] > run[:m])
            _, first = np.unique(h1[a + ok], return_index=True)
            ok = ok[first]
            out1.append(h1[a + ok])
            out2.append(h2[a + ok])
            out_d.append(np.full(len(ok), docs[i]))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        yield pa.record_batch([T.ints(cat(out1, U)), T.ints(cat(out2, U)), T.ints(cat(out_d, np.int64))], ["w1", "w2", "doc_id"])


def _later(batches):
    """From rows (w1, w2, doc_id) in order: those whose window another text has before."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        a, c, d = T.ids(b, "w1"), T.ids(b, "w2"), T.ids(b)
        same = np.zeros(len(a), bool)
        same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        same[0] = last == (a[0], c[0])
        last = (a[-1], c[-1])
        yield pa.record_batch([pa.array(d[same]), pa.array(a[same])], ["doc_id", "w1"])


def _remove(batches, window: int):
    for b in T.pieces(batches):
        arr = T.col(b, "text")
        w = T.Words(arr)
        h1, _ = _windows(w, window)
        seen, off = T.list_at(T.col(b, "keys"))
        seen = seen.view(U)
        copy = T.col(b, "copy").to_numpy(zero_copy_only=False)
        n_removed, shas, kept_texts = [], [], []
        blank = w.data.tobytes()
        starts, ends = w.start, w.end
        for i, (a, z) in enumerate(w.texts()):
            n, m = z - a, z - a - window + 1
            gone = np.zeros(n, bool)
            if m > 0 and copy[i]:
                gone[:] = True
            elif m > 0:
                h = h1[a : a + m]
                _, first = np.unique(h, return_index=True)
                bad = np.ones(m, bool)
                bad[first] = False
                if off[i + 1] > off[i]:
                    bad |= np.isin(h, seen[off[i] : off[i + 1]])
                if bad.any():
                    edge = np.zeros(n + 1, np.int64)
                    at = np.flatnonzero(bad)
                    edge[at] += 1
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:n]) > 0
            keep = a + np.flatnonzero(~gone)
            text = b" ".join([blank[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
            n_removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(text).hexdigest())
            kept_texts.append(text.decode("utf-8") if n_removed[-1] else None)
        yield pa.RecordBatch.from_arrays(
            [T.col(b, "rest"), arr, pa.array(w.n), pa.array(n_removed, pa.int64()), pa.array(shas), pa.array(kept_texts, pa.string())],
            ["rest", "text", "n_words", "n_removed", "kept_sha256", "kept_words"],
        )


def substring_dedup(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """Removes words covered by a run of `window` words that also starts earlier (smaller doc_id, or before in the text).

    docs: doc_id, text and any other columns. Words are runs of [^\\x20\\x09-\\x0D], unchanged. Windows are judged on the
    input, not on what is left. Returns rest (a struct of all columns of docs except text), text, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and kept_words (that text, null where nothing was removed).

    Null and empty texts have no words; texts shorter than the window lose nothing; a text is held whole in one task, however
    long. A null doc_id comes last in order. Rows that repeat a doc_id are documents of their own, in order of a hash of
    their texts. Of equal places the first in this order stays. window is 14 at least. An empty table gives an empty result.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be above {PERIOD}")
    st = Stages(docs.sparkSession, "substrings")
    docs, _ = numbered(docs, st)
    texts = docs.select(F.col("__doc").alias("doc_id"), "text")
    sk = st.save(texts.mapInArrow(partial(_sketch, window=window), "doc_id long, n long, f1 long, f2 long, keys array<long>"))
    cls = st.save(classes(sk.filter(F.col("n") >= window), "n", "f1", "f2"))
    shared = shared_keys(sk, cls, st)
    st.drop(sk)
    found = texts.join(shared.hint("merge"), "doc_id").mapInArrow(partial(_candidates, window=window), "w1 long, w2 long, doc_id long")
    later = found.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "doc_id").mapInArrow(_later, "doc_id long, w1 long")
    later = later.groupBy("doc_id").agg(F.array_distinct(F.collect_list("w1")).alias("keys"))
    marks = later.join(cls.filter("doc_id <> rep").select("doc_id", F.lit(True).alias("copy")).hint("merge"), "doc_id", "full")
    marks = st.save(marks.select(F.col("doc_id").alias("__id"), "keys", F.coalesce("copy", F.lit(False)).alias("copy")))
    st.drop(shared)
    rows = docs.join(marks.hint("merge"), F.col("__doc") == F.col("__id"), "left")
    rows = rows.select("rest", "text", "keys", F.coalesce("copy", F.lit(False)).alias("copy"))
    schema = ST.StructType([rows.schema["rest"], ST.StructField("text", ST.StringType())]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_words", "string")
    return rows.mapInArrow(partial(_remove, window=window), schema)


def dedup_digests(docs: DataFrame, *, window: int = 20) -> DataFrame:
    d = substring_dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window=window)
    return d.select(F.col("rest.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
