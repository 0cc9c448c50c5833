"""Suffix-array dedup of bytes.

Texts with a byte run in common share content anchors: the minimal hash of GRAM bytes in each stretch of STRETCH places.
Only windows (runs of `length` bytes) all of whose inner anchors occur elsewhere can repeat; such windows go, as slices of text,
to the group of their smallest anchor, which equal windows share. A group's distinct slices, in order of their first place, get
one suffix array, by prefix doubling up to `length` bytes. In its order, the previous and next smaller position of each place
are found, and the longer common prefix with either is the place's longest previous factor. Where it reaches the length,
the place has an earlier match, the position that gave it: `keep="first"` removes the place and leaves the match,
`keep="none"` removes both.

Before that, texts that are equal, and equal slices of a group, are counted and stand for one. A group above HOT_BYTES of
slices (an anchor that very many texts share, or a long periodic text) does not fit into one array: its windows are dealt
over the cluster by 128-bit hashes and matched there, with the same result.
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
from ._groups import classes, runs, shared_keys

U = np.uint64
GRAM, STRETCH = 32, 96
#: Bytes of slices of one group above which its windows are dealt by their hashes.
HOT_BYTES = 8 << 20
#: Bytes of a slice that are hashed at once.
PRINT_BYTES = 1 << 20
#: Bytes of distinct slices that share one suffix array.
ARRAY_BYTES = 1 << 20


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w consecutive values."""
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: -(w - size)], x[w - size :]) if w > size else x


def _anchor_mask(h: np.ndarray) -> np.ndarray:
    low = _slide(h, STRETCH, np.minimum)
    pad = np.zeros(STRETCH - 1, U)
    return _slide(np.concatenate([pad, low, pad]), STRETCH, np.maximum) == h


def _hashes(data: np.ndarray, k: int, base: int) -> np.ndarray:
    p = T.prefix(data + U(1), base)
    at = np.arange(len(data) - k + 1)
    return T.spans(p, at, at + k, base)


def _sketch(batches, length: int):
    for b in T.pieces(batches):
        data, off = T.raw(T.col(b, "text"))
        n, keys, again = np.diff(off), [], []
        f1, f2 = T.digests([data[a:z].tobytes() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        for i, m in enumerate(n.tolist()):
            if m < length:
                keys.append(np.zeros(0, U))
                again.append(False)
                continue
            h = _hashes(data[off[i] : off[i + 1]], GRAM, T.BASES[0])
            own = h[_anchor_mask(h)]
            one = np.unique(own)
            keys.append(one)
            again.append(len(one) < len(own))
        yield pa.record_batch([T.ints(T.ids(b)), pa.array(n), T.ints(f1), T.ints(f2), T.longs(keys), pa.array(again)], ["doc_id", "n", "f1", "f2", "keys", "again"])


def _slices(batches, length: int):
    """Runs of windows with one smallest anchor, all of whose anchors occur elsewhere."""
    reach = length - GRAM + 1
    for b in T.pieces(batches):
        data, off = T.raw(T.col(b, "text"))
        shared, koff = T.list_at(T.col(b, "keys"))
        shared = shared.view(U)
        docs = T.ids(b)
        out = [], [], [], [], [], []
        for i in range(b.num_rows):
            text = data[off[i] : off[i + 1]]
            if len(text) < length:
                continue
            h = _hashes(text, GRAM, T.BASES[0])
            at = np.flatnonzero(_anchor_mask(h))
            own = h[at]
            _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
            alone = np.zeros(len(h) + 1, np.int64)
            alone[at + 1] = ~(np.isin(own, shared[koff[i] : koff[i + 1]]) | (count[inverse] > 1))
            alone = np.cumsum(alone)
            m = len(text) - length + 1
            # anchors nearer to a window's end depend on what stands beyond it
            ok = alone[reach - STRETCH + 1 : reach - STRETCH + 1 + m] == alone[STRETCH - 1 : STRETCH - 1 + m]
            if not ok.any():
                continue
            low = _slide(h, reach, np.minimum)
            cut = np.flatnonzero(np.concatenate([[True], (ok[1:] != ok[:-1]) | (low[1:] != low[:-1])]))
            for s, e in zip(cut.tolist(), np.append(cut[1:], m).tolist(), strict=True):
                if ok[s]:
                    k = low[s]
                    out[0].append(int(k.view(np.int64)))
                    out[1].append(int(docs[i]))
                    out[2].append(s)
                    out[3].append(e - s)
                    out[4].append(int(np.count_nonzero(h[s : e - 1 + reach] == k)) > 1)
                    out[5].append(text[s : e - 1 + length].tobytes())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["key", "doc_id", "start", "n", "ties", "slice"])


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(depth, rank of each place as far as so many bytes go) for depths from 8, doubling, to length: equal ranks are places
    with a common prefix of that depth, and the last ranks are the suffix order as far as `length` bytes go."""
    n = len(data) - 7
    x = np.zeros(n, U)
    for j in range(8):
        x = (x << U(8)) | data[j : j + n].astype(U)
    _, r = np.unique(x, return_inverse=True)
    out, have = [(8, r.astype(np.int32))], 8
    while have < length:
        step = min(have, length - have)
        key = (r[:-step].astype(U) << U(32)) | r[step:].astype(U)
        _, r = np.unique(key, return_inverse=True)
        have += step
        out.append((have, r.astype(np.int32)))
    return out


def _previous_smaller(a: np.ndarray) -> np.ndarray:
    """For each entry of distinct values, the index of the nearest smaller one before it, or -1, by pointer jumping: all
    entries between an entry and its pointer are greater, so a pointer to a greater entry may jump on along that one's."""
    p = np.arange(len(a)) - 1
    todo = np.flatnonzero(p >= 0)
    while len(todo):
        todo = todo[a[p[todo]] > a[todo]]
        p[todo] = p[p[todo]]
        todo = todo[p[todo] >= 0]
    return p


def _common_prefix(ranks: list[tuple[int, np.ndarray]], data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at x and y have in common, `length` at most."""
    n = np.zeros(len(x), np.int64)
    for depth, r in reversed(ranks):
        i, j = x + n, y + n
        inside = np.maximum(i, j) < len(r)
        same = np.zeros(len(x), bool)
        same[inside] = r[i[inside]] == r[j[inside]]
        n += np.where(same & (n < length), depth, 0)
    for _ in range(7):
        i, j = x + n, y + n
        inside = np.maximum(i, j) < len(data)
        same = np.zeros(len(x), bool)
        same[inside] = data[i[inside]] == data[j[inside]]
        n += same
    return np.minimum(n, length)


def longest_previous_factor(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places `at` (ascending): the longest common prefix with an earlier one of them, `length` at most, and which
    (index into `at`; -1: none). Only the previous and the next smaller position in suffix order can give it."""
    ranks = suffix_ranks(data, length)
    last = ranks[-1][1][at]
    order = np.argsort(last, kind="stable")  # ties in order of place
    before = _previous_smaller(order)
    after = len(order) - 1 - _previous_smaller(order[::-1])[::-1]
    best, source = np.zeros(len(at), np.int64), np.full(len(at), -1)
    for near in (before, after):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        mine, other = order[ok], order[near[ok]]
        n = _common_prefix(ranks, data, at[mine], at[other], length)
        longer = n > best[mine]
        best[mine[longer]], source[mine[longer]] = n[longer], other[longer]
    return best, source


def _repeats(slices: list[bytes], counts: list[int], ns: list[int], length: int, keep: str) -> list[np.ndarray]:
    """For distinct slices in order of their first places: which of their windows go, in their first place."""
    data = np.frombuffer(b"".join(slices), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in slices])])
    at = np.concatenate([begin[i] + np.arange(ns[i]) for i in range(len(slices))])
    factor, source = longest_previous_factor(data, at, length)
    hit = factor >= length
    if keep == "none":
        hit[source[hit]] = True
    out, p = [], 0
    for n, c in zip(ns, counts, strict=True):
        out.append(np.ones(n, bool) if c > 1 and keep == "none" else hit[p : p + n])
        p += n
    return out


def _spans_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _arrays(batches, length: int, keep: str):
    """From slices ordered by key: (doc_id, span) with span = start << 32 | number of windows that go."""
    for t, first in runs(batches, ["key"]):
        key_docs, starts = t.column("doc_id").to_numpy(), t.column("start").to_numpy()
        ties = t.column("ties").to_numpy()
        content = t.column("slice").combine_chunks()
        out_d, out_s = [], []
        todo: list[tuple[bytes, int, list[int]]] = []
        size = 0

        def add(i: int, a: int, n: int, key_docs=key_docs, starts=starts, out_d=out_d, out_s=out_s):
            out_d.append(key_docs[i])
            out_s.append(((starts[i] + a) << 32) | n)

        def settle(todo=todo, add=add):
            ns = [len(x) - length + 1 for x, _, _ in todo]
            hits = _repeats([x for x, _, _ in todo], [c for _, c, _ in todo], ns, length, keep)
            for (_, _, rows), n, hit in zip(todo, ns, hits, strict=True):
                for a, z in zip(*_spans_of(hit), strict=True):
                    for i in rows if keep == "none" else rows[:1]:
                        add(i, a, z - a)
                if keep == "first":
                    for i in rows[1:]:
                        add(i, 0, n)
            todo.clear()

        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a == 1 and not ties[a]:
                continue
            same: dict[bytes, list[int]] = {}
            for i in range(a, z):
                same.setdefault(content[i].as_py(), []).append(i)
            for x, rows in same.items():
                todo.append((x, len(rows), rows))
                size += len(x)
            if size >= ARRAY_BYTES:
                settle()
                size = 0
        if todo:
            settle()
        yield pa.record_batch([pa.array(np.array(out_d, np.int64)), pa.array(np.array(out_s, np.int64))], ["doc_id", "span"])


def _prints(batches, length: int):
    for b in batches:
        docs, starts = T.ids(b), T.ids(b, "start")
        for i, x in enumerate(T.col(b, "slice").to_pylist()):
            data = np.frombuffer(x, np.uint8)
            for a in range(0, len(data) - length + 1, PRINT_BYTES):
                part = data[a : a + PRINT_BYTES + length - 1]
                w1, w2 = (T.window_hashes(part, length, seed) for seed in (1, 2))
                yield pa.record_batch([T.ints(w1), T.ints(w2), pa.array(np.full(len(w1), docs[i])), pa.array(starts[i] + a + np.arange(len(w1)))], ["w1", "w2", "doc_id", "start"])


def _twice(batches, keep: str):
    """From windows in order of their hashes and places: spans of one window that go."""
    for t, first in _pairs(batches):
        size = np.diff(first)
        hit = np.repeat(size, size) > 1
        if keep == "first":
            hit[first[:-1]] = False
        yield pa.record_batch([pa.array(t[2][hit]), pa.array((t[3][hit] << 32) | 1)], ["doc_id", "span"])


def _pairs(batches):
    """Batches with the row before and after the border kept, so that runs of two and more are seen; memory is one batch."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [T.ids(b, c) for c in ("w1", "w2", "doc_id", "start")]
        if last is not None:
            cols = [np.append(x, y) for x, y in zip(last, cols, strict=True)]
        same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        first = np.append(0, 1 + np.flatnonzero(~same))
        yield cols, np.append(first, len(cols[0]))
        last = [x[-1:] for x in cols]


def _remove(batches, length: int):
    for b in T.pieces(batches):
        arr = T.col(b, "text")
        data, off = T.raw(arr)
        span, soff = T.list_at(T.col(b, "spans"))
        whole = T.col(b, "copy").to_numpy(zero_copy_only=False)
        n_removed, n_spans, shas, kept_texts = [], [], [], []
        for i in range(b.num_rows):
            text = data[off[i] : off[i + 1]]
            n = len(text)
            if whole[i] and n >= length:
                gone, k, runs_n = np.ones(n, bool), n, 1
            else:
                s = span[soff[i] : soff[i + 1]]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, s >> 32, 1)
                np.add.at(edge, (s >> 32) + (s & 0xFFFFFFFF) - 1 + length, -1)
                gone = np.cumsum(edge[:n]) > 0
                k, runs_n = int(gone.sum()), len(_spans_of(gone)[0])
            left = text[~gone].tobytes() if k else text.tobytes()
            n_removed.append(k)
            n_spans.append(runs_n)
            shas.append(hashlib.sha256(left).hexdigest())
            kept_texts.append(left if k else None)
        yield pa.RecordBatch.from_arrays(
            [T.col(b, "rest"), arr, pa.array(np.diff(off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.binary())],
            ["rest", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
        )


def suffix_dedup(docs: DataFrame, *, length: int = 400, keep: str = "none", hot: int = HOT_BYTES) -> DataFrame:
    """Removes bytes covered by a run of `length` bytes that also starts elsewhere.

    docs: doc_id, text and any other columns; texts are UTF-8 bytes (null: empty) and matches stay within a text. With
    keep="none" every such byte goes; with keep="first" the place with the smallest doc_id, then start, stays. Runs are
    judged on the input, not on what is left. Returns rest (a struct of the other columns), text, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and kept_bytes (null where nothing was removed).

    Empty, null and short texts lose nothing; a text is held whole in one task, however long. Rows that repeat a doc_id are
    documents of their own, in order of a hash of their texts; a null doc_id comes last. length is at least GRAM + 3 *
    STRETCH. Equal texts (by a 128-bit digest) are one class, of which only the first takes part. An empty table gives an
    empty result. hot bounds the bytes that one suffix array holds and does not change the result.
    """
    if length < GRAM + 3 * STRETCH:
        raise ValueError(f"length must be {GRAM + 3 * STRETCH} at least")
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    st = Stages(docs.sparkSession, "suffixes")
    docs, _ = numbered(docs, st)
    texts = docs.select(F.col("__doc").alias("doc_id"), "text")
    sk = st.save(texts.mapInArrow(partial(_sketch, length=length), "doc_id long, n long, f1 long, f2 long, keys array<long>, again boolean"))
    cls = st.save(classes(sk.filter(F.col("n") >= length), "n", "f1", "f2"))
    shared = shared_keys(sk, cls, st)
    reps = cls.filter("doc_id = rep").select("doc_id")
    need = st.save(shared.join(sk.filter("again").select("doc_id").join(reps.hint("merge"), "doc_id").hint("merge"), "doc_id", "full"))
    st.drop(sk, shared)
    cut = st.save(texts.join(need.hint("merge"), "doc_id").mapInArrow(partial(_slices, length=length), "key long, doc_id long, start long, n long, ties boolean, slice binary"))
    large = st.save(cut.groupBy("key").agg(F.sum(F.length("slice")).alias("c")).filter(F.col("c") > hot).select("key"))
    warm, hot_spans = cut, None
    if not large.isEmpty():
        # keys above the bound: there are at most the table's bytes / hot of them
        warm = cut.join(large, "key", "left_anti")
        prints = cut.join(large, "key", "left_semi").select("doc_id", "start", "slice").mapInArrow(partial(_prints, length=length), "w1 long, w2 long, doc_id long, start long")
        hot_spans = prints.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "doc_id", "start").mapInArrow(partial(_twice, keep=keep), "doc_id long, span long")
    grouped = warm.repartition("key").sortWithinPartitions("key", "doc_id", "start")
    spans = grouped.mapInArrow(partial(_arrays, length=length, keep=keep), "doc_id long, span long")
    if hot_spans is not None:
        spans = spans.unionByName(hot_spans)
    spans = spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    copies = cls.filter("copies > 1" if keep == "none" else "doc_id <> rep").select("doc_id", F.lit(True).alias("copy"))
    marks = st.save(spans.join(copies.hint("merge"), "doc_id", "full").select(F.col("doc_id").alias("__id"), "spans", F.coalesce("copy", F.lit(False)).alias("copy")))
    st.drop(cut, need)
    rows = docs.join(marks.hint("merge"), F.col("__doc") == F.col("__id"), "left")
    rows = rows.select("rest", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    schema = ST.StructType([rows.schema["rest"], ST.StructField("text", ST.StringType())]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept_bytes", "binary")
    return rows.mapInArrow(partial(_remove, length=length), schema)


def dedup_digests(docs: DataFrame, *, length: int = 400, **options) -> DataFrame:
    d = suffix_dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length=length, **options)
    return d.select(F.col("rest.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
