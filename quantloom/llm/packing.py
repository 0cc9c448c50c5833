"""Best-fit packing of token sequences by a configuration linear program.

The program has a variable for each way to fill a sequence (a configuration) and a row for each length in the histogram
(at most `capacity` rows, however many documents there are): the fewest sequences that cover every length's count. It is
solved by multiplicative weights. Each round, a knapsack dynamic program over the capacity prices configurations, one for
each length that it must hold; as many sequences as the pieces are worth at these prices are dealt over them, and a length's
price is multiplied down by its cover of the round above its count and up by what it lacks. The rounds' mean is the
fractional solution; the prices give a bound that no packing can beat: their value of all pieces over that of the
dearest configuration.

Rounding takes the whole part of each configuration's sequences. What the fractions leave is placed at the prices of the best
bound, still multiplied by what remains of each length: the dearest configurations that hold the longest and the most
frequent pieces that remain, from one knapsack table a round, each as often as half of these pieces allows; then the
last by best fit on the histogram. Pieces find their place by
(length, rank).
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._common import Stages, id_in, id_out

CAPACITY = 2048


def vocabulary() -> str:
    """The file of the byte_bpe_50k vocabulary; its ranks stand beside it, with the suffix .tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Encoder:
    """The ids of tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False). Texts that hold none of its
    added tokens are encoded from the same vocabulary's ranks, which is faster and gives the same ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids, little-endian."""
        if any(x in text for x in self.added):
            out = array("I", self.whole.encode(text, add_special_tokens=False).ids)
        else:
            out = array("I", self.fast(text))
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _tokenize(batches, path: str, capacity: int, end: int):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    enc, tail = _encoder(path), np.array([end], "<u4").tobytes()
    for b in T.pieces(batches):
        docs = T.ids(b)
        out = [], [], [], [], [], []
        for i, text in enumerate(T.col(b, "text").to_pylist()):
            ids = enc.ids(text or "") + tail
            n = len(ids) // 4
            start, piece = 0, 0
            while start < n:
                size = (n % capacity or capacity) if not start else capacity
                for o, v in zip(out, (docs[i], piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), seen[size]), strict=True):
                    o.append(int(v))
                seen[size] += 1
                start += size
                piece += 1
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]], pa.array(np.full(len(out[0]), part))], ["doc_id", "piece", "start", "length", "ids_crc32", "k", "part"])


class Plan:
    """configurations: (number of sequences, {length: how many in each}); bound: sequences that any packing needs."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.configurations: list[tuple[int, dict[int, int]]] = []
        self.bound = 0.0
        self.lp = 0.0

    @property
    def sequences(self) -> int:
        return sum(x for x, _ in self.configurations)

    def slots(self) -> tuple[np.ndarray, ...]:
        """For each length and configuration, ordered: length << 40 | first rank, pieces in a sequence, first sequence, first offset."""
        rank: dict[int, int] = {}
        rows, first = [], 0
        for times, config in self.configurations:
            offset = 0
            for length, c in sorted(config.items(), reverse=True):
                rows.append((length << 40 | rank.get(length, 0), c, first, offset))
                rank[length] = rank.get(length, 0) + c * times
                offset += length * c
            first += times
        rows.sort()
        return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True))


def _table(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack: best value for each capacity, and the length last put in (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        if m := fit[c]:
            v = best[c - lengths[:m]] + price[:m]
            j = int(v.argmax())
            if v[j] > best[c - 1]:
                best[c], last[c] = v[j], j
                continue
        best[c], last[c] = best[c - 1], -1
    return best, last


def _oracle(lengths: np.ndarray, last: np.ndarray, capacity: int) -> np.ndarray:
    """For each length, the counts of the dearest configuration that holds it."""
    m = len(lengths)
    step = np.arange(capacity + 1)  # the largest capacity up to each where the table puts something in
    step = np.maximum.accumulate(np.where(last >= 0, step, 0))
    room, out = step[capacity - lengths], np.eye(m, dtype=np.int32)
    live = np.flatnonzero(room > 0)
    while len(live):
        j = last[room[live]]
        out[live, j] += 1
        room[live] = step[room[live] - lengths[j]]
        live = live[room[live] > 0]
    return out


def relax(lengths: np.ndarray, counts: np.ndarray, capacity: int, *, rounds: int = 16, eta: float = 0.25, gap: float = 0.002) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, float]:
    """The covering program by multiplicative weights: (configurations as places and counts, sequences of each, prices, bound). It ends when the mean
    solution is within `gap` of the bound and what it lacks below `gap` of the pieces' volume, or after `rounds`."""
    volume = float(lengths @ counts)
    price = lengths / capacity
    total, bound, used = np.zeros(len(lengths)), 0.0, 0.0
    mean: dict[tuple[bytes, bytes], float] = {}
    for t in range(1, rounds + 1):
        best, last = _table(lengths, price, capacity)
        if (b := float(price @ counts) / best[capacity]) > bound:
            bound, dual = b, price.copy()
        configs = _oracle(lengths, last, capacity)
        held = configs.astype(np.float32)
        x = counts * price
        # what they hold is worth what there is, and as much
        x *= max(float(price @ counts) / float(x @ (held @ price)), volume / float(x @ (held @ lengths)))
        cover = (x @ held) / counts
        total += cover
        used += float(x.sum())
        price = price * np.exp(-eta * np.clip(cover - 1, -1, 1))
        price /= price.max()
        rows, at = np.nonzero(configs)
        values, edge = configs[rows, at].astype(np.int32), np.searchsorted(rows, np.arange(1, len(lengths)))
        for i, (c, v) in enumerate(zip(np.split(at.astype(np.int32), edge), np.split(values, edge), strict=True)):
            key = c.tobytes(), v.tobytes()
            mean[key] = mean.get(key, 0.0) + float(x[i])
        lacks = float((np.maximum(0, 1 - total / t) * counts) @ lengths)
        if lacks < gap * volume and used / t < (1 + gap) * bound:
            break
    configs = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.int32)) for c, v in mean]
    return configs, np.array(list(mean.values())) / t, dual, bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, **options) -> Plan:
    """A plan for a histogram of lengths from 1 to capacity."""
    plan = Plan(capacity)
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    if full := left.pop(capacity, 0):
        plan.configurations.append((full, {capacity: 1}))
        plan.bound = plan.lp = float(full)
    if not left:
        return plan
    lengths = np.array(list(left), np.int64)
    counts = np.array(list(left.values()), np.int64)
    rem = counts.copy()

    def take(at: np.ndarray, c: np.ndarray, times: int) -> None:
        plan.configurations.append((times, dict(zip(lengths[at].tolist(), c.tolist(), strict=True))))
        rem[at] -= c * times

    configs, x, price, bound = relax(lengths, counts, capacity, **options)
    plan.bound += bound
    plan.lp += float(x.sum())
    for i in np.flatnonzero(x >= 1).tolist():
        at, c = configs[i]
        if times := min(int(x[i]), int((rem[at] // c).min())):
            take(at, c, times)

    def best_fit(config: np.ndarray) -> None:
        """Fills a configuration with the largest lengths that remain."""
        room = capacity - int(config @ lengths)
        j = len(lengths)
        while room and (j := min(j, int(np.searchsorted(lengths, room, "right"))) - 1) >= 0:
            n = min(room // int(lengths[j]), int(rem[j] - config[j]))
            config[j] += n
            room -= n * int(lengths[j])

    for _ in range(400):
        some = np.flatnonzero(rem)
        if not len(some):
            break
        _, last = _table(lengths[some], price[some] * np.exp(0.01 * (rem[some] / counts[some] - 1)), capacity)
        wanted = _oracle(lengths[some], last, capacity)
        share = max(1, len(some) // 8)
        seeds = np.unique(np.append(np.arange(len(some) - share, len(some)), np.argsort(-rem[some])[:share]))[::-1]
        for i in seeds.tolist():
            if not rem[some[i]]:
                continue
            config = np.zeros(len(lengths), np.int64)
            config[some] = np.minimum(wanted[i], rem[some])
            best_fit(config)
            at = np.flatnonzero(config)
            take(at, config[at], max(1, int((rem[at] // config[at]).min()) // 2))
    while rem.any():
        config = np.zeros(len(lengths), np.int64)
        best_fit(config)
        at = np.flatnonzero(config)
        take(at, config[at], int((rem[at] // config[at]).min()))
    return plan


def _place(batches, slots):
    at, c, first, offset = slots
    for b in batches:
        length, rank = T.ids(b, "length"), T.ids(b, "rank")
        j = np.searchsorted(at, (length << 40) | rank, "right") - 1
        r = rank - (at[j] & ((1 << 40) - 1))
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch([*[T.col(b, n) for n in names], pa.array(first[j] + r // c[j]), pa.array(offset[j] + r % c[j] * length)], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, *, capacity: int = CAPACITY, path: str | None = None, end: int = 0) -> DataFrame:
    """Packs the token ids of docs (doc_id, text; other columns ignored) into few sequences of at most `capacity`.

    A document is its text's ids and then `end`; only longer ones are cut, into pieces of `capacity` tokens of which the
    first may be shorter. Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    path: the vocabulary's json file, with its ranks beside it; every worker reads both.

    Null and empty texts are one piece of one token; a text's ids are held in one task, however long. A null doc_id stays
    null; rows that repeat are packed each. An empty table gives an empty result.
    """
    st = Stages(docs.sparkSession, "packing")
    light = "doc_id long, piece int, start long, length long, ids_crc32 long, k long, part long"
    pieces = st.save(docs.select(id_in().alias("doc_id"), "text").mapInArrow(partial(_tokenize, path=path or vocabulary(), capacity=capacity, end=end), light))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = st.save(counts.select(F.col("part").alias("__p"), F.col("length").alias("__l"), "c", F.coalesce(before, F.lit(0)).alias("__before")))
    # one row for each length, capacity rows at most
    histogram = {r["__l"]: r["n"] for r in counts.groupBy("__l").agg(F.sum("c").alias("n")).collect()}
    plan = solve(histogram, capacity)
    ranked = pieces.join(counts.hint("merge"), (F.col("part") == F.col("__p")) & (F.col("length") == F.col("__l"))).withColumn("rank", F.col("k") + F.col("__before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    slots = plan.slots() if histogram else tuple(np.zeros(0, np.int64) for _ in range(4))
    out = ranked.mapInArrow(partial(_place, slots=slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", id_out("doc_id"))
