"""N-gram Jaccard join by parity sketches.

A document's shingles are dealt by hash over P chunks, and each chunk keeps the parity of every shingle that falls in it: a
bit sketch, held as the XOR of the shingles' 64-bit codes. Chunks that differ between two documents number at most the
size of the symmetric difference of their sets. For sizes a, b and similarity t that size is at most
(a + b)(1 - t) / (1 + t), so of more chunks than that one agrees: documents of one size band, or of neighbouring bands,
join on (band, chunk, XOR). Chunks empty in a document say nothing; a few more chunks make up for them, and a document with
more empty chunks than those is dealt again with another seed (and in the end by its prefix of smallest codes). So every
pair that links shares a signature. Candidates are verified on the exact sets.

Groups that share a signature are not paired out. Small groups are tested pair by pair; in a large one every member is
tested against the hubs that cover it, few where the members are alike. Groups above BLOCK members are covered in blocks,
and then the blocks' hubs. What the links leave in more than one component is then tested between its components only, again
in blocks of bounded size.
Before texts are compared, a pair must pass the Hamming distance of two sketches of 64 * WORDS bits, so that nearly all
texts that travel do link. Components are thus exact, and a group of n copies costs about n tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._common import NULL_ID, Stages, numbered
from ._groups import classes, components, runs

U = np.uint64
#: Group size up to which all pairs are tested.
PAIRED = 5
#: Members of a group that one step holds.
BLOCK = 4096
#: Documents that are compared with one copy of a hub.
HUB_SHARE = 256
TRIES = 5
#: Words of 64 bits of the sketch that is compared before texts are.
WORDS = 16


def bands(num: int, den: int, top: int) -> np.ndarray:
    """First sizes of the bands: a size of band k links with sizes of the bands k-1, k and k+1 only."""
    out = [1]
    while out[-1] <= top:
        b = out[-1]
        # the band ends where its own first size ceases to link
        out.append(b * den // num + 1)
    out.append(out[-1] * den // num + 1)
    out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def chunks(band: np.ndarray, k: int, num: int, den: int) -> tuple[int, int]:
    """Chunks and tolerated empty chunks for pairs whose smaller set is in band k."""
    last = int(band[k + 1]) - 1
    other = min(int(band[k + 2]) - 1, last * den // num)
    d = (last + other) * (den - num) // (den + num)
    if d == 0:
        return 1, 0
    empty = 1
    for _ in range(3):
        p = d + 1 + empty
        empty = int(np.ceil(p * np.exp(-int(band[k]) / p))) + 1
    return d + 1 + empty, empty


def signatures(codes: np.ndarray, band: np.ndarray, num: int, den: int, seed: int) -> np.ndarray:
    """The signatures of one set (distinct codes)."""
    n = len(codes)
    own = int(np.searchsorted(band, n, "right")) - 1
    out = []
    for k in (own, own - 1):
        if k < 0 or (k < own and (int(band[k + 1]) - 1) * den // num < n):
            continue
        p, empty = chunks(band, k, num, den)
        tag = U(k * 1_000_003 + seed * 7919)
        for again in range(TRIES):
            h = T.mix(codes + U(0x51ED270B * (again + 1)) + tag)
            part = ((h >> U(32)) * U(p)) >> U(32)
            order = np.argsort(part, kind="stable")
            ps = part[order]
            first = np.flatnonzero(np.append(True, ps[1:] != ps[:-1]))
            x = np.bitwise_xor.reduceat(T.mix(h + U(77))[order], first)
            out.append(T.mix(x ^ (ps[first] * U(0x9E3779B97F4A7C15)) ^ T.mix(tag * U(31) + U(again * 10_007) + np.zeros(1, U))))
            if p - len(first) <= empty:
                break
        else:
            d = p - 1 - empty
            out.append(T.mix(np.sort(T.mix(codes + tag))[: d + 1] ^ T.mix(tag * U(31) + U(999) + np.zeros(1, U))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def flat_sets(arr: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of the k-word shingles of all texts of a slice, ordered by text and code, and where each text's
    begin (and the end). Words are lower-cased; a text of fewer than k words is one shingle of its own."""
    w = T.Words(arr, lower=True)
    n_docs = len(w.n)
    count = np.where(w.n >= k, w.n - k + 1, 0)
    doc = np.repeat(np.arange(n_docs), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
    code = w.grams(k)[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    if len(short):
        f1, _ = w.fingerprints()
        code, doc = np.append(code, T.mix(f1[short] + w.n[short].astype(U))), np.append(doc, short)
    order = np.argsort(code)
    code, doc = code[order], doc[order]
    order = np.argsort(doc.astype(np.uint16 if n_docs < 65536 else np.int64), kind="stable")
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    code, doc = code[new], doc[new]
    return code, np.searchsorted(doc, np.arange(n_docs + 1))


def flat_signatures(code: np.ndarray, off: np.ndarray, band: np.ndarray, num: int, den: int, seed: int) -> list[np.ndarray]:
    """signatures() of every set of a slice, in one pass; sets with too many empty chunks are dealt again one by one."""
    n = np.diff(off)
    own = np.searchsorted(band, n, "right") - 1
    out: list[list[np.ndarray]] = [[] for _ in n]
    again = np.zeros(len(n), bool)
    for back in (0, 1):
        k = own - back
        last = (band[np.maximum(k, 0) + 1] - 1) * den // num
        docs = np.flatnonzero((n > 0) & (k >= 0) & ((back == 0) | (last >= n)))
        if not len(docs):
            continue
        kinds = {int(x): chunks(band, int(x), num, den) for x in np.unique(k[docs])}
        p = np.array([kinds[int(x)][0] for x in k[docs]], np.int64)
        empty = np.array([kinds[int(x)][1] for x in k[docs]], np.int64)
        tag = k[docs].astype(U) * U(1_000_003) + U(seed * 7919)
        rows = np.repeat(np.arange(len(docs)), n[docs])
        at = np.arange(len(rows)) - np.repeat(np.cumsum(n[docs]) - n[docs], n[docs]) + np.repeat(off[docs], n[docs])
        h = T.mix(code[at] + U(0x51ED270B) + tag[rows])
        part = (((h >> U(32)) * p.astype(U)[rows]) >> U(32)).astype(np.int64)
        slot = part + (np.cumsum(p) - p)[rows]
        order = np.argsort(slot)
        ss = slot[order]
        first = np.flatnonzero(np.append(True, ss[1:] != ss[:-1]))
        x = np.bitwise_xor.reduceat(T.mix(h + U(77))[order], first)
        sd, sp = rows[order[first]], part[order[first]]
        sig = T.mix(x ^ (sp.astype(U) * U(0x9E3779B97F4A7C15)) ^ T.mix(tag * U(31))[sd])
        bounds = np.searchsorted(sd, np.arange(len(docs) + 1))
        again[docs[p - np.diff(bounds) > empty]] = True
        for i, d in enumerate(docs.tolist()):
            out[d].append(sig[bounds[i] : bounds[i + 1]])
    for d in np.flatnonzero(again).tolist():
        out[d] = [signatures(code[off[d] : off[d + 1]], band, num, den, seed)]
    return [np.concatenate(x) if x else np.zeros(0, U) for x in out]


def sets(arr: pa.Array, k: int) -> Iterator[np.ndarray]:
    code, off = flat_sets(arr, k)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield code[a:b]


def parity(code: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(sets, WORDS): a bit for each value of the codes' hash, set where an odd number of codes has it."""
    n = len(off) - 1
    h = T.mix(code + U(0xA5A5))
    bit = (np.repeat(np.arange(n), np.diff(off)) * (64 * WORDS) + (h & U(64 * WORDS - 1)).astype(np.int64))
    odd = (np.bincount(bit, minlength=n * 64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, WORDS)


def _prints(batches, k: int):
    for b in T.pieces(batches):
        code, off = flat_sets(T.col(b, "text"), k)
        f1, f2 = T.digests([code[a:z].tobytes() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        yield pa.record_batch([T.ints(T.ids(b)), pa.array(np.diff(off)), T.ints(f1), T.ints(f2), T.longs(list(parity(code, off)))], ["doc_id", "n", "f1", "f2", "bits"])


def _signatures(batches, k: int, num: int, den: int, seed: int):
    band = bands(num, den, 1 << 40)
    for b in T.pieces(batches):
        code, off = flat_sets(T.col(b, "text"), k)
        keys = flat_signatures(code, off, band, num, den, seed)
        docs = np.repeat(T.ids(b), [len(x) for x in keys])
        yield pa.record_batch([T.ints(np.concatenate(keys)), pa.array(docs)], ["key", "doc_id"])


def _candidates(batches, most: int):
    """From rows (key, doc_id) ordered by key: pairs of small groups (0, a, b), and rows of large groups (1, key, doc_id).
    Of a group, no more than most rows and a batch are ever held."""
    held_k, held_d = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_key = None  # a large group whose rows so far have gone out

    def told(key, docs, first):
        size = np.diff(first)
        kind, x, y = [], [], []
        for m in range(2, most + 1):
            at = first[:-1][size == m]
            for i in range(m):
                for j in range(i + 1, m):
                    x.append(docs[at + i])
                    y.append(docs[at + j])
                    kind.append(np.zeros(len(at), np.int32))
        large = np.flatnonzero(np.repeat(size > most, size))
        kind.append(np.ones(len(large), np.int32))
        x.append(key[large])
        y.append(docs[large])
        return pa.record_batch([pa.array(np.concatenate(kind)), pa.array(np.concatenate(x)), pa.array(np.concatenate(y))], ["kind", "x", "y"])

    for b in batches:
        if not b.num_rows:
            continue
        key, docs = T.ids(b, "key"), T.ids(b)
        if open_key is not None:
            n = int(np.searchsorted(key != open_key, True))
            yield pa.record_batch([pa.array(np.ones(n, np.int32)), pa.array(key[:n]), pa.array(docs[:n])], ["kind", "x", "y"])
            key, docs = key[n:], docs[n:]
            if not len(key):
                continue
            open_key = None
        key, docs = np.append(held_k, key), np.append(held_d, docs)
        first = np.append(0, 1 + np.flatnonzero(key[1:] != key[:-1]))
        cut = int(first[-1])
        if len(key) - cut > most:
            open_key, cut, first = key[-1], len(key), np.append(first, len(key))
        yield told(key[:cut], docs[:cut], first)
        held_k, held_d = key[cut:], docs[cut:]
    if len(held_k):
        yield told(held_k, held_d, np.array([0, len(held_k)]))


def _may_link(bits, n, i, js, num: int, den: int) -> np.ndarray:
    """Which of the sets js set i may link with, by size and Hamming distance."""
    away = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
    return (away * (den + num) <= (n[js] + n[i]) * (den - num)) & (np.minimum(n[js], n[i]) * den >= np.maximum(n[js], n[i]) * num)


def _group_arrays(t: pa.Table, a: int, z: int):
    docs, n = t.column("doc_id").to_numpy()[a:z], t.column("n").to_numpy()[a:z]
    values, _ = T.list_at(t.column("bits").combine_chunks().slice(a, z - a))
    return docs, n, values.view(U).reshape(z - a, WORDS)


def _cover(batches, num: int, den: int):
    """From blocks (key, block, doc_id, n, bits): pairs (0, x, y) that hold each block together as far as sketches tell, and
    its hubs (1, key, hub). One member after the other that no hub covers becomes a hub; it is paired with the members it
    newly covers, and with one member of each earlier hub's."""
    for t, first in runs(batches, ["key", "block"]):
        keys, x, y, hk, hd = t.column("key").to_numpy(), [], [], [], []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            docs, n, bits = _group_arrays(t, a, z)
            order = np.argsort(T.mix(docs.view(U)))
            docs, n, bits = docs[order], n[order], bits[order]
            of = np.full(len(docs), -1)
            for i in range(len(docs)):
                if of[i] >= 0:
                    continue
                ok = _may_link(bits, n, i, slice(None), num, den)
                ok[i] = False
                new = np.flatnonzero(ok & (of < 0))
                old = np.flatnonzero(ok & (of >= 0))
                old = old[np.unique(of[old], return_index=True)[1]]
                js = np.append(new, old)
                x.append(np.full(len(js), docs[i]))
                y.append(docs[js])
                of[i] = of[new] = i
                hk.append(keys[a])
                hd.append(docs[i])
        n = sum(map(len, x))
        kind = np.repeat(np.array([0, 1], np.int32), [n, len(hk)])
        yield pa.record_batch([pa.array(kind), pa.array(np.concatenate([*x, np.array(hk, np.int64)])), pa.array(np.concatenate([*y, np.array(hd, np.int64)]))], ["kind", "x", "y"])


def _covered(large: DataFrame, prints: DataFrame, num: int, den: int, st: Stages) -> DataFrame:
    """Pairs (x, y) that hold the large groups (key, doc_id) together: in blocks, then hubs of blocks, while they get fewer."""
    out, members = None, None
    while True:
        # one row for each group above a block
        sizes = st.save(large.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK))
        now = sizes.agg(F.sum("c")).first()[0]
        last = now is None or (members is not None and now > members // 2)
        members = now
        n_blocks = F.ceil(F.coalesce(F.col("c"), F.lit(1)) / F.lit(BLOCK))
        dealt = large.join(sizes, "key", "left").select("key", "doc_id", F.pmod(F.xxhash64("doc_id"), n_blocks).alias("block"))
        dealt = dealt.join(prints.hint("merge"), "doc_id").select("key", "block", "doc_id", "n", "bits").repartition("key", "block").sortWithinPartitions("key", "block")
        found = st.save(dealt.mapInArrow(partial(_cover, num=num, den=den), "kind int, x long, y long"))
        pairs = found.filter("kind = 0").select("x", "y")
        out = pairs if out is None else out.unionByName(pairs)
        if last:
            return out
        large = found.filter("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("doc_id")).join(sizes.select("key"), "key", "left_semi")


def _between(batches, num: int, den: int):
    """From cells (key, i, j) of members and probes (doc_id, comp, main, n, bits): the pairs of a probe and a member of
    another component that may link; a member that is a probe, too, is met from one side."""
    for t, first in runs(batches, ["key", "i", "j"]):
        comps, probes, main, x, y = t.column("comp").to_numpy(), t.column("probe").to_numpy(), t.column("main").to_numpy(), [], []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            docs, n, bits = _group_arrays(t, a, z)
            c, probe, m = comps[a:z], probes[a:z], main[a:z]
            for i in np.flatnonzero(probe).tolist():
                js = np.flatnonzero(~probe & (c != c[i]) & (m | (docs > docs[i])))
                js = js[_may_link(bits, n, i, js, num, den)]
                x.append(np.full(len(js), docs[i]))
                y.append(docs[js])
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(cat(x)), pa.array(cat(y))], ["x", "y"])


def _split(large: DataFrame, comp: DataFrame, prints: DataFrame, num: int, den: int, st: Stages) -> DataFrame:
    """Pairs (x, y) that may link of large groups (key, doc_id) whose members are in several components. Members outside a
    group's largest component are probes; probes and members meet in cells of a grid, of BLOCK of each at most or so."""
    named = comp.select(F.col("v").alias("doc_id"), F.col("component").alias("comp"))
    rows = st.save(large.join(named.hint("merge"), "doc_id", "left").select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp")))
    kinds = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    kinds = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top")).filter("k > 1")
    blocks = lambda x: F.ceil(x / F.lit(BLOCK))
    kinds = st.save(kinds.select("key", F.col("top.comp").alias("top"), blocks(F.col("all") - F.col("top.c")).alias("a"), blocks(F.col("all")).alias("b")))
    d = rows.join(kinds, "key").withColumn("main", F.col("comp") == F.col("top"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    probes = d.filter("not main").select("key", "doc_id", "comp", "main", F.lit(True).alias("probe"), own("a").alias("i"), upto("b").alias("j"))
    members = d.select("key", "doc_id", "comp", "main", F.lit(False).alias("probe"), upto("a").alias("i"), own("b").alias("j"))
    cells = probes.unionByName(members).join(prints.hint("merge"), "doc_id").select("key", "i", "j", "doc_id", "comp", "main", "probe", "n", "bits")
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(partial(_between, num=num, den=den), "x long, y long")


def _verify(batches, k: int, num: int, den: int):
    """From rows (hub, part, guest, doc_id, text) ordered, a hub before its guests: links (a, b)."""
    hub, own = None, np.zeros(0, U)
    for b in T.pieces(batches):
        hubs, guests, docs, parts = T.ids(b, "hub"), T.col(b, "guest").to_numpy(zero_copy_only=False), T.ids(b), T.ids(b, "part")
        out_a, out_b = [], []
        for i, s in enumerate(sets(T.col(b, "text"), k)):
            if not guests[i]:
                hub, own = (hubs[i], parts[i]), s
            elif hub == (hubs[i], parts[i]) and len(s) and len(own):
                # sorted and distinct on both sides
                at = np.searchsorted(own, s)
                both = int(np.count_nonzero(own[np.minimum(at, len(own) - 1)] == s))
                if both * den >= num * (len(s) + len(own) - both):
                    out_a.append(hubs[i])
                    out_b.append(docs[i])
        yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _near(pairs: DataFrame, sk: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link by their sizes and by the Hamming distance of their sketches."""
    s = sk.select("doc_id", "n", "bits")
    p = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")).hint("merge"), "a")
    p = p.join(s.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")).hint("merge"), "b")
    away = sum((F.bit_count(F.get("ba", F.lit(i)).bitwiseXOR(F.get("bb", F.lit(i)))) for i in range(1, WORDS)), F.bit_count(F.get("ba", F.lit(0)).bitwiseXOR(F.get("bb", F.lit(0)))))
    sizes = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    return p.filter(sizes & (away * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))).select("a", "b").distinct()


def _links(texts: DataFrame, pairs: DataFrame, k: int, num: int, den: int, st: Stages) -> DataFrame:
    """The pairs (a, b) that link. Every text goes once to each hub that it is to be compared with; a hub with many guests
    is dealt over parts."""
    pairs = st.save(pairs)
    # the more frequent end of a pair is its hub
    deg = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    p = pairs.join(deg.select(F.col("v").alias("a"), F.col("n").alias("na")), "a").join(deg.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b")
    swap = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    p = p.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("doc_id"), F.greatest("na", "nb").alias("n"))
    parts = F.floor((F.col("n") - 1) / HUB_SHARE) + 1
    p = st.save(p.withColumn("parts", parts))
    guests = p.select("doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), F.lit(True).alias("guest"))
    hubs = p.groupBy("hub").agg(F.max("parts").alias("parts")).select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("guest"))
    sent = guests.unionByName(hubs).hint("merge").join(texts, "doc_id")
    sent = sent.select("hub", "part", "guest", "doc_id", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "guest", "doc_id")
    return st.save(sent.mapInArrow(partial(_verify, k=k, num=num, den=den), "a long, b long"))


def ngram_groups(texts: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, most: int = PAIRED) -> DataFrame:
    """As ngram_components() for texts (doc_id, unique and not null; text): doc_id, n_shingles, component_id."""
    st = Stages(texts.sparkSession, "ngrams")
    prints = st.save(texts.mapInArrow(partial(_prints, k=k), "doc_id long, n long, f1 long, f2 long, bits array<long>"))
    cls = st.save(classes(prints.filter("n > 0"), "n", "f1", "f2"))
    first = texts.join(cls.filter("doc_id = rep").select("doc_id").hint("merge"), "doc_id").select("doc_id", "text")
    keys = first.mapInArrow(partial(_signatures, k=k, num=num, den=den, seed=0), "key long, doc_id long")
    pair = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    out = st.save(keys.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_candidates, most=most), "kind int, x long, y long"))
    large = st.save(out.filter("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("doc_id")).distinct())
    spread = _covered(large, prints, num, den, st)
    links = _links(texts, _near(pair(out.filter("kind = 0")), prints, num, den).unionByName(pair(spread)).distinct(), k, num, den, st)
    st.drop(out)
    # members of large groups that the links do not yet hold together
    comp = st.save(components(links, st))
    more = st.save(pair(_split(large, comp, prints, num, den, st)))
    if not more.isEmpty():
        # the components so far are links enough, each member with its smallest
        so_far = comp.select(F.col("v").alias("a"), F.col("component").alias("b"))
        comp = st.save(components(so_far.unionByName(_links(texts, more, k, num, den, st)), st))
    whole = cls.join(comp.select(F.col("v").alias("rep"), "component").hint("merge"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    # texts without shingles are not in cls
    res = prints.select("doc_id", F.col("n").alias("n_shingles")).join(whole.hint("merge"), "doc_id", "left")
    res = st.save(res.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    st.drop(prints, cls, large, links, comp, more)
    return res


def ngram_components(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, most: int = PAIRED) -> DataFrame:
    """Connected components of the links |A & B| / |A | B| >= num / den between the sets of k-word shingles.

    docs: doc_id, text; other columns are ignored. Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased. A text of fewer
    than k words is one shingle; an empty or null one has no shingles and links with nothing. A text is held whole in one
    task, however long.
    Returns doc_id, n_shingles, component_id: the smallest doc_id that links reach, itself included; one row for each row of docs.

    Rows that repeat a doc_id, or have none, are documents of their own; null comes last in order, so component_id is null
    only where all of a component are without an id. Equal sets are one class, of which only the first takes part, so exact
    copies cost nothing. An empty table gives an empty result.
    """
    st = Stages(docs.sparkSession, "ids")
    rows, plain = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), st)
    groups = ngram_groups(rows.select(F.col("__doc").alias("doc_id"), "text"), k=k, num=num, den=den, most=most)
    if plain:
        back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
        return groups.select(back("doc_id"), "n_shingles", back("component_id"))
    name = rows.select(F.col("__doc").alias("__n"), F.col("rest.doc_id").alias("__id"))
    own = groups.join(name.hint("merge"), F.col("doc_id") == F.col("__n")).select(F.col("__id").alias("doc_id"), "n_shingles", "component_id")
    return own.join(name.hint("merge"), F.col("component_id") == F.col("__n")).select("doc_id", "n_shingles", F.col("__id").alias("component_id"))
