"""Operators against brute force on small tables with nulls, empty and long texts, repeats and odd columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.llm import licenses, mixing, nearest, ngram_join, packing, quality, sharding, sql, substring_dedup, suffix_dedup, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, keys string"


def rows():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = text(150), text(90)
    out = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, " \n\t "), (5, base), (6, base), (7, base.replace("w1 ", "w2 ", 1)), (8, text(60) + " " + passage + "\n" + text(60)), (9, passage + " " + text(200)), (10, "é " * 900), (11, text(6000) + " " + passage), (12, "Licensed under the MIT License."), (13, text(80) + "\nLicensed under the Apache License, Version 2.0.")]
    near = base.split()
    for i in range(40):
        w = list(near)
        w[3 * i % 140] = f"n{i}"
        out.append((20 + i, " ".join(w)))
    return [(d, x, [None, "en", "de"][d % 3], ["src1", "src0", None][d % 3], 1, "clash", "clash") for d, x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(x):
    return WORD.findall(x or "")


def test_mixing(docs, nothing):
    r = mixing.mix_sources(docs, mixing.cyclic_weights([3, 1, 2])).toPandas()
    again = mixing.mix_sources(docs.repartition(7), mixing.cyclic_weights([3, 1, 2])).toPandas()
    assert r.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()
    assert (r.taken <= 2 * r["size"]).all() and r["size"].tolist() == [len(words(x[1])) for i in r.doc_id for x in rows() if x[0] == i]
    one = r.drop_duplicates(["source_size", "target"])
    assert abs(one.target.sum() - 1.5 * r["size"].sum()) < 1e-6 and (one.target <= 2 * one.source_size + 1e-9).all()
    assert mixing.mix_sources(nothing, mixing.cyclic_weights([1])).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix(docs, nothing, hot):
    texts = {x[0]: (x[1] or "").encode() for x in rows()}
    seen = collections.Counter(b[i : i + 400] for b in texts.values() for i in range(len(b) - 399))
    got = suffix_dedup.dedup_digests(docs, hot=hot).toPandas().set_index("doc_id")
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        left = bytes(c for c, g in zip(b, gone) if not g)
        assert (got.n_removed[d], got.kept_sha256[d], got.n_spans[d]) == (sum(gone), hashlib.sha256(left).hexdigest(), len(re.findall(b"\1+", bytes(gone)))), d
    assert suffix_dedup.dedup_digests(nothing).count() == 0


def test_suffix_keeps_first(docs):
    texts = {x[0]: (x[1] or "").encode() for x in rows()}
    seen, want = set(), {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if b[i : i + 400] in seen:
                gone[i : i + 400] = b"\1" * 400
            seen.add(b[i : i + 400])
        want[d] = sum(gone)
    assert suffix_dedup.dedup_digests(docs, keep="first").toPandas().set_index("doc_id").n_removed.to_dict() == want


def test_sharding(docs, nothing, spark):
    r = sharding.shard_documents(docs, limit=4000).toPandas()
    assert len(r) == len(rows()) and (r[~r.oversize].shard_bytes <= 4000).all()
    assert (r.groupby("shard").n_bytes.sum() == r.groupby("shard").shard_bytes.first()).all()
    same = spark.createDataFrame([(7, 10)] * 50, "key long, n_bytes long")
    assert sharding.shard(same, limit=95).groupBy("shard").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] <= 95
    assert sharding.shard_documents(nothing, limit=10).count() == 0


def test_urls(spark):
    data = [(1, "http://A.Net/x"), (2, "https://www.example.net/en/1?q"), (3, "http://b.example.com/de/"), (4, None), (5, "nourl"), (6, "http://sub.bad.example.org/es/1"), (7, "x://f.org/fr/2"), (8, "http://ok.example.org#z")]
    pages = spark.createDataFrame(data, "page_id long, url string")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    r = urls.url_filter(pages, rules, spark.createDataFrame([("bad.example.org",), ("none.example",)], "key string")).toPandas().set_index("page_id")
    assert r.verdict.tolist() == [r.verdict[i] for i in r.index] and r.verdict.to_dict() == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow"}
    assert r.rule[2] == "example.net/en/" and r.host[1] == "a.net" and r.path[8] == ""


def test_cascade_is_exact(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) AS key")
    c = urls.build(listed, keys, bits_per_key=4.0)
    got = keys.select("key", *c.vectors()).filter(c.contains(F.col("key"))).count()
    assert got == listed.count() and len(c.levels) > 1


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = packing.pack(docs).toPandas()
    for d, x, *_ in rows():
        ids = np.array([*tok.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        mine = r[r.doc_id == d].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)]
    for _, g in r.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert r.sequence_id.nunique() <= -(-r.length.sum() // 2048) + 1
    assert packing.pack(nothing).count() == 0


def test_quality(docs, nothing):
    r = quality.quality_rules(docs).toPandas().set_index("doc_id")
    for d, x, *_ in rows():
        w = words(x)
        tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [y for y in (x or "").split("\n") if words(y)]
        assert (r.n_words[d], r.word_chars[d], r.n_repeat_words[d], r.n_dup_lines[d]) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines))), d
        assert r.base_failed[d] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert r.kept[5] and not r.kept[10]
    assert quality.quality_rules(nothing).count() == 0


def test_quality_limits_are_the_groups_own(spark):
    """The same texts, among plain ones and among texts full of symbols, long words and repeats."""
    rng = np.random.default_rng(2)
    plain = lambda: [f"w{x:04d}" for x in rng.integers(0, 10_000, 100)]
    symbols = lambda n: " ".join(w + "#" * n for w in plain())
    long = lambda n: " ".join(w + "x" * n for w in plain())
    repeats = lambda n: " ".join((w := plain())[: 100 - n] + w[:n])
    probes = [symbols(1), long(5), repeats(21)]
    data = [(i, " ".join(plain()), "en", "plain") for i in range(220)]
    data += [(1000 + i, (symbols(i // 3 % 3), long(i // 3 % 12), repeats(i // 3 % 24))[i % 3], "en", "odd") for i in range(330)]
    data += [(5000 + 10 * j + i, x, "en", s) for j, s in enumerate(("plain", "odd")) for i, x in enumerate(probes)]
    r = quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert not r.base_failed.any()
    assert not r.kept[[5000, 5001, 5002]].any() and r.kept[[5010, 5011, 5012]].all()
    assert r.kept[list(range(220))].all()
    # each rule alone decides: the repeat rule is within what the base rules pass
    for i, rule in enumerate(("symbol_ratio", "mean_word", "repeat_ratio")):
        assert r[rule][5000 + i] > r[f"max_{rule}"][5000 + i], rule


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 16)) * rng.uniform(0.5, 2, (300, 1))
    v[50:120] = v[50]
    data = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (904, [1.0, None] * 8)]
    r = nearest.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=5).toPandas()
    hit = 0
    for q in range(0, 300, 20):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(300), -s.round(12)))[:5]
        mine = r[r.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[mine.vec_id])
        assert mine.sort_values(["score", "vec_id"], ascending=[False, True])["rank"].tolist() == [1, 2, 3, 4, 5]
        assert set(mine.vec_id) & set(range(50, 120)) <= set(range(50, 57))  # of equal vectors, the smallest ids
        hit += len(set(best) & set(mine.vec_id))
    assert hit >= 0.9 * 75
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_nearest_of_each_length(spark):
    """A longer row drops no others."""
    rng = np.random.default_rng(6)
    data = [(i, rng.standard_normal(8 if i < 60 else 9 if i < 100 else 10).tolist()) for i in range(101)]
    r = nearest.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=3, every=10).toPandas()
    for lo, hi in ((0, 60), (60, 100)):
        x = np.array([v for _, v in data[lo:hi]])
        for q in range(lo, hi, 10):
            s = x @ x[q - lo]
            s[q - lo] = -np.inf
            mine = r[r.query_id == q].sort_values("rank")
            assert mine["rank"].tolist() == [1, 2, 3] and np.allclose(mine.score, s[mine.vec_id - lo])
            assert mine.score.iloc[0] <= s.max() + 1e-9
    assert set(r.query_id) == set(range(0, 100, 10))  # 100 is alone of its length


def links(k, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, x, *_ in rows():
        w = words((x or "").translate(low))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[comp[x]] == comp[x] for x in comp):
            break
    return sets, comp


@pytest.mark.parametrize("k,num,den,most", [(4, 85, 100, 5), (5, 4, 5, 2)])
def test_ngrams(docs, nothing, k, num, den, most):
    sets, comp = links(k, num, den)
    r = ngram_join.ngram_components(docs, k=k, num=num, den=den, most=most).toPandas().set_index("doc_id")
    assert r.component_id.to_dict() == comp and r.n_shingles.to_dict() == {d: len(s) for d, s in sets.items()}
    assert ngram_join.ngram_components(nothing).count() == 0


def test_signatures_meet():
    """Any two sets that may link share a signature, in whichever bands they are."""
    rng = np.random.default_rng(5)
    band = ngram_join.bands(85, 100, 1 << 40)
    for n in (1, 2, 5, 7, 12, 30, 90, 400):
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            cut = int(rng.integers(0, max(1, n * 15 // 100) + 1))
            extra = int(rng.integers(0, 3))
            b = np.concatenate([a[cut:], rng.integers(0, 2**63, extra, dtype=np.uint64)])
            if 100 * (n - cut) >= 85 * (n + extra):
                x, y = (set(ngram_join.signatures(np.sort(s), band, 85, 100, 0).tolist()) for s in (a, b))
                assert x & y, (n, cut, extra)


def test_substrings(docs, nothing):
    seen, want = set(), {}
    for d, x, *_ in rows():
        w, gone = words(x), set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        left = " ".join(y for i, y in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    got = substring_dedup.dedup_digests(docs).toPandas().set_index("doc_id")
    assert {d: tuple(x) for d, x in zip(got.index, got.itertuples(index=False))} == want
    assert substring_dedup.dedup_digests(nothing).count() == 0


def test_licenses(spark, docs, nothing):
    r = licenses.license_scan(licenses.document_files(docs)).toPandas().set_index("file_id")
    assert r.license[12] == "MIT" and r.license[13] == "Apache-2.0" and r.origin[13] == "own"
    files = [(1, "a/LICENSE", "Released under the MIT License.", True), (2, "a/b/c/x.py", "code", False), (3, "z/y.py", None, None), (4, None, "code", False), (5, "a/b/LICENSE", "Licensed under CC BY-NC 4.0.", True)]
    f = licenses.license_scan(spark.createDataFrame(files, "file_id long, path string, text string, is_license boolean")).toPandas().set_index("file_id")
    assert f.license[2] == "CC-BY-NC-4.0" and f["from"][2] == "a/b" and f.origin[3] == "none" and f.origin[4] == "none"
    assert licenses.license_scan(licenses.document_files(nothing)).count() == 0


LICENSED = {
    "MIT": ["MIT License", "Distributed under the MIT License.", "This project is licensed under the MIT License.", "You may use this package under the MIT licence.", "# SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify"],
    "GPL": ["GNU GENERAL PUBLIC LICENSE", "it under the terms of the GNU General Public License as published by"],
    "GPL-3.0": ["                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["Distributed under the terms of the GNU General Public License v2."],
    "LGPL-2.1": ["You can use it under the GNU Lesser General Public License, version 2.1."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"],
    None: ["The driver lost his license in the harbour.", "A copyright was discussed at length by the council.", "She met a graduate of MIT with a licence to teach chemistry in several schools of the large northern district.", "Permission to enter the garden is given at noon."],
}


@pytest.mark.parametrize("plain", [0, 3000])
def test_license_phrases(spark, plain):
    """Phrases that are no templates, alone and among many texts."""
    want = [(x, k) for k, v in LICENSED.items() for x in v]
    files = [(i, x) for i, (x, _) in enumerate(want)] + [(1000 + i, "only prose here") for i in range(plain)]
    got = {r["file_id"]: r["license"] for r in licenses.detect(spark.createDataFrame(files, "file_id long, text string")).collect()}
    assert {x: got.get(i) for i, (x, _) in enumerate(want)} == dict(want)


def test_near_duplicates_without_ids(spark):
    """No text is lost, whether its row has no id or shares one."""
    import corpus_pipeline as P

    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 80))
    lone, shared, common = [text() for _ in range(6)], [text() for _ in range(3)], text()
    data = [(None, x) for x in lone] + [(7, x) for x in shared] + [(None, common), (9, common), (8, common + " end"), (3, None), (4, ""), (None, "")] + [(5, shared[0])]
    d = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_duplicate_stage(spark, d, "").toPandas()
    assert got.columns.tolist() == d.columns
    have = collections.Counter((None if i != i else int(i), x) for i, x in zip(got.doc_id, got.text, strict=True))
    assert have == collections.Counter([(None, x) for x in lone] + [(7, x) for x in shared[1:]] + [(5, shared[0]), (8, common + " end"), (3, None), (4, ""), (None, "")])


def test_pipeline(spark, docs):
    import corpus_pipeline as P

    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert P.STAGES[-1][1](spark, now, "").filter("length > 2048").count() == 0
    assert pd.Series([k for k, _ in P.STAGES]).is_unique


ODD = "doc_id long, text string, lang string, source string, n_chars long, __doc string, __id string, __ord string, rest string"


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated and null ids, equal rows, ties, columns with the operators' own names."""
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    a, b, c, passage = text(200), text(180), text(150), text(120)
    data = [(1, a), (1, a), (1, b), (None, a), (None, c), (None, None), (2, passage + " " + text(90)), (2, text(90) + " " + passage), (3, ""), (None, ""), (4, text(4000) + " " + passage), (5, c + " x")]
    return data, spark.createDataFrame([(d, x, "en", "s", 1, "d", "i", "o", "r") for d, x in data], ODD)


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    for t in range(12):
        d = rng.integers(0, 2, 250, dtype=np.uint8)
        d = np.concatenate([d, d[50:110], d[40:180], np.zeros(60, np.uint8)])
        at = np.arange(len(d) - 39)
        at = at[rng.random(len(at)) < 0.7] if t % 2 else at
        factor, source = suffix_dedup.longest_previous_factor(d, at, 40)
        common = lambda x, y: next((n for n in range(40) if d[x + n] != d[y + n]), 40)
        for i, x in enumerate(at.tolist()):
            assert factor[i] == max((common(x, y) for y in at[:i].tolist()), default=0)
            assert factor[i] == 0 or (source[i] < i and common(x, at[source[i]]) == factor[i])


@pytest.mark.parametrize("hot", [8 << 20, 1])
def test_suffix_of_repeated_ids(odd, hot):
    data, d = odd
    texts = [(x or "").encode() for _, x in data]
    seen = collections.Counter(b[i : i + 400] for b in texts for i in range(len(b) - 399))
    want = []
    for (k, _), b in zip(data, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want.append((k, len(b), sum(gone)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup_digests(d, hot=hot).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_substrings_of_repeated_ids(odd):
    """Each window stays once, whichever of the rows that share an id comes first."""
    data, d = odd
    r = substring_dedup.substring_dedup(d)
    got = r.select("rest.*", "text", "n_words", "n_removed", "kept_words").collect()
    assert len(got) == len(data) and set(got[0].asDict()) > {"__doc", "__id", "__ord", "rest"}
    windows = lambda x: [tuple(w[i : i + 20]) for w in [words(x)] for i in range(len(w) - 19)]
    kept = collections.Counter(g for x in got for g in set(windows(x["text"] if x["kept_words"] is None else x["kept_words"])))
    assert max(kept.values()) == 1 and set(kept) <= {g for _, x in data for g in windows(x)}


def test_ngrams_of_repeated_ids(odd):
    data, d = odd
    got = ngram_join.ngram_components(d, k=4, num=85, den=100).collect()
    # the texts a stand under id 1 twice and without one; c has no id, its near copy is 5
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == collections.Counter([(1, 1), (1, 1), (1, 1), (None, 1), (None, 5), (None, None), (2, 2), (2, 2), (3, 3), (None, None), (4, 4), (5, 5)])


def test_mix_of_repeated_ids(spark):
    d = spark.createDataFrame([(7, "a b c d e " * 20, "s")] * 400 + [(None, "a b c", "s")] * 400, "doc_id long, text string, source string")
    r = mixing.mix_sources(d, mixing.cyclic_weights([1]), total_share=1.5).toPandas()
    assert abs(r.taken.sum() - 1.5 * r["size"].sum()) < 0.03 * r["size"].sum() and r.copies.between(1, 2).all()


def test_water_filling(spark):
    """Targets against filling step by step."""
    sizes, weight = {"a": 1000, "b": 50, "c": 300, None: 10}, {"a": 3.0, "b": 1.0, "c": 2.0, None: 3.0}
    t = mixing.targets(spark.createDataFrame([(s, weight[s], n) for s, n in sizes.items()], "source string, weight double, source_size long"), 1.5, 2.0).toPandas()
    target, open_ = {}, set(sizes)
    while open_:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} or {s: share[s] for s in open_}
        open_ -= full or open_
    assert {r.source: round(r.target, 6) for r in t.itertuples()} == {s: round(v, 6) for s, v in target.items()}


def test_shards_of_repeated_keys(spark):
    r = sharding.shard(spark.createDataFrame([(7, 500), (7, 600), (None, 700), (None, 700), (8, 10), (None, 5), (9, None)], "key long, n_bytes long"), limit=100).toPandas()
    big = r[r.oversize]
    assert big.shard.is_unique and len(big) == 4 and (big.shard_bytes == big.n_bytes).all()
    assert (r.groupby("shard").n_bytes.sum() == r.groupby("shard").shard_bytes.first()).all()


def test_shards_split_only_where_needed(spark):
    r = sharding.shard(spark.range(3000).selectExpr("id AS key", "1 + id % 9 AS n_bytes"), limit=900).toPandas()
    sums = r.groupby("shard").n_bytes.sum()
    assert (sums <= 900).all()
    for s in sums.index:  # the parent of every shard is too large
        assert not s or r[r.shard.str.startswith(s[:-1])].n_bytes.sum() > 900


def test_cascades_of_parts(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 900}.example.org/x") for i in range(1000)] + [(None, None)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.example.org",) for i in range(0, 900, 7)], "key string")
    one, many = (urls.url_filter(pages, [], listed, max_words=m).toPandas() for m in (1 << 20, 8))
    want = {i: (i % 900) % 7 == 0 for i in range(1000)}
    for r in (one, many):
        assert len(r) == 1001 and {int(x.page_id): x.listed for x in r[r.page_id.notna()].itertuples()} == want
    assert urls.url_filter(pages.limit(0), [], listed).count() == 0 and not urls.url_filter(pages, [], listed.limit(0)).filter("listed").count()


def test_ids_of_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing._encoder(path)
    for x in ("a <|endoftext|> b", "<|endoftext|>", "plain é text\n\n  tabs\t", "", "<|endoftext|"):
        assert np.frombuffer(enc.ids(x), "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


def test_plans_cover_and_bound():
    rng = np.random.default_rng(0)
    for n, mu, sd in ((4000, 5.5, 1.0), (2000, 6.5, 0.7), (50, 7.0, 0.5)):
        h = collections.Counter(np.clip(rng.lognormal(mu, sd, n).astype(int), 1, 2048).tolist())
        p = packing.solve(h)
        have = collections.Counter()
        for times, config in p.configurations:
            assert sum(a * c for a, c in config.items()) <= 2048
            have.update({a: c * times for a, c in config.items()})
        volume = sum(a * c for a, c in h.items())
        assert have == h and volume / 2048 - 1e-6 <= p.bound <= p.sequences + 1e-6 and p.sequences <= 1.02 * p.bound + 8


def test_fingerprints_tell_regular_texts_apart(spark):
    """Two sequences that sums of powers modulo 2**64 don't tell apart, whatever the odd base."""
    x = np.array([bin(i).count("1") & 1 for i in range(4096)], np.uint8)
    a, b = (x + 97).tobytes().decode(), (1 - x + 97).tobytes().decode()
    d = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup_digests(d).collect()}
    seen = collections.Counter(t[i : i + 400] for t in (a, b) for i in range(len(t) - 399))
    want = {}
    for k, t in ((1, a), (2, b)):
        gone = set()
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone.update(range(i, i + 400))
        want[k] = len(gone)
    assert got == want


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as P

    data, d = odd
    d = d.select("doc_id", "text", "lang", "source", "n_chars")
    near = P.near_duplicate_stage(spark, d, "").collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in near) == collections.Counter([x for i, x in enumerate(data) if i not in (1, 3, 4)])
    mixed = P.mix_stage(spark, d, "").toPandas()
    assert 0.8 * 1.5 * sum(len(words(x)) for _, x in data) < sum(len(words(x)) for x in mixed.text) < 1.2 * 1.5 * sum(len(words(x)) for _, x in data)
    for _, stage in P.STAGES:
        assert stage(spark, d.limit(0), "").count() == 0


def test_sql_says_the_same(docs):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    pairs = [
        (suffix_dedup.dedup_digests(docs, length=400), sql.suffix_dedup(400)),
        (substring_dedup.dedup_digests(docs, window=20), sql.substring_dedup(20)),
        (ngram_join.ngram_components(docs, k=4, num=85, den=100), sql.ngram_components(4, 85, 100)),
    ]
    for got, twin in pairs:
        want = con.sql(twin)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
