"""License scans: sparse TF-IDF cosine of sentences to templates, then inheritance from the nearest directory above.

DataFrame functions only. Templates are names, titles, usual headers and sentences of full license texts. Every sentence of a
text, by lines and with wrapped lines joined, is a sparse vector over the templates' vocabulary plus one weight for each word
outside it. Document frequencies of the vocabulary are counted over all texts; all weights have bounds that do not depend on
the table; a word that stands c times in a sentence or template weighs 1 + ln c times as much. A template's naming words (names,
versions) and one of its anchor words must stand in the sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Stages, id_in


def _named(license: str, *names: str) -> list[tuple[str, str, int]]:
    return [(license, f"{pre}{x}", 0) for x in names for pre in ("", "Licensed under the ")]


def _spdx(*ids: str) -> list[tuple[str, str, int]]:
    return [(x, f"SPDX-License-Identifier: {x}{end}", 0) for x in ids for end in (("", "-only", "-or-later") if "GPL" in x else ("",))]


_GNU = "it under the terms of the GNU {}General Public License as published by"
_GNU_WHOLE = "This {} is free software: you can redistribute it and/or modify " + _GNU + " the Free Software Foundation, either version {} of the License, or (at your option) any later version."
# Fixed values: (license, text, rank). Rank 0 says which license; 1 names a family, or is shared by several; 2 only reserves
# rights. A smaller rank goes first.
TEMPLATES = (
    *_named("Apache-2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", 0),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", 0),
    *_named("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)", 0),
    ("MIT", "Released under the MIT License.", 0),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", 0),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights", 0),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", 0),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 0),
    *_named("GPL-3.0", "GNU General Public License, version 3", "GPL version 3", "GPLv3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", 0),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", 0),
    ("GPL-3.0", _GNU_WHOLE.format("program", "", "3"), 0),
    *_named("GPL-2.0", "GNU General Public License, version 2", "GPL version 2", "GPLv2"),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2.", 0),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", 0),
    ("GPL-2.0", _GNU_WHOLE.format("program", "", "2"), 0),
    *_named("LGPL-3.0", "GNU Lesser General Public License, version 3", "LGPL version 3", "LGPLv3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", 0),
    ("LGPL-3.0", _GNU_WHOLE.format("library", "Lesser ", "3"), 0),
    *_named("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "LGPL version 2.1", "LGPLv2.1"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", 0),
    ("LGPL-2.1", _GNU_WHOLE.format("library", "Lesser ", "2.1"), 0),
    *_named("AGPL-3.0", "GNU Affero General Public License, version 3", "AGPL version 3", "AGPLv3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", 0),
    ("AGPL-3.0", _GNU_WHOLE.format("program", "Affero ", "3"), 0),
    *_named("MPL-2.0", "Mozilla Public License, version 2.0", "MPL 2.0 license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", 0),
    *_named("BSD-3-Clause", "BSD 3-Clause License", "New BSD License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", 0),
    *_named("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"),
    *_named("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose, ISC License.", 0),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 0),
    *_named("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    *_named("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    *_named("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    *_named("CC0-1.0", "CC0 1.0 Universal license"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all rights under CC0 1.0.", 0),
    *_named("Unlicense", "Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain, the Unlicense.", 0),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", 0),
    *_spdx("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense"),
    ("Apache", "Licensed under the Apache License", 1),
    ("GPL", "GNU General Public License", 1),
    ("GPL", _GNU.format(""), 1),
    ("LGPL", "GNU Lesser General Public License", 1),
    ("LGPL", _GNU.format("Lesser "), 1),
    ("AGPL", "GNU Affero General Public License", 1),
    ("AGPL", _GNU.format("Affero "), 1),
    ("MPL", "Mozilla Public License", 1),
    ("BSD", "BSD License", 1),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", 1),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted.", 1),
    ("Proprietary", "Copyright. All rights reserved.", 2),
)
#: Words that speak of a license. A sentence must have one that its template has, so that sentences without any of them, which
#: are left out beforehand, could fit no template.
ANCHORS = ("license", "licensed", "copyright", "permission", "redistribution", "unlicense", "waived", "unencumbered", "gpl", "lgpl", "agpl", "gplv2", "gplv3", "lgplv2.1", "lgplv3", "agplv3", "spdx-license-identifier", "cc")
MIN_COSINE = 0.7
#: Names: a template's must stand in the sentence. Those in OTHERS must not, unless the template has them.
OTHERS = frozenset("lesser affero lgpl agpl lgplv2.1 lgplv3 agplv3 by-nc by-sa by-nd by-nc-sa by-nc-nd attribution-noncommercial attribution-sharealike noncommercial sharealike 2-clause 3-clause simplified new".split())
NAMES = OTHERS | frozenset("mit apache gnu gpl gplv2 gplv3 mozilla mpl bsd isc cc by cc0 creative commons attribution unlicense unencumbered".split())
STOP = frozenset("a an and any are as at be by for in into is it its of on or our that the this to under was which with you your".split()) - NAMES
#: Least and greatest weight of names, common words and others; of a word outside the vocabulary.
NAME_BOUNDS, STOP_BOUNDS, WORD_BOUNDS, OUTSIDE = (2.0, 4.0), (0.5, 1.0), (1.0, 2.0), 1.5
#: Texts without any license that are counted beside the table's, so that small tables weigh words like large ones.
PRIOR_TEXTS = 1000
_TOKEN = r"[^a-z0-9.\-]+"
_ENDS = r"(?<=[.!?])(?<![ (]v\.)\s+"
_PARAGRAPHS = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
_VERSION = r"^v(?=[0-9])|(?<=[0-9])\.0$"


def _tokens_py(text: str) -> dict[str, int]:
    """Each token and how often it stands there, in order."""
    tokens = (re.sub(_VERSION, "", t.strip(".-")) for t in re.split(_TOKEN, text.lower().replace("licence", "license")))
    return dict(sorted(Counter(x for x in tokens if x).items()))


def _tokens(text: Column) -> Column:
    """All tokens, ordered."""
    words = F.split(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), _TOKEN)
    return F.sort_array(F.filter(F.transform(words, lambda x: F.regexp_replace(F.btrim(x, F.lit(".-")), _VERSION, "")), lambda x: x != ""))


def _tf(count: Column) -> Column:
    return F.lit(1.0) + F.log(count.cast("double"))


def _is_name(token: str) -> bool:
    return token in NAMES or token.startswith(("gpl-", "lgpl-", "agpl-", "apache-", "mpl-", "bsd-", "cc-", "cc0-")) or re.fullmatch(r"[0-9.]{1,3}", token) is not None


VOCABULARY = tuple(sorted({t for _, x, _ in TEMPLATES for t in _tokens_py(x)} | set(ANCHORS)))
#: As texts write them, before _VERSION: form to word.
_FORMS = {f: t for t in VOCABULARY for f in ((t, f"v{t}", f"{t}.0", f"v{t}.0") if t[-1].isdigit() else (t, t.replace("license", "licence")))}


def _sentences(files: DataFrame) -> DataFrame:
    """file_id, tokens (distinct, ordered) and counts of each distinct sentence that holds an anchor word: of each line, and
    of paragraphs with their lines joined."""
    quick = r"(?i)(licen[cs]e|copyright|permission|redistribution|waived|unencumbered|gpl|\bcc\b)"
    lines = F.flatten(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(quick)), lambda x: F.split(x, _ENDS)))
    joined = F.transform(F.filter(F.split("text", _PARAGRAPHS), lambda x: x.rlike(quick) & x.contains("\n")), lambda x: F.split(F.translate(x, "\n", " "), _ENDS))
    s = files.filter(F.col("text").rlike(quick)).select("file_id", F.explode(F.filter(F.array_union(lines, F.flatten(joined)), lambda x: x.rlike(quick))).alias("__s"))
    anchors = F.array(*map(F.lit, ANCHORS))
    s = s.select("file_id", _tokens(F.col("__s")).alias("__all")).filter(F.arrays_overlap("__all", anchors)).distinct()
    first = F.filter(F.sequence(F.lit(0), F.size("__all") - 1), lambda i: (i == 0) | (F.get("__all", i) != F.get("__all", i - 1)))
    s = s.withColumn("__first", first)
    ends = F.concat(F.slice("__first", F.lit(2), F.size("__first")), F.array(F.size("__all")))
    return s.select("file_id", F.transform("__first", lambda i: F.get("__all", i)).alias("tokens"), F.zip_with("__first", ends, lambda a, z: z - a).alias("counts"))


def frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and in how many each word of the vocabulary occurs; one row comes back, of fixed size."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), _TOKEN)
    own = F.array_intersect(F.transform(words, lambda x: F.btrim(x, F.lit(".-"))), F.array(*map(F.lit, sorted(_FORMS))))
    counted = files.select(F.explode(own).alias("w")).groupBy("w").count()
    found: dict[str, int] = {}
    for r in counted.collect():  # at most len(_FORMS) rows
        found[_FORMS[r["w"]]] = found.get(_FORMS[r["w"]], 0) + r["count"]
    n = files.count()
    return n, {w: min(c, n) for w, c in found.items()}


def weights(n: int, df: dict[str, int], words=VOCABULARY) -> dict[str, float]:
    """IDF of the words within their bounds."""
    out = {}
    for w in words:
        low, high = NAME_BOUNDS if _is_name(w) else STOP_BOUNDS if w in STOP else WORD_BOUNDS
        out[w] = min(high, max(low, math.log((1 + n + PRIOR_TEXTS) / (1 + df.get(w, 0))) + 1))
    return out


def detect(files: DataFrame, *, templates=TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """file_id, license and cosine of the best sentence of each text that reaches min_cosine: the smaller rank, then the
    greater cosine, then the smaller name."""
    n, df = frequencies(files)
    idf = weights(n, df, sorted(set(VOCABULARY) | {t for _, x, _ in templates for t in _tokens_py(x)}))
    table = F.create_map(*[x for w, v in idf.items() for x in (F.lit(w), F.lit(v))])
    s = _sentences(files)
    norm = F.sqrt(F.aggregate(F.zip_with("tokens", "counts", lambda x, c: F.coalesce(F.try_element_at(table, x), F.lit(OUTSIDE)) * _tf(c)), F.lit(0.0), lambda a, x: a + x * x))
    s = s.select("file_id", "tokens", "counts", norm.alias("norm"), F.array_intersect("tokens", F.array(*map(F.lit, sorted(OTHERS)))).alias("others"))
    forms = []
    for name, text, rank in templates:
        own = _tokens_py(text)
        must = [t for t in own if _is_name(t)]
        tf = {t: 1 + math.log(c) for t, c in own.items()}
        words = F.array(*[F.struct(F.lit(t).alias("w"), F.lit(idf[t] ** 2 * tf[t]).alias("x")) for t in own])
        length = math.sqrt(sum((idf[t] * tf[t]) ** 2 for t in own))
        texts = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
        forms.append(F.struct(F.lit(name).alias("license"), F.lit(rank).alias("rank"), words.alias("words"), F.lit(length).alias("length"), texts(must).alias("must"), texts(t for t in own if t in ANCHORS).alias("anchors"), texts(own).alias("own")))
    holds = lambda t: (F.size(F.array_except(t["must"], F.col("tokens"))) == 0) & F.arrays_overlap(t["anchors"], F.col("tokens")) & (F.size(F.array_except(F.col("others"), t["own"])) == 0)
    fits = F.filter(F.array(*forms), holds)
    tf_of = lambda w: F.coalesce(_tf(F.get("counts", F.array_position("tokens", w).cast("int") - 1)), F.lit(0.0))
    dot = lambda t: F.aggregate(t["words"], F.lit(0.0), lambda a, x: a + x["x"] * tf_of(x["w"]))
    scored = F.transform(fits, lambda t: F.struct((dot(t) / (F.col("norm") * t["length"])).alias("cosine"), t["license"].alias("license"), t["rank"].alias("rank")))
    s = s.select("file_id", F.explode(scored).alias("m")).filter(F.col("m.cosine") >= min_cosine)
    first = F.min(F.struct("m.rank", (-F.round("m.cosine", 9)).alias("__c"), F.col("m.license").alias("license"), F.col("m.cosine").alias("cosine")))
    return s.groupBy("file_id").agg(first.alias("b")).select("file_id", "b.license", "b.cosine")


def parents(path: Column) -> Column:
    """Directories above a path, nearest first, the root '' last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def license_scan(files: DataFrame, *, templates=TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The license of every file.

    files: file_id, path, text, is_license (whether it is a license file of its directory; null: no); others ignored.
    Returns file_id, license, cosine, origin: own (a sentence of the text states it), inherited (the license file of the
    nearest directory above states it; from: that directory) or none (license null).

    Null texts state nothing and inherit; a null path is in no directory and inherits nothing. Of several license files in
    a directory the highest cosine, then the smaller name counts. Rows that repeat a file_id share the best sentence of
    all of them. Long texts are read whole. Empty tables give an empty result.
    """
    st = Stages(files.sparkSession, "licenses")
    f = files.select("file_id", "path", "text", F.coalesce("is_license", F.lit(False)).alias("is_license"))
    found = st.save(detect(f, templates=templates, min_cosine=min_cosine))
    light = f.select("file_id", "path", "is_license")
    rows = st.save(light.join(found.withColumnRenamed("file_id", "__f"), F.col("file_id").eqNullSafe(F.col("__f")), "left").drop("__f"))
    # license by directory: small against the files, yet joined by directory, which is pre-aggregated
    dirs = rows.filter("is_license and license is not null and path is not null").select(F.get(parents(F.col("path")), F.lit(0)).alias("dir"), "license", "cosine")
    dirs = st.save(dirs.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("dir", F.col("b.license").alias("dir_license")))
    # nearest directory above that has one, found once for each distinct directory
    own = F.get(parents(F.col("path")), F.lit(0))
    open_dirs = rows.filter("license is null and path is not null").select(own.alias("at")).distinct()
    chain = open_dirs.select("at", F.posexplode(F.concat(F.array("at"), F.when(F.col("at") != "", parents(F.col("at"))).otherwise(F.array().cast("array<string>")))).alias("up", "dir"))
    nearest = chain.join(dirs, "dir").groupBy("at").agg(F.min(F.struct("up", "dir", "dir_license")).alias("b"))
    nearest = st.save(nearest.select(F.col("at").alias("__at"), F.col("b.dir").alias("from"), F.col("b.dir_license").alias("__inherited")))
    out = rows.withColumn("__own", F.when(F.col("license").isNull(), own)).join(nearest, F.col("__own") == F.col("__at"), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("__inherited").isNotNull(), "inherited").otherwise("none")
    return out.select("file_id", F.coalesce("license", "__inherited").alias("license"), "cosine", origin.alias("origin"), "from")


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files source/lang/doc_id. A short text (25 words at most) that states a license serves as the license
    file of its directory."""
    # a 26th word: found at the head of the text, so long texts are not counted to their ends
    long = F.coalesce(F.col("text").rlike(r"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){25}[^\x20\x09-\x0D]"), F.lit(False))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), id_in().cast("string"))
    return docs.select(id_in().alias("file_id"), path.alias("path"), "text", (~long).alias("is_license"))
