"""URL verdicts by rules and by a Bloom filter cascade; DataFrame functions only.

The cascade holds a set of listed keys exactly, over a known universe of keys. Level 1 is a Bloom filter of the listed
keys; level 2 a filter of those other keys of the universe that level 1 lets through; level 3 of the listed keys that
level 2 lets through, and so on until nothing is let through wrongly. A key of the universe is listed if the first level
that rejects it is even, or if none does and the number of levels is odd. No join is needed to ask: a level is a vector of
64-bit words that a scalar subquery puts into the expression. A universe whose levels would pass MAX_WORDS is dealt by hash over
cascades of its parts, which are asked one after the other, so that no more than one part's vectors are ever held.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Stages

#: Longest vector of words of one level (8 MB); build() refuses more keys, and cascades() deals them over parts.
MAX_WORDS = 1 << 20
#: Bits set for each key in its word.
BITS = 4


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every domain above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _mask(key: Column, level: int) -> Column:
    h = F.xxhash64(key, F.lit(1000 + level))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", h, F.lit(6 * i)).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return out


def _slot(key: Column, level: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level)), F.lit(words)).cast("int")


class Cascade:
    """levels: a one-row DataFrame (words array<long>) and its length for each level."""

    def __init__(self, levels: list[tuple[DataFrame, int]]):
        self.levels = levels

    def vectors(self) -> list[Column]:
        """The levels' words as columns, which a projection below the question must add."""
        return [df.scalar().alias(f"__level{i}") for i, (df, _) in enumerate(self.levels)]

    def _hit(self, key: Column, i: int) -> Column:
        mask = _mask(key, i)
        return F.get(F.col(f"__level{i}"), _slot(key, i, self.levels[i][1])).bitwiseAND(mask) == mask

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe. The row has vectors()."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self._hit(key, i), F.lit(i % 2 == 1)).otherwise(out)
        return out


class TooManyKeys(ValueError):
    """A level would be longer than allowed."""


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(4099)), F.lit(parts))


def cascades(listed: DataFrame, universe: DataFrame, *, bits_per_key: float = 10.0, max_words: int = MAX_WORDS) -> list[Cascade]:
    """A cascade for each part of the keys by part_of(), as few parts as keep every level within max_words."""
    parts = 1
    while True:
        try:
            own = lambda df, j, n=parts: df.filter(part_of(F.col("key"), n) == j)
            return [build(own(listed, j), own(universe, j), bits_per_key=bits_per_key, max_words=max_words) for j in range(parts)]
        except TooManyKeys:
            parts *= 2


def _within(cascade: Cascade, part: int, parts: int):
    """The question to one part's cascade; keys of other parts are not in it."""
    return cascade.contains if parts == 1 else lambda key: (part_of(key, parts) == part) & cascade.contains(key)


def build(listed: DataFrame, universe: DataFrame, *, bits_per_key: float = 10.0, max_words: int = MAX_WORDS) -> Cascade:
    """listed, universe: one column key, distinct, not null; keys listed but outside the universe are never asked for and
    are left out. Each level has at most max_words words."""
    spark = universe.sparkSession
    st = Stages(spark, "cascade")
    u = universe.select("key").distinct().withColumn("__u", F.lit(1))
    own = listed.select("key").filter("key is not null").distinct().withColumn("__in", F.lit(True))
    keys = st.save(u.join(own, "key", "left").select("key", F.coalesce("__in", F.lit(False)).alias("inside")))
    current, other = keys.filter("inside").select("key"), keys.filter("not inside").select("key")
    levels: list[tuple[DataFrame, int]] = []
    while True:
        n = current.count()
        if not n and levels:
            break
        words = max(1, math.ceil(n * bits_per_key / 64))
        if words > max_words:
            raise TooManyKeys(f"{n} keys at one level")
        i = len(levels)
        filled = current.groupBy(_slot(F.col("key"), i, words).alias("slot")).agg(F.bit_or(_mask(F.col("key"), i)).alias("word"))
        empty = spark.range(words).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("word"))
        row = filled.unionByName(empty).groupBy("slot").agg(F.bit_or("word").alias("word")).agg(F.array_sort(F.collect_list(F.struct("slot", "word")))["word"].alias("words"))
        levels.append((st.save(row), words))
        cascade = Cascade(levels)
        current, other = st.save(other.withColumns({f"__level{i}": levels[i][0].scalar()}).filter(cascade._hit(F.col("key"), i)).select("key")), current
        if i > 60:
            raise RuntimeError("the cascade does not end: are all keys distinct?")
    return Cascade(levels)


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, *, bits_per_key: float = 10.0, max_words: int = MAX_WORDS) -> DataFrame:
    """A verdict for every row of pages (page_id, url; other columns ignored).

    rules: (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest (host and path together, then host) wins. Where no rule fits, the verdict is block if the host or a domain
    above it is in listed (one column key), else allow.
    Returns page_id, host, path, rule (host and path; null if none), listed (boolean), verdict.

    Null urls and those without :// have an empty host and path, which no rule with a host fits and no list holds. Rows that
    repeat are judged one by one; a null page_id stays null; long urls are read whole; an empty table gives an empty result; an
    empty list blocks nothing.
    """
    st = Stages(pages.sparkSession, "urls")
    p = st.save(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    universe = p.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    parts = cascades(listed, st.save(universe), bits_per_key=bits_per_key, max_words=max_words)
    for j, cascade in enumerate(parts):
        before = p
        asked = p.select("*", suffixes(F.col("host")).alias("__suffixes"), *cascade.vectors())
        hit = F.exists("__suffixes", _within(cascade, j, len(parts)))
        p = asked.select("page_id", "host", "path", (F.col("listed") | hit if j else hit).alias("listed"))
        if j + 1 < len(parts):
            p = st.save(p)
            st.drop(before)
    rule = F.lit(None).cast("string")
    ruled = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)
    out = p.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("__ruled"), "listed")
    return out.withColumn("verdict", F.coalesce("__ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))).drop("__ruled")
