"""Quality rules with adaptive thresholds; DataFrame functions only.

Counts that are natural to a text are turned into ratios. A KLL sketch of each ratio is built for each language and source
(mergeable: partial sketches of tasks, and later batches, combine). A group's upper limit is its upper quantile plus
`reach` times its spread, the distance from its median; a group without a spread counts as having a small one. Quantiles are
means of the group's own and of its language's, whose sketch is merged from its sources; a group of n rows weighs n, its
language PRIOR_ROWS. The limits, a row for each group, are then joined to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Stages, id_in, join_small


@dataclass(frozen=True)
class Rule:
    """Reject above q(upper) + reach * max(q(upper) - q(0.5), spread)."""

    name: str
    spread: float
    upper: float = 0.9
    reach: float = 3.0


#: spread: what clean texts of a like kind may differ by; it counts where a group's own is smaller.
RULES = (Rule("mean_word", 0.5), Rule("symbol_ratio", 0.05), Rule("dup_line_ratio", 0.1), Rule("repeat_ratio", 0.1))
#: Rows that the language's sketch counts as beside a group's own.
PRIOR_ROWS = 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_BLANKS = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), lambda x: x != "")


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and drops the text; keep: columns that stay."""
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, _BLANKS + " ", "")) > 0)
    d = d.select(
        *keep,
        _words(F.col("__t")).alias("__w"),
        F.length(F.translate("__t", _BLANKS + " ", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    base = [*keep, "word_chars", "n_symbols"]
    # windows as (hash, place), ordered, so that equal windows are neighbours
    at = F.when(F.size("__w") >= 3, F.sequence(F.lit(0), F.size("__w") - 3)).otherwise(F.array().cast("array<int>"))
    d = d.select(
        *base,
        F.size("__w").cast("long").alias("n_words"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.transform(F.col("__w"), lambda x: F.xxhash64(x)).alias("__h"),
        at.alias("__at"),
    )
    base += ["n_words", "n_dup_lines"]
    d = d.select(*base, F.sort_array(F.transform("__at", lambda i: F.struct(F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2)).alias("h"), i.alias("i")))).alias("__s"))
    d = d.select(*base, "__s", F.transform("__s", lambda x: x["h"]).alias("__g"))
    same = lambda x, i: (x["h"] == F.get("__g", i - 1)) | (x["h"] == F.get("__g", i + 1))
    d = d.select(*base, F.sort_array(F.transform(F.filter("__s", same), lambda x: x["i"])).alias("__r"))
    gaps = F.zip_with("__r", F.slice("__r", F.lit(2), F.greatest(F.size("__r") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b, a + 3) - a, F.lit(3)))
    return d.select(*base, F.aggregate(gaps, F.lit(0).cast("int"), lambda s, x: s + x).cast("long").alias("n_repeat_words"))


def ratios(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return d.withColumns(
        {
            "mean_word": F.col("word_chars") / n,
            "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
            "dup_line_ratio": F.col("n_dup_lines") / n * F.lit(10.0),
            "repeat_ratio": F.col("n_repeat_words") / n,
        }
    )


def limits(measured: DataFrame, rules=RULES, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """lang, source and an upper limit for each rule, from the sketches of documents that pass the base rules."""
    passing = measured.filter(~F.col("base_failed"))
    own = passing.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n"), *[F.kll_sketch_agg_double(r.name).alias(f"__k_{r.name}") for r in rules])
    lang = own.groupBy(F.col("lang").alias("__lang")).agg(*[F.kll_merge_agg_double(f"__k_{r.name}").alias(f"__m_{r.name}") for r in rules])
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("__lang")))
    own_share = F.col("__n") / (F.col("__n") + F.lit(float(prior_rows)))
    out = [F.col("lang"), F.col("source")]
    for r in rules:
        at = lambda q, r=r: sum(F.kll_sketch_get_quantile_double(f"__{k}_{r.name}", F.lit(q)) * w for k, w in (("k", own_share), ("m", 1 - own_share)))
        hi, mid = at(r.upper), at(0.5)
        out.append((hi + F.lit(r.reach) * F.greatest(hi - mid, F.lit(r.spread))).alias(f"max_{r.name}"))
    return both.select(*out)


def row_hash() -> Column:
    return F.xxhash64("text", F.col("lang").cast("string"), F.col("source").cast("string"))


def quality_rules(docs: DataFrame, rules=RULES, *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """A verdict for each row of docs (doc_id, text, lang, source; other columns ignored).

    Returns doc_id, lang, source, row_hash (of text, lang and source, to find the row again), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the ratios and limits,
    base_failed (n_words < min_words, or 100 * n_repeat_words > max_repeat_percent * n_words) and kept (passes the base
    rules and is above no limit of its language and source).

    Null text has no words and fails the base rules. Null lang or source are groups like others. Rows that repeat are
    judged one by one; a ratio equal to its limit passes. Where no document of a group passes the base rules there is no
    limit. A text is held whole in one task, however long. An empty table gives an empty result.
    """
    st = Stages(docs.sparkSession, "quality")
    d = ratios(counts(docs.select(id_in().alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text").withColumn("row_hash", row_hash()), ["doc_id", "lang", "source", "row_hash"]))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    d = st.save(d.withColumn("base_failed", failed))
    lim = st.save(limits(d, rules, prior_rows))
    out = join_small(d, lim, ["lang", "source"]).select(d["*"], *[f"max_{r.name}" for r in rules])
    above = F.lit(False)
    for r in rules:
        above = above | F.coalesce(F.col(r.name) > F.col(f"max_{r.name}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~above)
