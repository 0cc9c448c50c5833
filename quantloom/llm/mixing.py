"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source has a weight and a cap (max_epochs times its own size). Targets share total_share times all sizes by weight;
a source whose share passes its cap stops there and the excess goes to the others by weight, until none is above. In
closed form: order the sources by cap / weight; with the sources before the k-th clamped, the level is
(total - their caps) / (weights of the rest), and the first source whose cap / weight reaches the level ends the clamping.

A source then takes floor(epochs) whole copies of each document and, of the fractional epoch, the documents whose seeded
hash falls below a threshold. The threshold comes from a mergeable histogram of size by hash (at most HASH_BUCKETS rows a
source), so that no source is ever ordered in one task; large documents are chosen first and the small ones make up for
what those miss of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Stages, id_in, join_small, ordinals

#: Buckets of the seeded hash in which a source's sizes are summed.
HASH_BUCKETS = 4096
#: A document above a 1 / LARGE of its source is large.
LARGE = 200
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(weights: list[float]):
    """Weights dealt to the sources in turn, by code point, null last."""

    def of(sources: DataFrame) -> DataFrame:
        w = Window.orderBy(F.col("source").asc_nulls_last())
        k = F.pmod(F.row_number().over(w) - 1, F.lit(len(weights)))
        return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), k.cast("int") + 1))

    return of


def targets(sources: DataFrame, total_share: float, max_epochs: float) -> DataFrame:
    """sources: source, weight, source_size (one row a source). Adds target. Only this table, a row for each source, is
    ordered in one task. Sources without words get 0; where all caps together are below the total, every source gets its cap."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    s = sources.withColumn("__cap", cap).withColumn("__r", F.col("__cap") / F.col("weight"))
    up = Window.orderBy("__r", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(total_share))).alias("__total"),
        F.coalesce(F.sum("__cap").over(before), F.lit(0.0)).alias("__clamped"),
        F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("__rest"),
        F.row_number().over(up).alias("__k"),
    ).withColumn("__level", (F.col("__total") - F.col("__clamped")) / F.col("__rest"))
    first = F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__k", "__level"))).over(everything)
    s = s.withColumn("__final", first["__level"])
    target = F.when(F.col("__final").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__final") * F.col("weight")))
    return s.select("source", "weight", "source_size", target.alias("target"))


def _cuts(hist: DataFrame) -> DataFrame:
    """Of each source, the first bucket that is not taken, so that the size before it comes nearest to __goal, and that size."""
    run = F.sum("__s").over(Window.partitionBy("source").orderBy("__b"))
    taken = F.col("__run") - F.col("__s") / 2 < F.col("__goal")
    return hist.withColumn("__run", run).groupBy("source").agg(F.max(F.when(taken, F.col("__b") + 1)).alias("__cut"), F.max(F.when(taken, F.col("__run"))).alias("__got"))


def mix_sources(docs: DataFrame, weights, *, total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, text, source, other columns ignored. weights: a function that adds weight (above 0) to the table of
    sources (source, source_size), such as cyclic_weights().
    Returns doc_id, source, size, source_size, target, copies, taken: size is the number of words, copies how often the
    mix repeats the document, taken = size * copies.

    Null or empty text has size 0 and copies of floor(epochs) at most one more; null is a source like any other, last in
    order. Rows that repeat a doc_id are documents of their own: their hashes differ by their size, source or, among rows equal
    in these, a number; which of such rows gets which copies says nothing. Long texts are counted whole. An empty table gives
    an empty result. Reruns with the same seed agree, whatever the partitioning.
    """
    st = Stages(docs.sparkSession, "mix")
    sized = st.save(docs.select(id_in().alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    own = ["doc_id", "source", "size"]
    if sized.groupBy("doc_id").count().filter("count > 1").isEmpty():
        u = F.xxhash64("doc_id", F.lit(seed))
    else:
        sized = st.save(ordinals(sized, own, st))
        u = F.xxhash64(*own, "__ord", F.lit(seed))
    u = F.pmod(u, F.lit(HASH_BUCKETS)).cast("int")
    sources = weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    t = targets(sources, total_share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("__whole", F.floor(epochs + F.lit(1e-12)))
    t = st.save(t.withColumn("__want", F.greatest(F.lit(0.0), F.col("target") - F.col("__whole") * F.col("source_size"))))
    large = F.col("size") * F.lit(LARGE) > F.col("source_size")
    d = join_small(sized.withColumn("__b", u), t, ["source"]).select(sized["*"], "__b", "source_size", "target", "__whole", "__want", large.alias("__large"))
    hist = st.save(d.groupBy("source", "__large", "__b", "source_size", "__want").agg(F.sum("size").alias("__s")))
    # large documents first; the small ones then fill what is still wanted
    all_large = Window.partitionBy("source")
    some = _cuts(hist.filter("__large").withColumn("__goal", F.col("__want") * F.sum("__s").over(all_large) / F.col("source_size")))
    small = hist.filter("not __large").join(some.select(F.col("source").alias("__s1"), "__got"), F.col("source").eqNullSafe(F.col("__s1")), "left")
    rest = _cuts(small.withColumn("__goal", F.col("__want") - F.coalesce("__got", F.lit(0))))
    cuts = st.save(t.select("source").join(some.select(F.col("source").alias("__s1"), F.col("__cut").alias("__cut1")), F.col("source").eqNullSafe(F.col("__s1")), "left").join(rest.select(F.col("source").alias("__s2"), F.col("__cut").alias("__cut2")), F.col("source").eqNullSafe(F.col("__s2")), "left").select("source", "__cut1", "__cut2"))
    out = join_small(d, cuts, ["source"])
    chosen = F.col("__b") < F.coalesce(F.when(F.col("__large"), F.col("__cut1")).otherwise(F.col("__cut2")), F.lit(0))
    copies = (F.col("__whole") + chosen.cast("int")).cast("long")
    out = out.select(d["doc_id"], d["source"], "size", "source_size", "target", F.least(copies, F.lit(int(max_epochs)).cast("long")).alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))
