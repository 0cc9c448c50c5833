"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the key. A bucket above the byte limit splits on the next bit, and
only such buckets do, until every shard fits. Sizes are summed once for each prefix of COARSE bits (pre-aggregated before
the shuffle), so the directory follows from a table of bounded size; only buckets that are still too large at that depth
look at their rows again, with more bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Stages, id_in, ordinals

#: Bits of the first and each further round.
COARSE = 12
MAX_BITS = 60


def _bits(h: Column, depth: Column | int) -> Column:
    """The leading depth bits of a hash, as a string."""
    d = depth if isinstance(depth, Column) else F.lit(depth)
    return F.substring(F.lpad(F.conv(F.hex(h), 16, 2), 64, "0"), F.lit(1), d)


def shard(rows: DataFrame, *, limit: int) -> DataFrame:
    """Deals rows to shards of at most limit bytes.

    rows: key (long, hashed), n_bytes (long, null: 0); other columns are ignored.
    Returns key, n_bytes, shard, shard_bytes, oversize. shard is the prefix of the hash (of 0 to 60 bits), for rows whose
    hashes agree in MAX_BITS bits followed by + and the number of a part.

    A row above the limit by itself gets a shard of its own with oversize true; all other shards fit. Null keys hash like
    a key. Rows that repeat a key stay together unless they pass the limit together; then they are dealt in turn over parts,
    and which row is in which part may differ between runs. An empty table gives an empty result.
    """
    st = Stages(rows.sparkSession, "shard")
    size = F.coalesce(F.col("n_bytes"), F.lit(0)).cast("long")
    r = st.save(rows.select("key", size.alias("n_bytes"), F.xxhash64(F.col("key")).alias("__h")))
    alone = r.filter(F.col("n_bytes") > limit)
    open_rows = r.filter(F.col("n_bytes") <= limit)
    done = []
    depth, root = 0, F.lit("")
    while True:
        low, high = depth, min(MAX_BITS, depth + COARSE)
        cells = st.save(open_rows.groupBy(_bits(F.col("__h"), high).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")))
        up = cells.select("cell", "b", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d")).withColumn("shard", F.substring(F.col("cell"), F.lit(1), F.col("d")))
        sums = up.groupBy("shard", "d").agg(F.sum("b").alias("shard_bytes"))
        fits = up.join(sums, ["shard", "d"]).filter(F.col("shard_bytes") <= limit)
        leaf = fits.groupBy("cell").agg(F.min(F.struct("d", "shard", "shard_bytes")).alias("l"))
        leaf = st.save(cells.join(leaf, "cell", "left").select("cell", F.col("l.shard").alias("shard"), F.col("l.shard_bytes").alias("shard_bytes")))
        placed = open_rows.withColumn("cell", _bits(F.col("__h"), high)).join(F.broadcast(leaf) if leaf.count() <= 1 << COARSE + 1 else leaf, "cell")
        done.append(placed.filter("shard is not null").select("key", "n_bytes", "shard", "shard_bytes"))
        if leaf.filter("shard is null").isEmpty():
            break
        rest = placed.filter("shard is null").select("key", "n_bytes", "__h")
        if high == MAX_BITS:
            # rows of one hash: in turn over parts that fit; each part takes floor(limit / largest row) rows
            largest = rest.groupBy("__h").agg(F.max("n_bytes").alias("__m")).withColumnRenamed("__h", "__g")
            parts = ordinals(rest, ["__h"], st).join(largest.hint("merge"), F.col("__h") == F.col("__g"))
            per = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("__m"), F.lit(1))), F.lit(1))
            parts = st.save(parts.withColumn("shard", F.concat(_bits(F.col("__h"), high), F.lit("+"), F.floor(F.col("__ord") / per).cast("string"))).select("key", "n_bytes", "shard"))
            sums = parts.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
            done.append(parts.join(sums, "shard").select("key", "n_bytes", "shard", "shard_bytes"))
            break
        open_rows, depth = st.save(rest), high
    lone = F.concat(_bits(F.col("__h"), MAX_BITS), F.lit("!"), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit("+"), F.col("__ord").cast("string"))
    out = ordinals(alone, ["key"], st).select("key", "n_bytes", lone.alias("shard"), F.col("n_bytes").alias("shard_bytes"), F.lit(True).alias("oversize"))
    for d in done:
        out = out.unionByName(d.withColumn("oversize", F.lit(False)))
    return out


def shard_documents(docs: DataFrame, *, limit: int) -> DataFrame:
    """documents by doc_id and the UTF-8 bytes of their texts (null: 0)."""
    return shard(docs.select(id_in().alias("key"), F.octet_length("text").cast("long").alias("n_bytes")), limit=limit).withColumnRenamed("key", "doc_id")
