"""What the operators share: stage tables in the shared folder, ids, joins to small tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null id inside an operator, after all others; results carry null again.
NULL_ID = 2**63 - 1
#: Largest number of rows that join_small() broadcasts; beyond it the join is salted.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_in(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_out(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name)).alias(name)


def numbered(docs: DataFrame, st: Stages) -> tuple[DataFrame, bool]:
    """docs as rest (a struct of all columns but text), text and __doc: a number for each row, in order of doc_id, null last;
    and whether the number is the id.

    Where ids are unique that is the id itself. Otherwise rows that share an id, or have none, are dealt by range, ordered
    by id and text, and numbered in a written copy; equal rows then differ in their number only.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*columns).alias("rest"), "text", id_in().alias("__doc"))
    if rows.groupBy("__doc").count().filter("count > 1").isEmpty():
        return rows, True
    order = [F.col("__doc"), F.xxhash64("text"), F.col("__at")]
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return st.save(dealt.select("rest", "text", F.monotonically_increasing_id().alias("__doc"))), False


def ordinals(df: DataFrame, keys: list[str], st: Stages, name: str = "__ord") -> DataFrame:
    """Adds the place of each row among those of equal keys, from 0. Rows are numbered within each partition, and partitions
    by their counts, so no group of a key is ever gathered. Reads df once and writes it."""
    d = st.save(df.withColumn("__part", F.spark_partition_id()))
    counts = d.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("__part", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(F.lit(0))) - 1
    same = [d["__part"] == base["__part"], *[d[k].eqNullSafe(base[f"__k{i}"]) for i, k in enumerate(keys)]]
    out = d.withColumn("__in", within).join(base.hint("merge"), reduce(and_, same))
    return out.select(*[d[c] for c in df.columns], (F.col("__base") + F.col("__in")).alias(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs on this machine alone, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Stages:
    """Tables written to the shared folder between the steps of an operator.

    A written table cuts the lineage: a lost executor costs the running step only. drop() removes tables that no later
    step reads; free() lets Spark's cleaner delete the shuffle files of finished steps.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._quantloom_path = path
        del df
        self.free()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, p = _fs(self.spark, t._quantloom_path)
            fs.delete(p, True)

    def free(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


def join_small(big: DataFrame, small: DataFrame, on: list[str], salts: int = 64) -> DataFrame:
    """Left join, nulls equal, to a saved table that is small as a rule. Up to BROADCAST_ROWS rows it is broadcast; a
    larger one is repeated for each salt, so that a hot key of the big side is dealt over many tasks."""
    cols = [c for c in small.columns if c not in on]
    s = small.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *cols)
    if small.count() <= BROADCAST_ROWS:
        cond = [big[c].eqNullSafe(s[f"__k{i}"]) for i, c in enumerate(on)]
        return big.join(F.broadcast(s), cond, "left").drop(*[f"__k{i}" for i in range(len(on))])
    b = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    s = s.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = [b[c].eqNullSafe(s[f"__k{i}"]) for i, c in enumerate(on)] + [b["__salt"] == s["__s"]]
    return b.join(s, cond, "left").drop("__salt", "__s", *[f"__k{i}" for i in range(len(on))])
