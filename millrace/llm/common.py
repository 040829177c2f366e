"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: space and the controls \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
#: A word, as a regular expression for Java.
WORD = r"[^\x20\x09-\x0D]+"

#: Setting under which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Column of row numbers.
ROW = "_row"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver's code lies."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (where it is unset, as in tests) one of our own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_millrace_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext._millrace_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


class Workspace:
    """Tables written to the shared folder; they cut lineage, so a lost executor costs only the current stage."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """df written and read again; with release, executors remove the write's shuffle files as soon as it is done, and
        not whenever the driver's memory happens to be collected."""
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true" if release else before)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows, and characters of JSON (about a quarter of the bytes of rows of numbers, at the least), of a table that is broadcast.
SMALL_ROWS, SMALL_CHARS = 100_000, 16 << 20


def with_small(df: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with a table that is broadcast only after its rows and their lengths have been added up; a larger one is joined
    by shuffle."""
    head = small.limit(SMALL_ROWS + 1).select(F.length(F.to_json(F.struct("*"))).alias("n"))
    rows, chars = head.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows <= SMALL_ROWS and chars <= SMALL_CHARS:
        small = F.broadcast(small)
    return df.join(small, on, how)


def numbered(docs: DataFrame, space: Workspace, nulls_first: bool = True) -> DataFrame:
    """docs with ROW, a number of its own for each row: in the order of doc_id (null first or last) and a hash of the text.

    Where every row has a doc_id of its own, that is the number; otherwise the table is dealt by range and written.
    """
    doc = F.col("doc_id").cast("long")
    odd = docs.groupBy(doc.alias("doc")).agg(F.count("*").alias("n")).where("doc is null or n > 1")
    if not odd.limit(1).count():
        return docs.withColumn(ROW, doc)
    n_parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.struct(*docs.columns).alias("d"), doc.alias("doc"), F.xxhash64("text").alias("tie"), F.rand(1).alias("copy"))
    order = [F.asc_nulls_first("doc") if nulls_first else F.asc_nulls_last("doc"), "tie", "copy"]
    own = own.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    return space.save(own.select("d.*", F.monotonically_increasing_id().alias(ROW)), "numbered")


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), component the smallest node reached; edges has long a, b.

    Large-star and small-star rounds, each a partial minimum and an equi-join (which Spark splits if a node is hot),
    until every edge points from a node to its component.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    e = space.save(e, "cc0")
    last, k = None, 0
    while True:
        k += 1
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e1 = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # small star: smaller neighbours and the node itself are linked to the smallest
        low2 = e1.groupBy("u").agg(F.min("v").alias("m"))
        j = e1.join(low2, "u")
        e2 = (
            j.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        e2 = space.save(e2, f"cc{k}")
        stat = e2.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        space.drop(f"cc{k - 1}")
        e = e2
        if stat == last:
            break
        last = stat
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
