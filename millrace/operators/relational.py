"""Keyed merges, ordered dedup, comparison, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, pos: str, empty_repeats: bool = True) -> DataFrame:
    """The first row of each key; rows with an empty key all stay if empty_repeats. Null is a key like any other.

    The filter on the row number alone lets each task cut its groups to one row before the shuffle; rows with an empty
    key never enter the window.
    """
    n = F.row_number().over(W.partitionBy(key).orderBy(pos))
    if not empty_repeats:
        return df.withColumn("_n", n).where("_n = 1").drop("_n")
    empty = F.coalesce(F.col(key) == "", F.lit(False))
    return df.where(~empty).withColumn("_n", n).where("_n = 1").drop("_n").unionByName(df.where(empty))


def keep_last(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key: a partial maximum, not a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("_r")).select(key, "_r.*")


def ordered_union(df: DataFrame, key: str, pos: str, record: str) -> DataFrame:
    """key, place of the first, record of the last, repeats that equal or differ from the record before them."""
    before = F.lag(record).over(W.partitionBy(key).orderBy(pos))
    marked = df.withColumn("_b", before).withColumn("_first", F.row_number().over(W.partitionBy(key).orderBy(pos)) == 1)
    return marked.groupBy(key).agg(
        F.min(pos).alias("first_pos"), F.max_by(record, pos).alias(record),
        F.count_if(~F.col("_first") & F.col(record).eqNullSafe(F.col("_b"))).alias("same"),
        F.count_if(~F.col("_first") & ~F.col(record).eqNullSafe(F.col("_b"))).alias("differing"))


def compare(left: DataFrame, right: DataFrame, key: str, record: str) -> DataFrame:
    """key, outcome: equal, mismatch, only_left or only_right."""
    a, b = left.select(key, F.col(record).alias("_a"), F.lit(1).alias("_l")), right.select(key, F.col(record).alias("_b"), F.lit(1).alias("_r"))
    outcome = F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left").when(
        F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("mismatch")
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))


def update_join(base: DataFrame, patch: DataFrame, key: str, free: list[str], protected: list[str], overwrite: bool = False) -> DataFrame:
    """base with free columns replaced where the patch has a value; protected ones only if overwrite, else conflicts counted."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in free + protected])
    j = base.join(p, key, "left")
    out = j.withColumns({c: F.coalesce(f"_{c}", c) for c in free + (protected if overwrite else [])})
    conflict = sum((F.when(F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)), 1).otherwise(0) for c in protected), F.lit(0))
    return out.withColumn("conflicts", conflict if not overwrite else F.lit(0)).select(*base.columns, "conflicts")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done, keys, "left_anti")


def with_runs(df: DataFrame, runs: int) -> DataFrame:
    return df.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the first by hash."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")


#: Hexadecimal digits of a hash that name its bucket.
HASH_DIGITS = 4


def stratified_rank(df: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """df with rank, the place of a row in its stratum's hashed order; a null stratum is one, null keys come first.

    Rows are numbered within buckets of equal leading digits and the buckets by their counts, so no task sorts a stratum.
    """
    digits = F.coalesce(F.left(hash_order(key, seed), F.lit(HASH_DIGITS)), F.lit(""))
    own = df.withColumns({"_h": hash_order(key, seed), "_b": digits})
    counts = own.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    # a window over a stratum's buckets: at most 16 ** HASH_DIGITS + 1 rows
    before = F.sum("_n").over(W.partitionBy("_s").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_s", "_c", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = own.join(counts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    n = F.row_number().over(W.partitionBy("_s", "_c").orderBy("_h", key))
    return ranked.withColumn("rank", (F.col("_before") + n).cast("int")).select(*df.columns, "rank")


def nested_splits(df: DataFrame, stratum: str, key: str, spec: DataFrame, seed: int = 42) -> DataFrame:
    """Rows of each split of spec (split, stratum, n): prefixes of one hashed order, so splits nest."""
    ranked = stratified_rank(df, stratum, key, seed)
    return ranked.join(F.broadcast(spec), stratum).where("rank <= n").drop("n")
