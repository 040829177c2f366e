"""Classification and run-level metrics; true and false positives are counted once, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def per_class(df: DataFrame, labels: list, gold: str = "gold", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """by, label, tp, fp, fn, support, precision, recall, f1. Every label is listed; a null prediction is a miss of its
    gold class only; rows whose gold label is not listed take no part."""
    rows = df.where(F.col(gold).isin(*labels))
    tall = rows.select(*by, F.explode(F.filter(
        F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), (F.col(gold).eqNullSafe(F.col(pred))).cast("int").alias("hit")),
                F.when(~F.col(gold).eqNullSafe(F.col(pred)) & F.col(pred).isNotNull(),
                       F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(0).alias("hit")))),
        lambda x: x.isNotNull())).alias("x"))
    got = tall.groupBy(*by, F.col("x.label").alias("label")).agg(
        F.sum("x.hit").alias("tp"), F.sum(1 - F.col("x.g")).alias("fp"), F.sum(F.col("x.g") - F.col("x.hit")).alias("fn"),
        F.sum("x.g").alias("support"))
    groups = rows.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = groups.select(*by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    out = every.join(got, [*by, "label"], "left").na.fill(0, ["tp", "fp", "fn", "support"])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro_micro(classes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    sums = classes.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumn("micro_precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "micro_recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn(
        "micro_f1", f1(F.col("micro_precision"), F.col("micro_recall"))).drop("tp", "fp", "fn")


def set_scores(pred: Column, gold: Column) -> Column:
    """Struct p, r, f of two arrays as sets: all 1 if both are empty, 0 if one is."""
    a, b = F.array_distinct(F.array_compact(pred)), F.array_distinct(F.array_compact(gold))
    both, one = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    n = F.size(F.array_intersect(a, b))

    def guarded(x: Column) -> Column:
        return F.when(both, F.lit(1.0)).when(one, F.lit(0.0)).otherwise(x)

    p, r = ratio(n, F.size(a)), ratio(n, F.size(b))
    return F.struct(guarded(p).alias("p"), guarded(r).alias("r"), guarded(f1(p, r)).alias("f"))


def multilabel(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """label, tp, fp, fn, support of array columns as sets; labels come from both sides."""
    tall = df.select(F.explode(F.array_union(gold, pred)).alias("label"), gold, pred)
    g, p = F.array_contains(gold, F.col("label")), F.array_contains(pred, F.col("label"))
    return tall.groupBy("label").agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(g).alias("support"))


# Two-sided 95% points of Student's t by degrees of freedom; any other number counts as normal.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201,
       12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086, 25: 2.060, 30: 2.042}


def t95(df: Column) -> Column:
    """Two-sided 95% point of Student's t by degrees of freedom."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in T95.items() for x in kv])[df.cast("int")], F.lit(1.96))


def mean_se_ci(df: DataFrame, value: str) -> DataFrame:
    """n, mean, sd (0 for one run), se and the half width of the 95% interval over runs."""
    s = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    half = F.when(F.col("n") > 1, t95(F.col("n") - 1) * F.col("se")).otherwise(0.0)
    return s.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("ci95", half)


def with_average_rank(df: DataFrame, column: str, name: str, buckets: int = 256) -> DataFrame:
    """df with the rank of column from 1 as name, ties sharing their average; null has no rank.

    Distinct values are numbered within buckets cut at approximate quantiles, and buckets by their counts: the ranks are
    exact wherever the cuts lie, and no task sorts the whole column.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = values.agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)])).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("_v"))) if cuts else F.lit(0)
    values = values.withColumn("_b", bucket)
    sums = values.groupBy(F.col("_b").alias("_c")).agg(F.sum("_n").alias("_m"))  # at most `buckets` rows
    sums = sums.select("_c", F.coalesce(F.sum("_m").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_n").over(W.partitionBy("_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = values.withColumn("_w", within).join(sums, F.col("_b") == F.col("_c")).select(
        "_v", (F.col("_before") + F.col("_w") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
