"""Grids of evaluation runs as dimension tables: models, budgets, prompt variants, repeats; what is done is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import pending


def run_grid(spark: SparkSession, models: list[str], budgets: list[str] = ("",), variants: list[str] = ("original",), repeats: int = 1) -> DataFrame:
    """A row for each run: model, budget, effort and max_tokens (a number is a bound on tokens, 0 means no effort, a word is
    an effort; never both), variant, run_id, run_name."""
    d = spark.range(1)
    for name, values in (("model", models), ("budget", budgets), ("variant", variants)):
        d = d.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("run_id")).drop("id")
    number = F.try_to_number("budget", F.lit("9999999999")).cast("long")
    d = d.withColumn("effort", F.when(number == 0, F.lit("none")).when(number.isNull() & (F.col("budget") != ""), F.col("budget")))
    d = d.withColumn("max_tokens", F.when(number > 0, number))
    return d.withColumn("run_name", run_name(F.concat_ws("_", "model", F.nullif("budget", F.lit("")), "variant")))


def run_name(group: Column) -> Column:
    return F.replace(F.replace(group, F.lit("/"), F.lit("_")), F.lit("-"), F.lit("_"))


def to_run(grid: DataFrame, samples: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Every sample of every run but those done (model, budget, variant, run_id, sample_index). The grid is a table of settings
    by the dozen, so it may be broadcast."""
    every = samples.crossJoin(F.broadcast(grid))
    return every if done is None else pending(every, done, ["model", "budget", "variant", "run_id", "sample_index"])


def upgraded(done: DataFrame, samples: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """(first result of each sample and run below runs, sample and run still to do) when the number of repeats rises."""
    kept = done.where(F.col("run_id") < runs).groupBy("sample_index", "run_id").agg(F.min_by("result", "pos").alias("result"))
    every = samples.select("sample_index").withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return kept, pending(every, kept, ["sample_index", "run_id"])


def latest_checkpoint(paths: DataFrame, column: str = "path") -> DataFrame:
    """group, path of the checkpoint of greatest number; weights at the root of the group, without a number, come first."""
    n = F.try_to_number(F.regexp_extract(column, r"checkpoint-(\d+)/?$", 1), F.lit("9999999999")).cast("long")
    group = F.regexp_replace(column, r"/checkpoint-\d+/?$", "")
    return paths.groupBy(group.alias("group")).agg(F.max_by(column, F.coalesce(n, F.lit(2**62))).alias("path"))


def model_and_variant(folder: Column) -> tuple[Column, Column]:
    """From a directory's name model_variant[_rN]."""
    x = F.regexp_replace(folder, r"_r\d+$", "")
    variant = F.regexp_extract(x, "(original|definitions|one_shot)$", 1)
    return F.regexp_replace(x, "_?(original|definitions|one_shot)$", ""), F.coalesce(F.nullif(variant, F.lit("")), F.lit("original"))


def split_name(asked: str, known: list[str]) -> str:
    """The known split that a name means: itself, with _ for -, in lower or upper case."""
    for name in (asked, asked.replace("-", "_")):
        for form in (name, name.lower(), name.upper()):
            if form in known:
                return form
    raise KeyError(asked)
