"""The driver's tables, and small inline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """String columns from rows, as a literal of the plan."""
    quoted = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    return spark.range(1).select(F.explode(quoted).alias("r")).select("r.*")


def values_sql(names: list[str], rows: list[tuple]) -> str:
    """The same rows as SQL."""
    def lit(v) -> str:
        return "null" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) t({', '.join(names)})"


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions to score: sample_index, run_id, gold, pred (null: not parsed), gold_set, pred_set."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = F.split(F.lower("text"), " ")
    return d.select(
        F.col("doc_id").alias("sample_index"), (F.col("doc_id") % 5).alias("run_id"), F.col("quality").cast("string").alias("gold"),
        F.when(F.col("n_chars") % 10 == 0, F.lit(None)).when(F.col("n_chars") > 1500, "1").otherwise("0").alias("pred"),
        F.array_distinct(F.slice(words, 1, 6)).alias("gold_set"), F.array_distinct(F.slice(words, 3, 5)).alias("pred_set"))


EVAL_SQL = """eval_rows as (
  select d.doc_id as sample_index, d.doc_id % 5 as run_id, quality::varchar as gold,
    case when n_chars % 10 = 0 then null when n_chars > 1500 then '1' else '0' end as pred,
    list_distinct(string_split(lower(text), ' ')[1:6]) as gold_set, list_distinct(string_split(lower(text), ' ')[3:7]) as pred_set
  from documents d join labels using (doc_id))"""
