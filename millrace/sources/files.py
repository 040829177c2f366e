"""Readers for the file shapes of the pipeline, and the sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import keep_last

CASE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("meta", T.StructType([T.StructField("date", T.StringType()), T.StructField("province", T.StringType())])),
    T.StructField("person_info", T.StringType()), T.StructField("procedure", T.StringType()), T.StructField("fact", T.StringType()),
    T.StructField("relevant_articles", T.ArrayType(T.StringType())), T.StructField("decision", T.StringType()),
    T.StructField("raw_reasoning_and_decision", T.StringType()), T.StructField("source_url", T.StringType())])


def text_documents(spark: SparkSession, path: str, types: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """case_id, doc_type (the folder), text of whole .txt files below a path.

    types: the folders taken, in this order, with pos, the file's place: by folder, then by name; limit: files of each folder.
    """
    p = F.url_decode(F.col("_metadata.file_path"))
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    df = df.select(F.regexp_extract(p, r"([^/]+)\.txt$", 1).alias("case_id"), F.element_at(F.split(p, "/"), -2).alias("doc_type"),
                   F.col("value").alias("text"))
    if not types:
        return df
    order = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("doc_type"))
    ranked = df.where(F.col("doc_type").isin(*types)).withColumn("in_type", F.row_number().over(W.partitionBy("doc_type").orderBy("case_id")))
    if limit is not None:
        ranked = ranked.where(F.col("in_type") <= limit)
    return ranked.withColumn("pos", F.struct(order.alias("type"), F.col("in_type").alias("n"))).drop("in_type")


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """v, an element of a JSON array. A file is one array, so one task reads it whole."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("v"))


def case_records(spark: SparkSession, path: str, coerce: bool = False) -> DataFrame:
    """Records of JSON arrays; coerce: missing values become empty ones. What is no object is left out."""
    objects = _elements(spark, path).where(F.schema_of_variant("v").startswith("OBJECT"))
    df = objects.select(*[F.try_variant_get("v", f"$.{c.name}", c.dataType.simpleString()).alias(c.name) for c in CASE.fields])
    if not coerce:
        return df
    text = {c.name: F.coalesce(c.name, F.lit("")) for c in CASE.fields if c.dataType == T.StringType()}
    return df.withColumns(text | {
        "meta": F.struct(F.coalesce("meta.date", F.lit("")).alias("date"), F.coalesce("meta.province", F.lit("")).alias("province")),
        "relevant_articles": F.coalesce("relevant_articles", F.array().cast("array<string>"))})


def skipped_records(spark: SparkSession, path: str) -> int:
    """How many elements of JSON arrays are no objects."""
    return _elements(spark, path).where(~F.schema_of_variant("v").startswith("OBJECT")).count()


def json_lines(spark: SparkSession, path: str, schema: T.StructType, index: bool = False) -> DataFrame:
    """Parsed lines; malformed and blank ones are left out. index: line, the place in the file from 0, all lines counted;
    a file is then read whole by one task."""
    if index:
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    else:
        whole = spark.read.text(path)
    row = F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    df = whole.where(F.trim("value") != "").withColumn("r", row).where("r._bad is null")
    return df.select(*(["line"] if index else []), *[f"r.{c.name}" for c in schema.fields])


def first_matching(lines: DataFrame, condition, n: int) -> DataFrame:
    """The first n lines (with their index) that fulfil a condition."""
    return lines.where(condition).orderBy("line").limit(n)


def checkpoint(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The last line of each key; lines without one, malformed and blank ones are left out."""
    return keep_last(json_lines(spark, path, schema, index=True).where(F.col(key).isNotNull()), key, "line").drop("line")


def details(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Entries of all details_*.json below a path, with the key that orders them: by index, by sample and run, else by id."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "details_*.json").option("recursiveFileLookup", True).json(path)
    has = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("index", "sample_index", "run_id", "id")}
    zero = F.lit(0).cast("long")

    def key(kind: int, number, text, run):
        return F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("n"), text.cast("string").alias("s"), run.cast("long").alias("run"))

    order = F.when(has["index"].isNotNull(), key(0, has["index"], F.lit(""), zero)).when(
        has["sample_index"].isNotNull(), key(1, has["sample_index"], F.lit(""), F.coalesce(has["run_id"].cast("long"), zero))).otherwise(
        key(2, zero, F.coalesce(has["id"].cast("string"), F.lit("")), zero))
    return df.withColumn("order_key", order)


def wide_csv(spark: SparkSession, path: str, step: str, series: list[str]) -> DataFrame:
    """step, series, value of a wide CSV (UTF-8, with or without mark): blanks are NaN, rows without a step go. A missing
    column is an error."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("\ufeff").strip('"') for c in df.columns})
    if missing := [c for c in (step, *series) if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    at = F.try_to_number(F.trim(F.col(f"`{step}`")), F.lit("9999999999")).cast("long")
    values = F.array(*[F.struct(F.lit(c).alias("series"), F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(float("nan"))).alias("value")) for c in series])
    return df.withColumn("_step", at).where("_step is not null").select(F.col("_step").alias("step"), F.explode(values).alias("x")).select("step", "x.*")


def markdown_table(spark: SparkSession, path: str, heading: str, columns: list[str]) -> DataFrame:
    """file, label and columns of the first table under a heading of Markdown files; of a cell "x ± y", x."""
    df = spark.read.text(path, wholetext=True).select(F.url_decode(F.col("_metadata.file_path")).alias("file"), "value")
    body = F.split(F.regexp_extract("value", f"(?ms)^### {heading}[^\n]*\n(.*?)(?=^#|\\z)", 1), "\n")
    lines = df.select("file", F.explode(F.slice(F.filter(body, lambda x: x.startswith("|")), 3, 1000)).alias("line"))
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    lines = lines.withColumn("cells", cells)
    return lines.select("file", F.get("cells", F.lit(1)).alias("label"), *[
        F.regexp_extract(F.get("cells", F.lit(k + 2)), r"^(-?[0-9.]+)", 1).try_cast("double").alias(c) for k, c in enumerate(columns)])


def site_list(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """Sites (name, url) of a JSON list; those of a host."""
    df = spark.read.schema("name string, url string").option("multiLine", True).json(path)
    return df if host is None else df.where(F.try_parse_url("url", F.lit("HOST")) == host)


def named_split(spark: SparkSession, paths: list[str], split: str) -> DataFrame:
    """A split of the first dataset (Parquet, by split) that can be read."""
    for path in paths:
        try:
            df = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001  only a path that isn't there leads on to the next
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        return df.where(F.col("split") == split)
    raise FileNotFoundError(", ".join(paths))


def write_json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One pretty JSON array in a local file, replaced in one step, for results of a bounded number of rows."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as Parquet or JSON lines")
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in rows], f, ensure_ascii=False, indent=2)
    os.replace(part, path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by_outcome(df: DataFrame, path: str, outcome: str = "outcome") -> None:
    """A folder for each outcome, its name without odd characters and of 80 at most."""
    name = F.left(F.regexp_replace(outcome, r'[<>:"/\\|?*]', "_"), F.lit(80))
    df.withColumn("group", name).write.mode("overwrite").partitionBy("group").json(path)


def write_rejects(df: DataFrame, path: str, reasons: str = "warnings") -> None:
    """A copy of each row for each of its reasons."""
    df.withColumn("reason", F.explode(reasons)).write.mode("overwrite").partitionBy("reason").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)
