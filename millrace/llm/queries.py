"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, licenses, mixing, quality, simhash, suffix, tokenbin, topk, toxicity, viterbi
from .common import Workspace, table, word_count


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op1")
    slim = space.save(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    drawn = mixing.mix(slim, space, sizes=slim)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return drawn.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), Workspace(spark, "op2"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), Workspace(spark, "op3"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "op4")
    return viterbi.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"), Workspace(spark, "op5"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), Workspace(spark, "op6")))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op7")
    path = tokenbin.write_ids(table(spark, sf_dir, "documents"), space, tokenizer_path("byte_bpe_50k.json"))
    return tokenbin.read_ids(spark, space, path)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op8")
    features = space.save(quality.base_features(table(spark, sf_dir, "documents")), "features")
    cutoffs = space.save(quality.thresholds(features, table(spark, sf_dir, "labels")), "cutoffs")
    return quality.judge(features, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"), Workspace(spark, "op9"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "op10")
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (
        op1_mixture, op2_top_k, op3_simhash, op4_sentencepiece, op5_passages, op6_toxicity, op7_token_ids,
        op8_quality_rules, op9_suffix_dedup, op10_licenses)}


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
          where vec_id is not null and embedding is not null
            and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
        s as (
          select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
          from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
        r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
        select query_id, rank, vec_id, score from r where rank <= 5"""}
