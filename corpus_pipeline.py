"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, mixing, SentencePiece."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, quality, simhash, suffix, viterbi
from millrace.llm.common import ROW, Workspace, numbered, shared_dir, table
from millrace.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the certified thresholds of their language."""
    space, columns = Workspace(spark, "quality"), docs.columns
    own = docs.select("doc_id", "lang", "text", F.struct(*columns).alias("_doc"))  # so that no name clashes
    features = space.save(quality.base_features(own), "features")
    cutoffs = space.save(quality.thresholds(features, table(spark, sf_dir, "labels")), "cutoffs")
    judged = quality.judge(quality.base_features(own, keep=("lang", "_doc")), cutoffs)
    # a generated column: a plain filter would be pushed through the projections, its nested expressions multiplied
    kept = judged.withColumn("_kept", F.explode_outer(F.when(F.col("kept"), F.array(F.lit(True)))))
    return kept.where("_kept").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8 or more) the first row stays: the smallest doc_id,
    rows without one last; of rows that share it, by a hash of the text."""
    space, columns = Workspace(spark, "near"), docs.columns
    docs = numbered(docs, space, nulls_first=False)
    gone = simhash.similar(docs, space).where(F.col(ROW) != F.col("component")).select(ROW)
    return docs.join(space.save(gone, "gone"), ROW, "left_anti").select(*columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 100 bytes or more go; documents left without a word go with them."""
    space, columns = Workspace(spark, "passages"), docs.columns
    docs = numbered(docs, space)
    cut = suffix.dedup(docs, space, keep_text=True).where("n_removed > 0").select(F.col(ROW).alias("_id"), F.col("kept").alias("_left"))
    cut = space.save(cut, "cut")
    out = docs.join(cut, F.col(ROW) == F.col("_id"), "left")
    out = out.where(F.col("_left").isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("n_chars", F.when(F.col("_left").isNotNull(), F.length("_left").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce("_left", "text")).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, shard by shard."""
    return mixing.mixed_documents(docs, Workspace(spark, "mix"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip, piece_ids of each row of the mix."""
    Workspace(spark, "pieces")
    return viterbi.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("mixing to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Hashed draws and fingerprints have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
