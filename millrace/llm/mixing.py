"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Sources share a multiple of all words by weight, capped at a number of passes over each. A source's documents are dealt
to blocks; the mix draws whole passes over the permuted blocks and then blocks in permuted order until the target is met
to the word (the last block gives its documents in hashed order, the last document a prefix of its words). The number of
block draws of each source is its quota. A binary tree splits the quotas among the output shards: each node sends half
of its draws to the left, and how many of them are of each source is a multivariate-hypergeometric draw, made source by
source by inversion. A shard then takes its disjoint slice of each source's permuted draws, and orders its rows by hash.
All randomness is hashed from the seed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, with_small, word_count

WEIGHTS = (3, 1, 2)


def _let(name: str, struct: str, body: str) -> str:
    return f"element_at(transform(array({struct}), {name} -> {body}), 1)"


def _hypergeometric_fold(seed: int) -> str:
    """SQL: from counts (array<bigint>), total, take, lo: how many of each source go left."""
    up = "cast(p2.q - j + 1 as double) * (p2.n - j + 1) / (cast(j as double) * (p2.tot - p2.q - p2.n + j))"
    down = "cast(j + 1 as double) * (p2.tot - p2.q - p2.n + j + 1) / (cast(p2.q - j as double) * (p2.n - j))"
    seq_up = "if(p2.hi > p2.m, sequence(p2.m + 1, p2.hi), cast(array() as array<bigint>))"
    seq_down = "if(p2.lo < p2.m, sequence(p2.m - 1, p2.lo), cast(array() as array<bigint>))"

    def total(seq: str, ratio: str) -> str:
        return (f"aggregate({seq}, named_struct('w', 1D, 's', 0D), (a, j) -> "
                f"named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio})).s")

    def walk(seq: str, ratio: str, start: str) -> str:
        return (f"aggregate({seq}, named_struct('w', 1D, 'c', {start}.c, 'x', {start}.x), (a, j) -> named_struct("
                f"'w', a.w * {ratio}, 'c', a.c + a.w * {ratio}, "
                f"'x', if(a.x is null and a.c + a.w * {ratio} >= p3.u, j, a.x)))")

    uniform = f"(shiftrightunsigned(xxhash64({seed}L, lo, width, size(acc.xs)), 11) / 9007199254740992D)"
    p1 = (f"named_struct('tot', acc.tot, 'q', q, 'n', acc.n, 'u', {uniform}, "
          "'smin', greatest(0L, acc.n + q - acc.tot), 'smax', least(acc.n, q), "
          "'m', cast(floor(cast(acc.n + 1 as double) * (q + 1) / (acc.tot + 2)) as bigint), "
          "'d', cast(ceil(12 * sqrt(cast(acc.n as double) * q / greatest(acc.tot, 1L))) + 30 as bigint))")
    p2 = ("named_struct('tot', p1.tot, 'q', p1.q, 'n', p1.n, 'u', p1.u, 'm', greatest(p1.smin, least(p1.smax, p1.m)), "
          "'lo', greatest(p1.smin, greatest(p1.smin, least(p1.smax, p1.m)) - p1.d), "
          "'hi', least(p1.smax, greatest(p1.smin, least(p1.smax, p1.m)) + p1.d))")
    p3 = f"named_struct('u', p2.u * (1D + {total(seq_up, up)} + {total(seq_down, down)}))"
    p4 = walk(seq_up, up, "named_struct('c', 1D, 'x', if(1D >= p3.u, p2.m, cast(null as bigint)))")
    p5 = walk(seq_down, down, "p4")
    out = ("named_struct('tot', p2.tot - p2.q, 'n', p2.n - coalesce(p5.x, p2.m), "
           "'xs', concat(acc.xs, array(coalesce(p5.x, p2.m))))")
    body = _let("p1", p1, _let("p2", p2, _let("p3", p3, _let("p4", p4, _let("p5", p5, out)))))
    return ("aggregate(counts, named_struct('tot', total, 'n', take, 'xs', cast(array() as array<bigint>)), "
            f"(acc, q) -> {body}).xs")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, source_no, quota) from one row with counts (array<bigint>); shards is a power of two.

    Every shard gets the same number of draws, up to one; every source's quotas sum to its count.
    """
    node = quotas.select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("width"), "counts"
    )
    fold = _hypergeometric_fold(seed)
    width = shards
    while width > 1:
        node = node.selectExpr(
            "lo", "width", "counts", "aggregate(counts, 0L, (a, x) -> a + x) as total"
        ).selectExpr(
            # the left half takes what evenly dealt shards would hold, the odd draw going left
            "lo", "width", "counts", "total", "total - total div 2 as take"
        ).selectExpr("lo", "width", "counts", f"{fold} as xs")
        node = node.selectExpr(
            """inline(array(
                 named_struct('lo', lo, 'width', width div 2, 'counts', xs),
                 named_struct('lo', lo + width div 2, 'width', width div 2,
                              'counts', zip_with(counts, xs, (a, b) -> a - b))))"""
        )
        width //= 2
    return node.selectExpr("lo as shard", "posexplode(counts) as (source_no, quota)")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, passes: float = 2.0) -> DataFrame:
    """One row per source: source_no, source, source_size, n_docs, target. sizes: source, size.

    Sources are numbered by code point, null last; weights repeat along that order. The table has one row per source,
    so the windows over it have no partition.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.asc_nulls_last("source"))
    s = s.withColumn("source_no", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (F.col("source_no") % len(weights)) + 1))
    s = s.withColumn("cap", F.col("source_size") * passes)
    everything = W.partitionBy()
    s = s.withColumn("all_words", F.sum("source_size").over(everything) * share)
    by = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("capped", F.col("weight") * (F.col("all_words") - F.col("caps_before")) / F.col("weight_left") > F.col("cap"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)
    used = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    level = F.when(free > 0, (F.col("all_words") - used) / F.when(free > 0, free))
    return s.withColumn("level", level).select(
        "source_no", "source", "source_size", "n_docs",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap")))
        .cast("double").alias("target"),
    )


def mix(docs: DataFrame, space: Workspace, weights=WEIGHTS, share: float = 1.5, passes: float = 2.0,
        seed: int = 20, docs_per_block: int = 1024, words_per_shard: int = 1 << 22, max_shards: int = 4096,
        sizes: DataFrame | None = None) -> DataFrame:
    """docs with size, source_size, target and draws: an array of (shard, order_key, words), one entry per copy taken.

    docs: doc_id, source, text (unless it has size already) and any other columns, which pass through. Nulls: a null
    text has no words; null sources form one source, the last; rows with a null or repeated doc_id are rows of their
    own. A source without words has target 0, and a document without words no draw. An empty table gives an empty one.
    The words taken of a source equal its target, rounded.
    """
    if "size" not in docs.columns:
        docs = docs.withColumn("size", word_count(F.col("text")))
    slim = space.save(docs.select("doc_id", "source", "size"), "sizes") if sizes is None else sizes
    src = space.save(source_targets(slim, weights, share, passes).withColumn(
        "n_blocks", F.ceil(F.col("n_docs") / docs_per_block).cast("long")).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size"))).coalesce(1), "sources")

    def in_blocks(df: DataFrame) -> DataFrame:
        out = with_small(df.withColumnRenamed("source", "_source"), src, F.col("_source").eqNullSafe(F.col("source")), "inner")
        return out.drop("_source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_blocks")))

    blocks = in_blocks(slim).groupBy("source_no", "block", "whole", "rest").agg(F.sum("size").alias("words"))
    blocks = blocks.where("words > 0")
    perm = W.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 1), "source_no", "block"), "block")
    # one row per block of documents, so a source's window holds rows by the thousandth
    blocks = blocks.withColumn("rank", F.row_number().over(perm) - 1).withColumn(
        "before", F.coalesce(F.sum("words").over(perm.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("n", F.count("*").over(W.partitionBy("source_no")))
    draws = blocks.selectExpr(
        "source_no", "block", "words",
        """explode(concat(
             if(whole > 0, transform(sequence(0L, whole - 1), p -> named_struct('at', p * n + rank, 'cut', words)),
                cast(array() as array<struct<at:bigint,cut:bigint>>)),
             if(rest > before, array(named_struct('at', whole * n + rank, 'cut', least(words, rest - before))),
                cast(array() as array<struct<at:bigint,cut:bigint>>)))) as d""",
    ).select("source_no", "block", "words", "d.at", "d.cut")
    draws = space.save(draws, "draws")
    taken = draws.agg(F.sum("cut")).first()[0] or 0
    shards = 1 << min(int(math.log2(max_shards)), max(0, math.ceil(math.log2(max(1, taken / words_per_shard)))))
    counts = src.join(draws.groupBy("source_no").agg(F.count("*").alias("q")), "source_no", "left").agg(
        F.expr("transform(sort_array(collect_list(named_struct('s', source_no, 'q', coalesce(q, 0L)))), x -> x.q)").alias("counts")
    )
    quotas = split_quotas(counts, shards, seed + 2)
    ends = quotas.groupBy("source_no").agg(F.expr(
        "transform(sort_array(collect_list(named_struct('s', shard, 'q', quota))), x -> x.q)").alias("qs")
    ).selectExpr("source_no", "aggregate(qs, cast(array() as array<bigint>), (a, x) -> concat(a, array(coalesce(try_element_at(a, -1), 0L) + x))) as ends")
    dealt = with_small(draws, space.save(ends, "ends"), "source_no", "inner").selectExpr(
        "source_no", "block", "words", "cut", "cast(size(filter(ends, e -> e <= at)) as bigint) as shard", "at"
    ).groupBy("source_no", "block", "words").agg(
        F.sort_array(F.collect_list(F.struct("at", "shard", "cut"))).alias("block_draws")  # at most passes + 1
    )
    dealt = space.save(dealt, "dealt")
    rows = with_small(in_blocks(docs), dealt, ["source_no", "block"])
    # only a source's last block is cut, so only its documents need an order
    partial = F.coalesce(F.expr("exists(block_draws, d -> d.cut < words)"), F.lit(False))
    order = W.partitionBy("source_no", "block").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id", "size")
    cut_rows = rows.where(partial).withColumn("doc_before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.where(~partial).withColumn("doc_before", F.lit(0).cast("long")).unionByName(cut_rows)
    drawn = f"""coalesce(filter(transform(block_draws, d -> named_struct('shard', d.shard,
        'order_key', xxhash64({seed + 4}, d.shard, d.at, doc_id),
        'words', if(d.cut = words, size, greatest(0L, least(size, d.cut - doc_before))))), d -> d.words > 0),
        cast(array() as array<struct<shard:bigint,order_key:bigint,words:bigint>>))"""
    return rows.withColumn("draws", F.expr(drawn)).drop(
        "source_no", "block", "n_docs", "n_blocks", "whole", "rest", "words", "block_draws", "doc_before"
    )


def mixed_documents(docs: DataFrame, space: Workspace, **options) -> DataFrame:
    """The mix itself: rows of docs, as often as drawn, dealt to shards and shuffled within each.

    A document drawn in part keeps the first words of its text; n_chars, where there is one, follows.
    """
    columns = docs.columns
    # the row travels as one column, so that its names clash with none of ours
    own = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*columns).alias("_doc"))
    drawn = mix(own, space, **options).select("_doc", "size", F.explode("draws").alias("_d"))
    words = F.split(F.col("_doc.text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # what stands before the first word is an element without one
    lead = F.col("_doc.text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    head = F.array_join(F.slice(words, F.lit(1), F.col("_d.words").cast("int") + lead), "")
    text = F.when(F.col("_d.words") < F.col("size"), head).otherwise(F.col("_doc.text"))
    out = {c: F.col("_doc").getField(c) for c in columns} | {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_d.words") < F.col("size"), F.length(head).cast("long")).otherwise(F.col("_doc.n_chars"))
    dealt = drawn.repartition("_d.shard").sortWithinPartitions("_d.shard", "_d.order_key")
    return dealt.select(*[c.alias(n) for n, c in out.items()])
