"""Token ids in a binary format: canonical length-limited Huffman codes of global counts.

Texts are tokenized once and kept as plain id chunks in the shared folder, together with each task's counts. The summed
counts (a row for each id of the vocabulary) give code lengths by package-merge, and those the canonical codes. A block
holds the codes of whole documents as one bit string, with the bit offset of every STRIDE-th id: blocks decode on their
own, and within a block all checkpoints advance together through one lookup table. Files are Parquet tables of blocks, so
that Spark's commit protocol covers a lost executor.
"""

from __future__ import annotations

import gc
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, with_small

#: Ids between two bit offsets, and ids after which a block is closed.
STRIDE, BLOCK = 128, 1 << 17
#: Pieces of text that a worker keeps with their ids, and bytes of text that it takes at a time.
CACHE, SLICE = 800_000, 1 << 22
#: Ascending runs of documents that a task writes apart (each split of a file is one, if the table is in order), and falls
#: within a split after which it counts as out of order and is cut no more: runs grow with splits, not with documents.
RUNS, FALLS = 4096, 4

#: A space that white space or nothing follows; the class holds all that str.isspace() does.
_EDGE = r" [\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]| $"
_DOTS = (".", ",")
_LINE = re.compile(r"(\S+)\n(\S+)")
_WORKERS: dict = {}


class PieceTokenizer:
    """A byte-level BPE tokenizer of the tokenizers library, applied to each different piece once.

    Its pre-tokenizer always starts a token at a space that a non-space follows, so a text is cut there; the ids of the
    pieces, put together, are those of the text. Pieces are cut further (before a last full stop or comma after a
    letter, around a single newline), where it always starts a token too.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(definition)
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        vocabulary = self.t.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.leads[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def _many(self, pieces: list[str], into: dict[str, bytes]) -> None:
        """Ids of pieces with a space in front: they are encoded as one text, and each begins at a token with a space."""
        rest = [p for p in pieces if " " in p]
        whole = [p for p in pieces if " " not in p] if rest else pieces
        texts = [whole[a : a + 512] for a in range(0, len(whole), 512)]
        for own, e in zip(texts, self.t.encode_batch_fast([" " + " ".join(x) for x in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.leads[ids])
            if len(at) == len(own):
                at = [*(at * 4).tolist(), 4 * len(ids)]
                into.update(zip(own, map(ids.tobytes().__getitem__, map(slice, at[:-1], at[1:])), strict=True))
            else:
                rest += own
        into.update(zip(rest, self._library([" " + p for p in rest]), strict=True))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        parts = text.split(" ")
        out = parts[:1]
        for p in parts[1:]:  # white space in runs stays with what stands before it
            if not p or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def _learn(self, spaced: list[str], plain: list[str]) -> None:
        """Take in pieces that aren't known yet."""
        lines, tails = [], set()
        more: dict[int, set[str]] = {0: set(), 1: set()}
        for k, (own, pieces) in enumerate(((self.spaced, spaced), (self.plain, plain))):
            for p in (p for p in pieces if "\n" in p):
                if m := _LINE.fullmatch(p):
                    lines.append((own, p, m[1], m[2]))
                    tails.add(m[2])
                    more[k].add(m[1])
        skip = {id(self.spaced): set(), id(self.plain): set()}
        for own, p, _, _ in lines:
            skip[id(own)].add(p)
        more[1] |= tails
        for k, (own, pieces) in enumerate(((self.spaced, spaced), (self.plain, plain))):
            if out := skip[id(own)]:
                pieces = [p for p in pieces if p not in out]
            if more[k]:
                pieces = list({*pieces, *(p for p in more[k] if p not in own)})
            cores = [p for p in pieces if p.endswith(_DOTS) and p[-2:-1].isalpha()]
            if cores:
                stems = {p[:-1] for p in cores}
                pieces = [p for p in pieces if not (p.endswith(_DOTS) and p[-2:-1].isalpha())]
                stems.difference_update(pieces)
                pieces += [p for p in stems if p not in own]
            if own is self.spaced:
                self._many(pieces, own)
            else:
                own.update(zip(pieces, self._library(pieces), strict=True))
            if cores:
                dots = dict(zip(".,", self._library([".", ","]), strict=True))
                own.update([(p, own[p[:-1]] + dots[p[-1]]) for p in cores])
        if lines:
            newline = self._library(["\n"])[0]
            for own, p, a, b in lines:
                own[p] = own[a] + newline + self.plain[b]

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        runs = pc.match_substring_regex(texts, _EDGE)
        if not pc.any(runs).as_py():
            return pc.split_pattern(texts, " ")
        at = runs.to_numpy(zero_copy_only=False)
        both = [pc.split_pattern(texts.filter(pc.invert(runs)), " "),
                pa.array([self._cut(t) for t in texts.filter(runs).to_pylist()], pa.list_(texts.type))]
        return pa.concat_arrays(both).take(pa.array(np.argsort(np.concatenate([np.flatnonzero(~at), np.flatnonzero(at)]))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after the other, and how many each text has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lists = self._pieces(pc.fill_null(texts, ""))
        n = lists.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(n) - n
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        index, keys = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first = flat.take(pa.array(starts)).to_pylist()  # no space stands before these
        later = np.ones(len(index), bool)
        later[starts] = False
        used = np.zeros(len(keys), bool)
        used[index[later]] = True
        if not used.all():  # no space stands before some of them anywhere
            place = np.cumsum(used) - 1
            index, keys = place[index], keys.filter(pa.array(used))
        keys = keys.to_numpy(zero_copy_only=False).tolist()
        if len(self.spaced) + len(self.plain) > CACHE:  # what this slice holds is the likeliest to come again
            self.spaced = {k: self.spaced[k] for k in keys if k in self.spaced}
            self.plain = {}
        values = list(map(self.spaced.get, keys))
        unknown = [i for i, v in enumerate(values) if v is None]
        self._learn([keys[i] for i in unknown], list(set(first).difference(self.plain)))
        for i in unknown:
            values[i] = self.spaced[keys[i]]
        parts = [*values, *map(self.plain.__getitem__, first)]
        index[starts] = np.arange(len(keys), len(parts))
        known = np.frombuffer(b"".join(parts), "<u4")
        width = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        size = width[index]
        end = np.cumsum(size)
        ids = known[np.arange(end[-1]) + np.repeat((np.cumsum(width) - width)[index] - end + size, size)]
        return ids, np.add.reduceat(size, starts)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths up to limit, by package-merge; 0 for a count of 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    merged, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        is_leaf.append(order < n)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(is_leaf):
        k = int(level[:take].sum())
        length[:k] += 1
        take = 2 * (take - k)
    out[used] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(lengths.max())
        width = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
        start = np.cumsum(width) - width  # codes as the first top bits
        codes[order] = start >> (top - lengths[order]).astype(np.uint64)
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Bit string, and the bit offset of every STRIDE-th id (32-bit)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    v = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    n = int(end[-1] >> 5) + 2 if len(ids) else 2
    # parts of a word don't overlap, so their sum, below 2**32, is exact
    high = np.bincount(word, (v >> np.uint64(32)).astype(np.float64), n + 1)
    low = np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)
    return (high + low).astype(np.uint32).astype(">u4").tobytes(), at[::STRIDE].astype("<u4").tobytes()


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.top = max(1, int(lengths.max())) if len(lengths) else 1
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = np.int64(1) << (self.top - lengths[order].astype(np.int64))
        pad = (1 << self.top) - int(span.sum())
        self.symbol = np.concatenate([np.repeat(order.astype(np.uint32), span), np.zeros(pad, np.uint32)])
        self.size = np.concatenate([np.repeat(lengths[order], span), np.ones(pad, np.uint8)]).astype(np.int64)

    def decode(self, data: bytes, offsets: bytes, n: int) -> np.ndarray:
        words = np.frombuffer(data, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = np.frombuffer(offsets, "<u4").astype(np.int64)
        out = np.empty((STRIDE, len(at)), np.uint32)
        shift, last = np.uint64(64 - self.top), len(pairs) - 1
        for k in range(STRIDE):
            peek = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> shift
            out[k] = self.symbol[peek]
            at = at + self.size[peek]
        return out.T.ravel()[:n]


_CHUNK = (["kind", "part", "seq", "docs", "sizes", "data"],
          [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()])
_CHUNK_SCHEMA = "kind int, part long, seq long, docs array<long>, sizes array<long>, data binary"


def _rows(rows, names, kinds):
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _tokenize(definition, end_id: int, vocabulary: int):
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        key = hash(definition.value)
        if key not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[key] = PieceTokenizer(definition.value)
        own, part, seq = _WORKERS[key], TaskContext.get().partitionId() * RUNS, 0
        counts, last_part = np.zeros(vocabulary, np.int64), part + RUNS - 1
        docs, ids, sizes, size, last_split = [], [], [], 0, None

        def block():
            data = zstandard.compress(np.concatenate(ids).astype(kind).tobytes(), 1)
            return _rows([(0, part, seq, docs, sizes, data)], *_CHUNK)

        for b in batches:
            length = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64)
            group = np.cumsum(length) // SLICE
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                gc.disable()  # many small objects, no cycles
                found, n = own.encode(b.column(1).slice(lo, hi - lo))
                gc.enable()
                end = np.cumsum(n + 1)
                every = np.full(int(end[-1]) if len(end) else 0, end_id, np.uint32)
                inner = np.ones(len(every), bool)
                inner[end - 1] = False
                every[inner] = found
                counts += np.bincount(every, minlength=vocabulary)
                at = 0
                names, splits = (b.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 2))
                for doc, split, stop in zip(names, splits, end.tolist(), strict=True):
                    moved = split != last_split
                    fell = bool(docs) and docs[-1] is not None and (doc is None or doc < docs[-1])
                    in_split = 0 if moved else in_split + fell
                    falls = bool(docs) and part < last_part and (moved or fell and in_split <= FALLS)
                    last_split = split
                    if falls or size >= BLOCK:
                        yield block()
                        docs, ids, sizes, size, seq = [], [], [], 0, seq + 1
                        part += falls
                    docs.append(doc)
                    ids.append(every[at:stop])
                    sizes.append(stop - at)
                    size += stop - at
                    at = stop
        if docs:
            yield block()
        used = np.flatnonzero(counts)
        if len(used):
            yield _rows([(1, part, -1, used.tolist(), counts[used].tolist(), None)], *_CHUNK)

    return run


_FILE = (["part", "seq", "docs", "sizes", "n_ids", "offsets", "bits"],
         [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()])
_FILE_SCHEMA = "part long, seq long, docs array<long>, sizes array<long>, n_ids long, offsets binary, bits binary"


def _write_blocks(lengths, kind: str):
    def run(batches):
        own = lengths.value
        codes = canonical_codes(own)
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(zstandard.decompress(row["data"]), kind)
                bits, offsets = encode_block(ids, own, codes)
                yield _rows([(row["part"], row["seq"], row["docs"], row["sizes"], len(ids), offsets, bits)], *_FILE)

    return run


def _one_document_each(kind: str):
    width = np.dtype(kind).itemsize

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                data, at, out = zstandard.decompress(row["data"]), 0, []
                for doc, n in zip(row["docs"], row["sizes"], strict=True):
                    out.append((doc, n, data[at * width : (at + n) * width]))
                    at += n
                yield _rows(out, ["doc", "size", "data"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _chunk_again(batches):
    part, seq = TaskContext.get().partitionId(), 0
    docs, sizes, data = [], [], []
    for b in batches:
        for row in b.to_pylist():
            docs.append(row["doc"])
            sizes.append(row["size"])
            data.append(row["data"])
            if sum(sizes[-1:]) + sum(sizes[:-1]) >= BLOCK:
                yield _rows([(0, part, seq, docs, sizes, zstandard.compress(b"".join(data), 1))], *_CHUNK)
                docs, sizes, data, seq = [], [], [], seq + 1
    if docs:
        yield _rows([(0, part, seq, docs, sizes, zstandard.compress(b"".join(data), 1))], *_CHUNK)


def write_ids(docs: DataFrame, space: Workspace, tokenizer: str, end_id: int = 2, name: str = "ids") -> str:
    """Write the ids of all texts (null: empty), end_id after each, in ascending doc_id order; the files' folder.

    It holds blocks/ and codebook/ (one row: the code lengths). tokenizer: path of a byte-level BPE definition. Rows
    without a doc_id come first; rows that share one stand together. An empty table gives files without blocks.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    vocabulary = max(Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(definition)
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())  # a task reads splits of several files
    chunks = docs.select(F.col("doc_id").cast("long"), "text", split.alias("split")).mapInArrow(_tokenize(sent, end_id, vocabulary), _CHUNK_SCHEMA)
    chunks = space.save(chunks, "chunks")
    # at most one row for each id of the vocabulary comes to the driver
    total = chunks.where("kind = 1").select(F.explode(F.arrays_zip("docs", "sizes")).alias("x")).groupBy("x.docs").agg(
        F.sum("x.sizes").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in total:
        counts[r[0]] = r[1]
    limit = max(12, int(np.ceil(np.log2(max(2, (counts > 0).sum())))) + 2)
    lengths = code_lengths(counts, limit)
    chunks = chunks.where("kind = 0")
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("docs") - 1, F.lit(1))),
                      lambda i: F.coalesce(F.get("docs", i) >= F.get("docs", i - 1), F.get("docs", i - 1).isNull()))
    ordered = chunks.select(
        ((F.size("docs") < 2) | rising).alias("rising"),  # a long document may be a block of its own
        F.get("docs", F.lit(0)).alias("first"), F.element_at("docs", -1).alias("last"), "part", "seq")
    inside = W.partitionBy("part").orderBy("seq")
    gap = ordered.withColumn("before", F.lag("last").over(inside)).groupBy("part").agg(
        F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"),
        F.min(F.col("rising") & F.coalesce(F.col("first") >= F.col("before"), F.col("before").isNull())).alias("rising"))
    # one row for each input partition
    parts = gap.withColumn("before", F.max("last").over(W.orderBy(F.asc_nulls_first("first"), "last").rowsBetween(W.unboundedPreceding, -1)))
    broken = parts.where(~(F.col("rising") & F.coalesce(F.col("first") >= F.col("before"), F.col("before").isNull()))).limit(1).count()
    if broken:
        # the table isn't in order: deal the documents by range
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = chunks.mapInArrow(_one_document_each(kind), "doc long, size long, data binary").repartitionByRange(
            n, F.asc_nulls_first("doc")).sortWithinPartitions(F.asc_nulls_first("doc"), "size", "data")
        chunks = space.save(dealt.mapInArrow(_chunk_again, _CHUNK_SCHEMA), "chunks-in-order")
        order = chunks.select("part").distinct().withColumn("file", F.col("part").cast("int"))
    else:
        order = parts.withColumn("file", F.row_number().over(W.orderBy(F.asc_nulls_first("first"), "last"))).select("part", "file")
    blocks = chunks.select("part", "seq", "docs", "sizes", "data").mapInArrow(
        _write_blocks(spark.sparkContext.broadcast(lengths), kind), _FILE_SCHEMA)
    blocks = with_small(blocks, space.save(order.coalesce(1), "order"), "part", "inner").drop("part")
    path = f"{space.base}/{name}"
    blocks.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    space.drop("chunks", "chunks-in-order")
    return path


def _read_blocks(lengths, keep_ids: bool):
    def run(batches):
        decoder = None
        names = ["file", "seq", "at", "doc_id", "before", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            decoder = decoder or Decoder(lengths.value)
            for row in b.to_pylist():
                ids = decoder.decode(row["bits"], row["offsets"], row["n_ids"]).astype("<u4")
                at, out = 0, []
                for k, (doc, n) in enumerate(zip(row["docs"], row["sizes"], strict=True)):
                    own = ids[at : at + n].tobytes()
                    out.append((row["file"], row["seq"], k, doc, at, n, zlib.crc32(own), own if keep_ids else None))
                    at += n
                yield _rows(out, names, kinds)

    return run


def read_ids(spark, space: Workspace, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with keep_ids, ids (32-bit little-endian), of files of write_ids()."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()[0]), np.uint8)
    schema = "seq long, docs array<long>, sizes array<long>, n_ids long, offsets binary, bits binary, file int"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    sums = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))  # one row for each file
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = blocks.select("file", "seq", "n_ids").withColumn(
        "inner", F.coalesce(F.sum("n_ids").over(W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = space.save(starts.join(base, "file").select(
        F.col("file").cast("long"), "seq", (F.col("base") + F.col("inner")).alias("base")), "starts")
    docs = blocks.mapInArrow(_read_blocks(spark.sparkContext.broadcast(lengths), keep_ids),
                             "file long, seq long, at long, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary")
    if not keep_ids:
        docs = docs.drop("ids")
    out = with_small(docs, starts, ["file", "seq"], "inner").withColumn("start", F.col("base") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
