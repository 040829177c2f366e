"""SimHash near-duplicates with pivot distance tables.

Texts become fingerprints; equal ones are collapsed to one node first, so copies cost one row. Nodes meet in groups:

* groups(): of fingerprints with at most 3 differing bits, at least 3 of 6 blocks of bits agree; such keys miss no pair.
* similar(): of sets of n shingles with a similarity of 0.8 or more, the first n - ceil(0.8 n) + 1 shingles of each, in any
  one order of all shingles, have one in common. The order is by the number of texts that hold a shingle, rare ones first,
  so unrelated texts that share common phrases don't meet; shingles of one text alone count for the length, but meet
  nobody. Texts of whose shingles less than 0.8 occur elsewhere drop out before.

Within a group the precomputed distances to many reference fingerprints (pivots) discard pairs: two fingerprints that
differ in d bits have distances to any pivot that differ by d at most. Survivors are verified: groups() bit by bit, similar()
by the exact Jaccard similarity of the sets. A group yields a star for each of its components, not its pairs; the stars are
joined by distributed components. A group too large for a task is dealt into blocks of which every two meet.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, WORD, Workspace, components
from .packed import by_first, emit, groups_of, kmer_hashes, pack, texts_in_pieces, unpack, word_hashes

#: Rows of a bucket of keys that is searched directly; larger ones are keyed again.
LIMIT = 256
#: Nodes, and shingles, of a block: a larger group is dealt into several.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Blocks of a group of nodes joined by keys beyond which its nodes meet by key instead.
MAX_BLOCKS = 64
PIVOTS = 24
#: similar(): 64-bit words of a fingerprint, and bits that may differ. At similarity 0.8 the mean is 20 of 128, the standard
#: deviation 4: 48 bits discard fewer than one pair in a million.
LANES, DIFFER = 2, 48


def _rng(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed))


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, lower case, repeats included; fewer words: of the whole sequence."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= k:
        return np.array([digest(join(w), 42)], np.uint64)
    return np.array([digest(join(w[i : i + k]), 42) for i in range(len(w) - k + 1)], np.uint64)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits of a hash; lane 0 is the hash itself."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        x = h + _MIX[0] * np.uint64(lane)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def bit_counts(h: np.ndarray, lanes: int) -> np.ndarray:
    """How many of the hashes have each bit, 64 bits a lane, the lowest bit first."""
    out = np.zeros(64 * lanes, np.int64)
    for a in range(0, len(h), 4096):
        part = h[a : a + 4096]
        for lane in range(lanes):
            bits = np.unpackbits(_lane(part, lane).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.uint16)
    return out


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """64-bit words, each big-endian; a bit is 1 if set in over half the hashes."""
    bits = bit_counts(hashes, lanes) * 2 > len(hashes)
    return np.packbits(bits.reshape(lanes, 64), axis=1, bitorder="little").view("<u8").astype(">u8").tobytes()


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, node (the fingerprint's bits as a long) of whole texts; a null text has fingerprint zero."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, k)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64))], ["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, node long")


def _bytes(node: str) -> Column:
    return F.unhex(F.lpad(F.hex(node), 16, "0"))


def _split_bits(width: int, parts: int = 6) -> list[tuple[int, int]]:
    edges = [width * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


_COMBOS = list(itertools.combinations(range(6), 3))


def _take(x: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for lo, hi in blocks:
        out = (out << np.uint64(hi - lo)) | ((x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1))
    return out


class BlockKeys:
    """Keys for 64-bit fingerprints that miss no pair of 3 or fewer differing bits.

    Level 1: any 3 of 6 blocks. Level 2, for the rows of a crowded key: any 3 of 6 blocks of the bits left over. What is
    equal in both has under 2**17 values, so a bucket of distinct fingerprints is bounded then.
    """

    levels = 2

    def keys(self, fps: np.ndarray, level: int, key: np.ndarray | None):
        x = fps.view(">u8").astype(np.uint64).ravel()
        blocks = _split_bits(64)
        if level == 1:
            for c, combo in enumerate(_COMBOS):
                yield np.arange(len(x)), (np.uint64(c) << np.uint64(40)) | _take(x, [blocks[i] for i in combo])
            return
        for c, combo in enumerate(_COMBOS):
            rows = np.flatnonzero((key >> np.uint64(40)) == np.uint64(c))
            if not len(rows):
                continue
            others = [blocks[i] for i in range(6) if i not in combo]
            rest, width = _take(x[rows], others), sum(hi - lo for lo, hi in others)
            sub = _split_bits(width)
            for d, combo2 in enumerate(_COMBOS):
                yield rows, (np.uint64(d) << np.uint64(40)) | _take(rest, [sub[i] for i in combo2])


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0].as_py())
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _key_rows(keyer, level: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node, fps = b.column("node").to_numpy(zero_copy_only=False), _matrix(b.column("fp"))
            old = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64) if level > 1 else None
            for rows, key in keyer.keys(fps, level, old):
                first = key if level == 1 else old[rows]
                second = np.zeros(len(rows), np.int64) if level == 1 else key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(second), pa.array(node[rows])], ["key", "key2", "node"]
                )

    return run


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POP[a ^ b].sum(axis=-1, dtype=np.int32)


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least index) of pairs within n rows."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            break
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def link_rows(bucket: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (stars: component's first row, row) within buckets; equal buckets stand together."""
    n = len(bucket)
    pivots = _rng(11).integers(0, 256, (PIVOTS, fps.shape[1]), dtype=np.uint8)
    distances = np.stack([hamming(fps, p) for p in pivots], axis=1).astype(np.int16)
    order = np.lexsort((distances[:, 0], bucket))
    bucket, fps, distances = bucket[order], fps[order], distances[order]
    found_a, found_b, alive, d = [], [], np.arange(n), 0
    while len(alive):
        d += 1
        alive = alive[alive + d < n]
        # rows of a bucket stand in the order of the first coordinate: beyond the limit no later row can be near
        alive = alive[(bucket[alive] == bucket[alive + d]) & (distances[alive + d, 0] - distances[alive, 0] <= limit)]
        near = alive
        for lo in range(1, PIVOTS, 8):
            near = near[(np.abs(distances[near, lo : lo + 8] - distances[near + d, lo : lo + 8]) <= limit).all(axis=1)]
        if len(near):
            near = near[hamming(fps[near], fps[near + d]) <= limit]
            found_a.append(near)
            found_b.append(near + d)
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = _union(n, np.concatenate(found_a), np.concatenate(found_b))
    rows = np.flatnonzero(label != np.arange(n))
    return order[label[rows]], order[rows]


def _bucket_links(limit: int):
    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                if not b.num_rows:
                    continue
                held = b if held is None else pa.concat_batches([held, b])
                ids = np.stack([held.column(c).to_numpy(zero_copy_only=False) for c in ("key", "key2")], axis=1)
                change = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1))
                cut = int(change[-1]) + 1 if len(change) else 0  # the last bucket may go on in the next batch
                part, held = held.slice(0, cut), held.slice(cut)
            else:
                part, held = held, None
            if part is None or not part.num_rows:
                continue
            ids = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "key2")], axis=1)
            bucket = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))])
            node = part.column("node").to_numpy(zero_copy_only=False)
            fps = _matrix(part.column("fp"))
            a, c = link_rows(bucket, fps, limit)
            pairs = np.unique(np.stack([node[a], node[c]], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def links(nodes: DataFrame, space: Workspace, limit: int, keyer) -> DataFrame:
    """Edges (a, b) that connect all nodes whose fingerprints meet under a key and differ in at most limit bits.

    nodes: node (long), fp (binary).
    """
    schema = "key long, key2 long, node long"
    n_parts = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, found = nodes, []
    for level in range(1, keyer.levels + 1):
        keyed = rows.mapInArrow(_key_rows(keyer, level), schema)
        counts = space.save(keyed.groupBy("key", "key2").agg(F.count("*").alias("n")).where("n > 1"), f"counts{level}")
        last = level == keyer.levels
        fit = keyed.join(counts if last else counts.where(F.col("n") <= LIMIT), ["key", "key2"])
        if last:  # each row of a bucket of several blocks comes to the meetings of its own block with every one
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            own = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
            fit = fit.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn(
                "key2", F.when(blocks > 1, F.xxhash64("key2", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("key2")))
        fit = fit.select("key", "key2", "node").join(nodes, "node")
        fit = fit.repartition(n_parts, "key", "key2").sortWithinPartitions("key", "key2")
        found.append(space.save(fit.mapInArrow(_bucket_links(limit), "a long, b long").distinct(), f"links{level}"))
        crowded = counts.where(F.col("n") > LIMIT)
        if last or not crowded.limit(1).count():
            break
        # a row of a crowded key comes again with each of its own crowded keys
        again = keyed.join(crowded, ["key", "key2"]).select(
            "node", (F.col("key") if level == 1 else F.xxhash64("key", "key2")).alias("key"))
        rows = space.save(again.join(nodes, "node"), f"crowded{level}")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def groups(docs: DataFrame, space: Workspace, k: int = 3, limit: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reached), a row for each row of docs.

    Null or empty texts have fingerprint zero and link like any other, and very long texts are taken whole. Rows with the
    same doc_id count as one document; rows without a doc_id link, and join others, but never name a component (null, if
    there is no other). An empty table gives none.
    """
    fps = space.save(fingerprints(docs, k), "fps")
    nodes = space.save(fps.groupBy("node").agg(F.min("doc_id").alias("low")).select("node", "low", _bytes("node").alias("fp")), "nodes")
    # a document with several fingerprints joins them
    repeated = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    several = fps.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).distinct()
    comp = space.save(components(space, links(nodes.select("node", "fp"), space, limit, BlockKeys()).union(several)), "components")
    named = nodes.join(comp, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("low").alias("component_id")), "component")
    return fps.join(named.select("node", "component_id"), "node").select("doc_id", _bytes("node").alias("fp"), "component_id")


_SENT = (["bucket", "kind", "chunk", "data"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])
_SENT_SCHEMA = "bucket long, kind int, chunk long, data binary"


def _shingle_rows(buckets: int, k: int):
    """The distinct shingles of each text. kind 0: (hash, place of the text in its piece) by ranges of hashes; kind 1: (row,
    number of shingles) of a piece. The piece's first row names it."""
    def run(batches):
        for ids, texts, _ in texts_in_pieces(batches):
            sets = [np.unique(kmer_hashes(word_hashes(t), k)) for t in texts]
            sizes = np.array([len(s) for s in sets], np.uint32)
            chunk = ids[0]
            rows = [(chunk % buckets, 1, chunk, pack(np.array(ids, np.int64), sizes))]
            h = np.concatenate(sets)
            order = np.argsort(h, kind="stable")
            h, who = h[order], np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)[order]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            rows += [(int(bucket[g[0]]), 0, chunk, pack(h[g], who[g])) for g in groups_of(bucket)]
            yield emit(rows, *_SENT)

    return run


def _shared_shingles(batches):
    """Back to the pieces: (hash, place of the text, number of texts) of shingles that several texts hold."""
    for rows in by_first(batches, ["bucket", "kind", "chunk", "data"]):
        out = [(chunk, 1, chunk, data) for _, kind, chunk, data in rows if kind == 1]
        sent = [(chunk, *unpack(data, "<u8", "<u4")) for _, kind, chunk, data in rows if kind == 0]
        if sent:
            h, who = np.concatenate([x[1] for x in sent]), np.concatenate([x[2] for x in sent])
            piece = np.repeat(np.arange(len(sent)), [len(x[1]) for x in sent])
            order = np.argsort(h, kind="stable")
            runs = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
            n = np.empty(len(h), np.uint32)
            n[order] = np.repeat(np.diff(np.append(runs, len(h))), np.diff(np.append(runs, len(h))))
            shared = np.flatnonzero(n > 1)  # pieces stay together
            for g in groups_of(piece[shared]):
                at = shared[g]
                out.append((sent[piece[at[0]]][0], 0, sent[piece[at[0]]][0], pack(h[at], who[at], n[at])))
        yield emit(out, *_SENT)


_KEPT = (["node", "n", "m", "fp", "keys", "shingles"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary()])
_KEPT_SCHEMA = "node long, n int, m int, fp binary, keys array<long>, shingles binary"


def _prefixes(batches):
    """Texts of whose n shingles 0.8 or more occur elsewhere: these m shingles, and those of them that are keys."""
    for rows in by_first(batches, ["chunk", "kind", "data"]):
        (node, n), = [unpack(data, "<i8", "<u4") for _, kind, data in rows if kind == 1]
        parts = [unpack(data, "<u8", "<u4", "<u4") for _, kind, data in rows if kind == 0]
        out = []
        if parts:
            h, who, texts = (np.concatenate(x) for x in zip(*parts, strict=True))
            fit = (5 * np.bincount(who, minlength=len(n)) >= 4 * n.astype(np.int64))[who]
            h, who, texts = h[fit], who[fit], texts[fit]
            order = np.lexsort((h, texts, who))
            h, who = h[order], who[order]
            for g in groups_of(who):
                size, own = int(n[who[g[0]]]), h[g]
                keys = len(own) - -(-4 * size // 5) + 1
                # shingles of this text alone can't be common: leaving them out raises the similarity, if anything
                out.append((int(node[who[g[0]]]), size, len(own), fingerprint(own, LANES), own[:keys].view(np.int64), own.tobytes()))
        yield emit(out, *_KEPT)


def link_sets(sizes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Stars (first row, row) of the components of rows of similarity 0.8 or more, given what of the sets may be common.

    A component grows from its first row by what is near and not reached yet. Pivot distances and fingerprints discard.
    """
    pivots = _rng(11).integers(0, 256, (PIVOTS, fps.shape[1]), dtype=np.uint8)
    distances = np.stack([hamming(fps, p) for p in pivots], axis=1).astype(np.int16)
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([len(s) for s in sets])[:-1])
    mark = np.zeros(max(int(x.max()) for x in ids) + 1, bool)
    left, a, b = np.arange(len(sizes)), [], []
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        queue = [first]
        while queue and len(left):
            q = queue.pop()
            near = np.flatnonzero((np.abs(distances[left] - distances[q]) <= DIFFER).all(axis=1))
            near = near[hamming(fps[left[near]], fps[q]) <= DIFFER]
            size = sizes[left[near]]
            fit = (5 * size >= 4 * sizes[q]) & (4 * size <= 5 * sizes[q])
            near, size = near[fit], size[fit]
            if not len(near):
                continue
            mark[ids[q]] = True
            own = [ids[i] for i in left[near]]
            common = np.add.reduceat(mark[np.concatenate(own)], np.cumsum([0, *map(len, own[:-1])]), dtype=np.int64)
            mark[ids[q]] = False
            near = near[9 * common >= 4 * (size + sizes[q])]
            if len(near):
                found = left[near].tolist()
                queue += found
                a += [first] * len(found)
                b += found
                left = np.delete(left, near)
    return a, b


def _group_links(batches):
    for rows in by_first(batches, ["meeting", "node", "n", "fp", "shingles"]):
        a, b = [], []
        if len(rows) > 1:
            node = [r[1] for r in rows]
            fps = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
            a, b = link_sets(np.array([r[2] for r in rows], np.int64), fps, [np.frombuffer(r[4], "<u8") for r in rows])
            a, b = [node[i] for i in a], [node[i] for i in b]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows (node, m, own: the group) of groups of two or more, with the number of blocks that the group is dealt into."""
    size = rows.groupBy("own").agg(F.count("*").alias("g"), F.sum("m").alias("w")).where("g > 1").select(
        "own", F.ceil(F.greatest(F.col("g") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return rows.join(size, "own").select("own", "node", "blocks")


def _meetings(rows: DataFrame, seed: int) -> DataFrame:
    """node, meeting: each row comes to the meetings of its block with every block of its group."""
    at = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int")
    rows = rows.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("node", F.xxhash64(F.lit(seed), "own", F.least("at", "other"), F.greatest("at", "other")).alias("meeting"))


def similar(docs: DataFrame, space: Workspace, k: int = 5) -> DataFrame:
    """ROW, component (the smallest ROW reached) of numbered() docs: texts whose sets of k-word shingles (A-Z in lower case)
    have a Jaccard similarity of 0.8 or more are linked, a row for each row of docs.

    Shingles are compared by 64-bit hashes. Texts of fewer than k words are one shingle; null texts and texts without a
    word are alike. Equal texts are alike, and compared once. Long texts are taken whole. An empty table gives none.
    """
    spark = docs.sparkSession
    n_parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = space.save(docs.select(ROW, F.when(text.rlike(WORD), F.md5(text)).otherwise("").alias("t"), F.octet_length(text).alias("bytes")), "slim")
    first = space.save(slim.groupBy("t").agg(F.min(ROW).alias("node")), "first")
    reps = docs.select(ROW, F.col("text").cast("binary").alias("text")).join(first.select(F.col("node").alias(ROW)), ROW, "left_semi")
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    buckets = min(1 << 20, max(64, total >> 23))  # some millions of shingles each
    sent = reps.mapInArrow(_shingle_rows(buckets, k), _SENT_SCHEMA).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    back = sent.mapInArrow(_shared_shingles, _SENT_SCHEMA).repartition(n_parts, "chunk").sortWithinPartitions("chunk")
    kept = space.save(back.mapInArrow(_prefixes, _KEPT_SCHEMA), "kept")
    keyed = kept.select("node", "m", F.explode("keys").alias("own"))
    shared = keyed.groupBy("own").agg(F.count("*").alias("c"), F.min("node").alias("low")).where("c > 1").select("own", "low")
    keyed = space.save(keyed.join(shared, "own"), "keyed")
    met = space.save(components(space, keyed.select(F.col("node").alias("a"), F.col("low").alias("b"))), "met")
    blobs = kept.select("node", "m").join(met, "node", "left").select("node", "m", F.coalesce("component", "node").alias("own"))
    blobs = space.save(_in_blocks(blobs), "blobs")
    meetings = _meetings(blobs.where(F.col("blocks") <= MAX_BLOCKS), 1)
    giant = blobs.where(F.col("blocks") > MAX_BLOCKS).select("node")
    if giant.limit(1).count():
        meetings = meetings.union(_meetings(_in_blocks(keyed.select("node", "m", "own").join(giant, "node", "left_semi")), 2))
    together = meetings.join(kept.select("node", "n", "fp", "shingles"), "node")
    together = together.repartition(n_parts, "meeting").sortWithinPartitions("meeting", "node")
    found = space.save(together.mapInArrow(_group_links, "a long, b long").distinct(), "found")
    comp = space.save(components(space, found), "components")
    named = first.join(comp, "node", "left").select("t", F.coalesce("component", "node").alias("component"))
    return slim.join(named, "t").select(ROW, "component")
