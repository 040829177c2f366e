"""Suffix-array dedup: longest-previous-factor arrays remove later copies of long strings and keep the first.

Only strings of LENGTH bytes matter, so a suffix is sorted by its first LENGTH bytes. Each such window is filed under its
minimizer: the leftmost of its GRAM-byte substrings with the least hash. Equal windows have equal minimizers, so

1. minimizers that occur once are dropped (each map task first collapses its own repeats, so a minimizer sends one row a
   task, however often it occurs);
2. the windows of a repeated minimizer occurrence form a segment, and equal segments are again collapsed in the task;
3. the different segments that share minimizers meet in a shard, whose suffix array, LCP and longest-previous-factor
   array (previous and next smaller positions in suffix order) tell which windows occur earlier.

Order is (row, start), rows numbered by (doc_id, text hash). A minimizer with many different segments (in one task, or in
all) has its windows compared one by one by a distributed minimum instead: no shard gathers an unbounded group.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Workspace, numbered
from .packed import by_first, emit, pack, texts_in_pieces, unpack

LENGTH, GRAM = 100, 28
SPAN = LENGTH - GRAM + 1
#: Different segments of one minimizer in a task beyond which it is crowded.
CROWDED = 64
#: Different segments of one minimizer in all tasks beyond which it is crowded, too.
GATHERED = 4096
#: Bytes of text for each partition of a shuffle, at most (about five times as many are shuffled).
PART = 1 << 26

_RNG = np.random.Generator(np.random.PCG64(99))
_TABLE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = [np.uint64(0x9E3779B97F4A7C15)]
with np.errstate(over="ignore"):
    for _ in range(5):
        _M.append(_M[-1] * _M[-1])
_BLOCK = 60_000


def minimizers(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: first and last window start, minimizer's place, its 48-bit hash."""
    n = len(text) - LENGTH + 1
    parts = []
    for at in range(0, max(0, n), _BLOCK):
        end = min(n, at + _BLOCK)
        with np.errstate(over="ignore"):
            h = _TABLE[text[at : end + LENGTH - 1]]
            h = h[:-1] * _M[0] + h[1:]
            h4 = h[:-2] * _M[1] + h[2:]
            h8 = h4[:-4] * _M[2] + h4[4:]
            h16 = h8[:-8] * _M[3] + h8[8:]
            h24 = h16[:-8] * _M[3] + h8[16:]
            h = h24[:-4] * _M[2] + h4[24:]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        low = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: end - at], low[SPAN - 64 : SPAN - 64 + end - at])
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(low) - 1]])
        m = low[first]
        parts.append((first + at, last + at, (m & np.uint64(0xFFFF)).astype(np.int64) + at, m >> np.uint64(16)))
    if not parts:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_A = (["bucket", "kind", "doc", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])
_A_SCHEMA = "bucket int, kind int, doc long, data binary"


def _find_minimizers(buckets: int):
    def run(batches):
        for ids, texts, _ in texts_in_pieces(batches):
            found = []
            for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                if len(text) >= LENGTH:
                    _, _, at, h = minimizers(np.frombuffer(text, np.uint8))
                    found.append((h, np.full(len(h), doc, np.int64), at.astype(np.uint32), np.full(len(h), k, np.int64)))
            if not found:
                continue
            h, doc, at, k = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, at, k = h[order], doc[order], at[order], k[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            again = ~new
            again[:-1] |= ~new[1:]  # occurs more than once in this task
            rows = []
            mine = np.flatnonzero(again)
            mine = mine[np.argsort(k[mine], kind="stable")]
            for group in np.split(mine, np.flatnonzero(np.diff(k[mine])) + 1) if len(mine) else []:
                rows.append((int(k[group[0]]) % buckets, 1, int(doc[group[0]]), at[group].tobytes()))
            send = np.flatnonzero(new)
            bucket = (h[send] % np.uint64(buckets)).astype(np.int64)
            send = send[np.lexsort((k[send], bucket))]
            bucket = (h[send] % np.uint64(buckets)).astype(np.int64)
            for group in np.split(np.arange(len(send)), np.flatnonzero(np.diff(bucket)) + 1):
                s = send[group]
                rows.append((int(bucket[group[0]]), 0, 0, pack(h[s], doc[s], at[s], again[s].astype(np.uint8))))
            yield emit(rows, *_A)

    return run


def _mark_repeats(batches):
    """(doc, data): places of minimizers that occur again somewhere."""
    names, kinds = ["doc", "data"], [pa.int64(), pa.binary()]
    for rows in by_first(batches, ["bucket", "kind", "doc", "data"]):
        out = [(doc, data) for _, kind, doc, data in rows if kind == 1]
        sent = [unpack(data, "<u8", "<i8", "<u4", "u1") for _, kind, _, data in rows if kind == 0]
        if sent:
            h, doc, at, local = (np.concatenate(x) for x in zip(*sent, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, at, local = h[order], doc[order], at[order], local[order]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= same[1:]
            mark = np.flatnonzero(same & (local == 0))
            mark = mark[np.argsort(doc[mark], kind="stable")]
            for group in np.split(mark, np.flatnonzero(np.diff(doc[mark])) + 1) if len(mark) else []:
                out.append((int(doc[group[0]]), at[group].tobytes()))
        yield emit(out, names, kinds)


#: kind 0: a segment for a shard; 1: coverage known in the task (doc, start, stop of windows); 2: a window, with its digest
#: as key; 3: a crowded minimizer. Kinds 1 and 2 need no neighbours: they're dealt by place, not by minimizer.
_B = (["bucket", "kind", "h", "key", "doc", "start", "stop", "data"],
      [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()])
_B_SCHEMA = "bucket int, kind int, h long, key binary, doc long, start int, stop int, data binary"


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _windows(bucket: int, h: int, doc: int, start: int, data: bytes) -> list[tuple]:
    return [(bucket, 2, h, _digest(data[j : j + LENGTH]), doc, start + j, start + j, None) for j in range(len(data) - LENGTH + 1)]


def _segments(buckets: int):
    def run(batches):
        for ids, texts, batch in texts_in_pieces(batches):
            places, first, rows, count = batch.column(2).to_pylist(), {}, [], {}
            for k in np.argsort(np.array(ids, np.int64), kind="stable"):
                doc, text = ids[k], texts[k]
                start, stop, at, h = minimizers(np.frombuffer(text, np.uint8))
                marked = np.unique(np.frombuffer(b"".join(places[k]), "<u4").astype(np.int64))
                pick = np.flatnonzero(np.isin(at, marked))
                for s, e, x in zip(start[pick].tolist(), stop[pick].tolist(), h[pick].tolist(), strict=True):
                    data = text[s : e + LENGTH]
                    key = _digest(data)
                    if key in first:
                        if (doc, s) != first[key][:2]:
                            rows.append((x % buckets, 1, x, None, doc, s, e, None))
                    else:
                        first[key] = (doc, s, e, x, data)
                        count[x] = count.get(x, 0) + 1
            for x, n in count.items():
                if n > CROWDED:
                    rows.append((x % buckets, 3, x, None, 0, 0, 0, None))
            for doc, s, e, x, data in first.values():
                if count[x] > CROWDED:
                    rows += _windows(x % buckets, x, doc, s, data)
                else:
                    rows.append((x % buckets, 0, x, None, doc, s, e, data))
                if len(rows) > 20_000:
                    yield emit(rows, *_B)
                    rows = []
            yield emit(rows, *_B)

    return run


def _ranks(parts: list[np.ndarray]) -> np.ndarray:
    """Dense rank of rows by parts, each of whole numbers below 2**32 (the first may be any)."""
    x = parts[0]
    for y in parts[1:]:
        x = (x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64)
    return np.unique(x, return_inverse=True)[1].astype(np.uint32)


def longest_previous_factor(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For the suffixes at starts (ascending; each with LENGTH bytes): the longest prefix, up to LENGTH, that an earlier
    suffix among them shares.

    The suffix array comes from ranks of prefixes of doubled length; the LCP of neighbours from the same ranks; previous
    and next smaller positions in suffix order by pointer jumping, each pointer carrying the least LCP on its way.
    """
    n = len(text)
    x = np.zeros(n, np.uint64)
    for i in range(8):
        x[: n - i] |= text[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    rank = {8: np.unique(x, return_inverse=True)[1].astype(np.uint32)}
    for size in (8, 16, 32):
        r = rank[size]
        rank[2 * size] = _ranks([r, np.concatenate([r[size:], np.zeros(min(size, n), np.uint32)])])
    full = _ranks([rank[64][starts], rank[64][starts + LENGTH - 64]])
    order = np.argsort(full, kind="stable")  # equal prefixes by position
    sa, r = starts[order], full[order]
    m = len(sa)
    lcp = np.zeros(m + 1, np.int64)  # lcp[i]: of suffixes i - 1 and i
    a, b, off = sa[:-1].copy(), sa[1:], np.zeros(m - 1, np.int64)
    for size in (64, 32, 16, 8):
        fits = off + size <= LENGTH
        same = fits.copy()
        same[fits] = rank[size][a[fits] + off[fits]] == rank[size][b[fits] + off[fits]]
        off[same] += size
    for _ in range(8):
        fits = off < LENGTH
        same = fits.copy()
        same[fits] = text[a[fits] + off[fits]] == text[b[fits] + off[fits]]
        off[same] += 1
    lcp[1:m] = np.where(r[1:] == r[:-1], LENGTH, np.minimum(off, LENGTH))
    best = np.zeros(m, np.int64)
    for way in (1, -1):
        pos = sa if way == 1 else sa[::-1]
        gap = lcp[:m] if way == 1 else lcp[1:][::-1]
        # p[i]: the nearest place before i that may hold a smaller position; 0 stands before all, holding none
        pos = np.concatenate([[-1], pos])
        p = np.arange(-1, m)
        p[0] = 0
        low = np.concatenate([[0], gap])
        while True:
            up = np.flatnonzero(pos[p] > pos)
            if not len(up):
                break
            low[up] = np.minimum(low[up], low[p[up]])
            p[up] = p[p[up]]
        got = np.where(p[1:] > 0, low[1:], 0)
        best = np.maximum(best, got if way == 1 else got[::-1])
    out = np.zeros(m, np.int64)
    out[order] = best
    return out


def _shard(rows: list[tuple]) -> list[tuple]:
    """Coverage (doc, start, stop) among different segments that share minimizers, given (doc, start, stop, data)."""
    rows = sorted(rows, key=lambda x: (x[0], x[1]))
    text = np.frombuffer(b"".join(x[3] for x in rows), np.uint8)
    size = np.array([len(x[3]) for x in rows])
    base = np.cumsum(size) - size
    count = size - LENGTH + 1
    owner = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = np.flatnonzero(longest_previous_factor(text, base[owner] + inner) >= LENGTH)
    out = []
    if len(found):
        own, at = owner[found], inner[found]
        cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(at) != 1)) + 1
        for group in np.split(np.arange(len(found)), cut):
            doc, start = rows[own[group[0]]][:2]
            out.append((doc, start + int(at[group[0]]), start + int(at[group[-1]])))
    return out


_C = (["key", "doc", "start", "stop"], [pa.binary(), pa.int64(), pa.int32(), pa.int32()])
_C_SCHEMA = "key binary, doc long, start int, stop int"


def _cover(batches):
    """Coverage, with a null key, and windows of crowded minimizers, with their hash.

    Rows come by minimizer; of the one at hand at most GATHERED different segments are held, then it counts as crowded:
    those held and all that follow leave as windows.
    """
    out, rows, size = [], [], 0
    h, crowded, firsts = None, False, {}

    def windows(doc, start, data):
        return [(k, d, s, e) for _, _, _, k, d, s, e, _ in _windows(0, 0, doc, start, data)]

    for b in itertools.chain(batches, [None]):
        if b is None:
            members = [(None,) * 6]  # ends the last minimizer
        else:
            done = pc.is_in(b.column("kind"), pa.array([1, 2], pa.int32()))
            if (ready := b.filter(done).select(_C[0])).num_rows:
                yield ready
            b = b.filter(pc.invert(done))
            members = zip(*[b.column(c).to_pylist() for c in ("h", "kind", "doc", "start", "stop", "data")], strict=True)
        for own, kind, doc, start, stop, data in members:
            if own != h:
                if len(firsts) > 1:
                    rows += firsts.values()
                    size += sum(len(x[3]) for x in firsts.values())
                if rows and (size > 1 << 20 or own is None):
                    out += [(None, *x) for x in _shard(rows)]
                    rows, size = [], 0
                h, crowded, firsts = own, False, {}
            if own is None:
                continue
            if kind == 3:  # comes before the segments
                crowded = True
            elif crowded:
                out += windows(doc, start, data)
            elif data not in firsts:
                firsts[data] = (doc, start, stop, data)
                if len(firsts) > GATHERED:
                    crowded = True
                    for d, s, _, x in firsts.values():
                        out += windows(d, s, x)
                    firsts = {}
            else:
                old, new = firsts[data], (doc, start, stop, data)
                if old[:2] != new[:2]:
                    out.append((None, *max(old, new)[:3]))
                firsts[data] = min(old, new)
            if len(out) >= 50_000:
                yield emit(out, *_C)
                out = []
    for at in range(0, len(out), 50_000):
        yield emit(out[at : at + 50_000], *_C)


def repeated_spans(docs: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(marked, spans) of numbered docs: marked has doc (the row's number), id, text (null where the document shares no minimizer), n_bytes, sha256;
    spans has doc, spans, an array of (start, stop) of window starts that occur earlier."""
    base = docs.select(F.col(ROW).alias("doc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                       F.col("doc_id").cast("long").alias("id"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, int(total * 0.03 / 100_000))
    spark = docs.sparkSession
    n_parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    sent = base.select("doc", "text").mapInArrow(_find_minimizers(buckets), _A_SCHEMA).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    places = sent.mapInArrow(_mark_repeats, "doc long, data binary").groupBy("doc").agg(F.collect_list("data").alias("places"))
    marked = base.join(places, "doc", "left").select(
        "doc", "id", F.when(F.col("places").isNotNull(), F.col("text")).alias("text"), "places",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(F.col("places").isNull(), F.sha2("text", 256)).alias("sha256"))
    marked = space.save(marked, "marked", release=True)
    some = marked.where("places is not null").select("doc", "text", "places")
    segments = some.mapInArrow(_segments(buckets), _B_SCHEMA)
    # a crowded minimizer's note sorts before its segments
    dealt = F.when(F.col("kind").isin(1, 2), F.xxhash64("doc", "start")).otherwise(F.col("bucket"))
    segments = segments.select("*", (-F.col("kind")).alias("o")).repartition(n_parts, dealt).sortWithinPartitions("h", "o").drop("o")
    covered = space.save(segments.mapInArrow(_cover, _C_SCHEMA), "covered", release=True)
    windows = covered.where("key is not null")
    least = windows.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("m"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(least, "key").where("struct(doc, start) <> m").select("doc", "start", "stop")
    spans = covered.where("key is null").select("doc", "start", "stop").union(later).groupBy("doc").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))
    return marked, spans


def removed_mask(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    s = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, s[:, 1] + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(keep_text: bool):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            firsts, lasts = (b.column(c).to_pylist() for c in (2, 3))
            rows = []
            for i, doc in enumerate(ids):
                text = texts[i].as_py()
                mask = removed_mask(len(text), list(zip(firsts[i], lasts[i], strict=True)))
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                rows.append((doc["doc"], doc["id"], len(text), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "ignore") if keep_text else None))
            yield emit(rows, ["doc", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                        [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    return run


def dedup(docs: DataFrame, space: Workspace, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (what remains as text, without broken
    characters; null where nothing went). If docs are numbered(), ROW too.

    Every byte covered by a LENGTH-byte string that starts earlier goes; strings are judged on the input. A null text
    is empty. A null doc_id comes before all others; rows that share a doc_id are rows of their own, in the order of their
    texts' hashes. Texts shorter than LENGTH lose nothing. An empty table gives an empty one.
    """
    named = ROW in docs.columns
    marked, spans = repeated_spans(docs if named else numbered(docs, space), space)
    hit = marked.where("places is not null").select("doc", "id", "text").join(spans, "doc", "left").select(
        F.struct("doc", "id").alias("doc"), "text", F.coalesce(F.col("spans.start"), F.array().cast("array<int>")).alias("first"),
        F.coalesce(F.col("spans.stop"), F.array().cast("array<int>")).alias("last"))
    schema = "doc long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    cut = hit.mapInArrow(_cut(keep_text), schema)
    rest = marked.where("places is null").select(
        "doc", "id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    out = cut.unionByName(rest).withColumnsRenamed({"id": "doc_id", "doc": ROW})
    return out.drop(*([] if named else [ROW]), *([] if keep_text else ["kept"]))
