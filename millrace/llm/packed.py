"""Arrays in binary columns: rows by the thousand travel as one, hashes of words and word k-mers, texts in pieces."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

_MULT = np.uint64(0x9E3779B97F4A7C15)

#: Words that a worker keeps with their hashes: rare words, seen once, would fill any larger cache.
WORDS_KEPT = 150_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z in lower case."""
    return np.array(list(map(_HASHES.__getitem__, (text or b"").lower().split())), np.uint64)


def kmer_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words (given as hashes), repeats included; of fewer words: of the whole sequence."""
    k = min(k, len(words))
    n = len(words) - k + 1 if k else 0
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ words[i : i + n]) * _MULT
            h ^= h >> np.uint64(29)
    return h


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length, their bytes put together plane by plane."""
    out = [struct.pack("<I", len(columns[0]))]
    for c in columns:
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes())
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def emit(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def texts_in_pieces(batches):
    """(first column, texts of the second, rows) in pieces of some 16 MB of text."""
    for b in batches:
        ids, col, at, size = b.column(0).to_pylist(), b.column(1), 0, 0
        for i in range(b.num_rows):
            size += len(col[i].as_buffer()) if col[i].is_valid else 0
            if size > 1 << 24 or i == b.num_rows - 1:
                part = col.slice(at, i + 1 - at).to_pylist()
                yield ids[at : i + 1], [x or b"" for x in part], b.slice(at, i + 1 - at)
                at, size = i + 1, 0


def by_first(batches, columns: list[str]):
    """Rows with one value in the first of the columns; they stand together."""
    held, rows = None, []
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in columns], strict=True):
            if row[0] != held and rows:
                yield rows
                rows = []
            held = row[0]
            rows.append(row)
    if rows:
        yield rows


def groups_of(keys: np.ndarray) -> list[np.ndarray]:
    """Places of equal neighbours."""
    return np.split(np.arange(len(keys)), np.flatnonzero(keys[1:] != keys[:-1]) + 1) if len(keys) else []
