"""SentencePiece encoding and decoding, batched in numpy: merges for BPE models, a Viterbi for the others.

A text is escaped (a space becomes the word mark, one is put in front) and cut into units, each a run of marks with the
word that follows; no piece spans two units. Different units of equal length advance together. Characters that no piece
covers fall back to byte pieces.

A BPE model's scores are ranks of merges: of the neighbours that form a piece together, those of the best score are merged
first, the leftmost of equal ones, as the library does. For other models substring hashes are looked up among the sorted
keys of the pieces, and maxima over the last piece give scores and backpointers: the segmentation is the one of greatest
total score; of equal ones that with the longer last piece.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Units that a worker keeps with their ids.
CACHE = 1_000_000

#: Characters of a unit beyond which its merges are queued, not searched for.
LONG = 128

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_WORKERS: dict = {}


class Model:
    """Pieces with scores; the id of the byte piece of each byte; whether scores are ranks of merges."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int], bpe: bool = False):
        self.pieces, self.bytes_at, self.bpe = pieces, bytes_at, bpe
        self.text = [p.encode() for p in pieces]
        for byte, i in enumerate(bytes_at):
            self.text[i] = bytes([byte])
        special = set(bytes_at)
        real = [s for s in scores if s > -1e8]
        #: an uncovered character costs more than any piece
        self.unknown = min(real, default=0.0) - 10.0
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if i not in special and p:
                by_size.setdefault(len(p), []).append(i)
        self.tables = {}
        for size, ids in by_size.items():
            codes = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(-1, size)
            key, check = _fold(codes, _P)[:, -1], _fold(codes, _Q)[:, -1]
            order = np.argsort(key, kind="stable")
            self.tables[size] = (key[order], check[order], np.array(ids)[order], np.array([scores[i] for i in ids], np.float64)[order])
        if bpe:
            self._pairs(scores, {pieces[i]: i for ids in by_size.values() for i in ids})

    def _pairs(self, scores: list[float], at: dict[str, int]) -> None:
        """Sorted keys of the pairs of symbols that form a piece, with the piece and its score. A symbol is a piece's id or,
        for a character that is none, the number of pieces plus its code point."""
        self.single = {ord(p): i for p, i in at.items() if len(p) == 1}
        found = []
        for p, i in at.items():
            for cut in range(1, len(p)):
                pair = [at.get(x, len(self.pieces) + ord(x) if len(x) == 1 else None) for x in (p[:cut], p[cut:])]
                if None not in pair:
                    found.append((pair[0] << 21 | pair[1], i))
        found.sort()
        self.pair = np.array([k for k, _ in found], np.int64)
        self.pair_id = np.array([i for _, i in found], np.int64)
        self.pair_score = np.array([scores[i] for _, i in found], np.float64)

    @classmethod
    def load(cls, path: str) -> "Model":
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        for i in range(n):
            if m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                pieces[i] = ""
        at = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        spec = sentencepiece_model_pb2.ModelProto.FromString(m.serialized_model_proto()).trainer_spec
        return cls(pieces, [m.get_score(i) for i in range(n)], at, spec.model_type == spec.BPE)


def _fold(codes: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of all prefixes, a column for each length from 0."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * base + codes[:, j] + np.uint64(1)
    return out


def segment(model: Model, codes: np.ndarray) -> list[list[int]]:
    """Piece ids of units of equal length (rows of code points); -1 stands for a character in bytes."""
    m, n = codes.shape
    h, g = _fold(codes, _P), _fold(codes, _Q)
    score, piece = {}, {}
    for size, (key, check, ids, scores) in model.tables.items():
        if size > n:
            continue
        with np.errstate(over="ignore"):
            p, q = np.uint64(1), np.uint64(1)
            for _ in range(size):
                p, q = p * _P, q * _Q
            want = h[:, size:] - h[:, :-size] * p
            also = g[:, size:] - g[:, :-size] * q
        at = np.minimum(np.searchsorted(key, want.ravel()), len(key) - 1)
        hit = (key[at] == want.ravel()) & (check[at] == also.ravel())
        score[size] = np.where(hit, scores[at], -np.inf).reshape(want.shape)
        piece[size] = np.where(hit, ids[at], -1).reshape(want.shape)
    if 1 not in score:
        score[1], piece[1] = np.full((m, n), -np.inf), np.full((m, n), -1)
    score[1] = np.where(piece[1] < 0, model.unknown, score[1])
    best = np.full((m, n + 1), -np.inf)
    best[:, 0] = 0
    last = np.zeros((m, n + 1), np.int64)
    sizes = sorted(score, reverse=True)
    for j in range(1, n + 1):
        top, pick = np.full(m, -np.inf), np.zeros(m, np.int64)
        for size in sizes:
            if size <= j:
                cand = best[:, j - size] + score[size][:, j - size]
                up = cand > top
                top = np.where(up, cand, top)
                pick[up] = size
        best[:, j], last[:, j] = top, pick
    out: list[list[int]] = [[] for _ in range(m)]
    rows, at = np.arange(m), np.full(m, n)
    steps = []
    while len(rows):
        size = last[rows, at]
        at = at - size
        got = np.empty(len(rows), np.int64)
        for s in np.unique(size):
            w = size == s
            got[w] = piece[int(s)][rows[w], at[w]]
        steps.append((rows, got, at))
        rows, at = rows[at > 0], at[at > 0]
    for rows, got, at in reversed(steps):
        for r, i, a in zip(rows.tolist(), got.tolist(), at.tolist(), strict=True):
            if i >= 0:
                out[r].append(i)
            else:
                out[r].extend(model.bytes_at[b] for b in chr(int(codes[r, a])).encode("utf-8", "surrogatepass"))
    return out


def _look_up(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (-inf where the two form no piece) and pieces of pairs of symbols."""
    if not len(model.pair):
        return np.full(left.shape, -np.inf), np.full(left.shape, -1)
    key = left << 21 | right
    at = np.minimum(np.searchsorted(model.pair, key), len(model.pair) - 1)
    return np.where(model.pair[at] == key, model.pair_score[at], -np.inf), model.pair_id[at]


def _merge_queued(model: Model, symbols: np.ndarray) -> list[int]:
    """merge() for the symbols of one long unit: pairs wait in a heap."""
    own, n = symbols.tolist(), len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    score, piece = _look_up(model, symbols[:-1], symbols[1:])
    heap = [(-score[i], i, own[i], own[i + 1], int(piece[i])) for i in np.flatnonzero(score > -np.inf).tolist()]
    heapq.heapify(heap)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if own[i] != left or j < 0 or own[j] != right:
            continue
        own[i], own[j], after[i] = new, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0:
                s, p = _look_up(model, np.array([own[a]]), np.array([own[b]]))
                if s[0] > -np.inf:
                    heapq.heappush(heap, (-s[0], a, own[a], own[b], int(p[0])))
    return [x for x in own if x >= 0]


def merge(model: Model, codes: np.ndarray) -> list[list[int]]:
    """Piece ids of units of equal length (rows of code points) by a BPE model's merges."""
    known, at = np.unique(codes, return_inverse=True)
    start = np.array([model.single.get(c, len(model.pieces) + c) for c in known.tolist()], np.int64)[at].reshape(codes.shape)
    if codes.shape[1] > LONG:
        done = [(k, _merge_queued(model, s)) for k, s in enumerate(start)]
    else:
        done, rows, own = [], np.arange(len(start)), start
        score, piece = _look_up(model, own[:, :-1], own[:, 1:])
        while len(rows):
            m, n = own.shape
            best = score.argmax(axis=1) if n > 1 else np.zeros(m, np.int64)
            more = score[np.arange(m), best] > -np.inf if n > 1 else np.zeros(m, bool)
            done += zip(rows[~more].tolist(), own[~more].tolist(), strict=True)
            rows, own, score, piece, best = rows[more], own[more], score[more], piece[more], best[more]
            m = len(rows)
            if not m:
                break
            # each row loses the right one of its best pair
            r = np.arange(m)
            own[r, best] = piece[r, best]
            keep = np.ones(own.shape, bool)
            keep[r, best + 1] = False
            own = own[keep].reshape(m, n - 1)
            keep = np.ones(score.shape, bool)
            keep[r, best] = False
            score, piece = score[keep].reshape(m, n - 2), piece[keep].reshape(m, n - 2)
            for pair in (best - 1, best):
                w = np.flatnonzero((pair >= 0) & (pair < n - 2))
                p = pair[w]
                score[w, p], piece[w, p] = _look_up(model, own[w, p], own[w, p + 1])
    out: list[list[int]] = [[] for _ in range(len(codes))]
    n = len(model.pieces)
    for k, ids in done:
        if max(ids) < n:
            out[k] = ids
        else:
            for i in ids:
                out[k] += [i] if i < n else [model.bytes_at[b] for b in chr(i - n).encode("utf-8", "surrogatepass")]
    return out


class Encoder:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def _learn(self, units: set[str]) -> None:
        """units stand without their first mark."""
        by_size: dict[int, list[str]] = {}
        for u in units:
            by_size.setdefault(len(u) + 1, []).append(u)
        for size, own in by_size.items():
            step = max(1, 200_000 // size)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                codes = np.frombuffer((MARK + MARK.join(part)).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
                for u, ids in zip(part, (merge if self.model.bpe else segment)(self.model, codes), strict=True):
                    self.cache[u] = np.array(ids, "<i4").tobytes()

    @staticmethod
    def units(text: str) -> list[str]:
        """Without the first word mark of each."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, run = [], ""
        for p in parts[:-1]:
            if p:
                out.append(run + p)
                run = ""
            else:
                run += MARK
        return [*out, run + parts[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers; an empty text has none."""
        cut = [self.units(t) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = set().union(*cut).difference(self.cache)
        if new:
            self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def decode(model: Model, ids: np.ndarray) -> bytes:
    """The text, its word marks spaces again, without the one put in front."""
    text = b"".join([model.text[i] for i in ids.tolist()]).replace(MARK.encode(), b" ")
    return text[1:] if text[:1] == b" " else text


def _run(model, keep_ids: bool):
    def run(batches):
        key = id(model) if model is None else len(model.value.pieces)
        if key not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[key] = Encoder(model.value)
        own = _WORKERS[key]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                docs = b.column(0).slice(at, 256)
                texts = [t or "" for t in b.column(1).slice(at, 256).to_pylist()]
                coded = own.encode(texts)
                ids = [np.frombuffer(x, "<i4") for x in coded]
                cols = [docs, pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in coded], pa.int64()),
                        pa.array([decode(own.model, x) == t.replace(MARK, " ").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)])]
                names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("piece_ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip and, with keep_ids, piece_ids.

    round_trip: decoding gives the text back (the word mark itself counts as a space, as it does in the library). A null
    or empty text has no pieces. Rows with null or repeated doc_id are rows of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model.load(model_path))
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", piece_ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_run(model, keep_ids), schema)
