"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0 < 1 < ... < K share one weight vector: P(grade <= j) = sigmoid(t_j - w.x) with rising thresholds t_j. The
output is the expected grade. Features are the presence of words in the whole text (lower case, letters only), known by
64-bit hashes.

The labels of this library's tables say only whether a document is toxic. Severity is graded by how many of the words
that mark toxic documents it holds: such words are those much more frequent among toxic than among other sample
documents; a toxic document is grade 2 if it holds more of them than the median toxic document, otherwise 1.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the regression is fitted on at most, half of them toxic if there are enough; the words of the
#: sample (most frequent first) that it looks at; the documents of the sample that a word must stand in.
SAMPLE, VOCABULARY, MIN_DOCS = 6000, 50_000, 3

_WORDS = re.compile(r"[^\W\d_]+")
_KEPT = 150_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


_HASHES = _Hashes()


def words(text: str | None) -> np.ndarray:
    """Hashes of the distinct words of a text: non-negative longs, in no order."""
    return np.array([_HASHES[w] for w in set(_WORDS.findall((text or "").lower()))], np.int64)


class OrdinalModel:
    """Hashes of words (ascending) with their weights, and rising thresholds."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.names, self.weights, self.thresholds = names, weights, thresholds

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """Sum of the weights of each bag's words."""
        if not len(self.names) or not bags:
            return np.zeros(len(bags))
        all_words = np.concatenate(bags)
        at = np.minimum(np.searchsorted(self.names, all_words), len(self.names) - 1)
        gain = np.where(self.names[at] == all_words, self.weights[at], 0.0)
        return np.bincount(np.repeat(np.arange(len(bags)), [len(b) for b in bags]), gain, len(bags))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of P(grade > j)."""
        z = self.thresholds[None, :] - np.asarray(scores, np.float64)[:, None]
        return (1 / (1 + np.exp(np.clip(z, -50, 50)))).sum(axis=1)


def loss(theta: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, p: int, penalty: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with a ridge penalty on the weights, and its gradient. theta: p weights, the first
    threshold, logarithms of the gaps to the next ones; (row, col): the words present; y: grades."""
    n, top = len(y), len(theta) - p
    w, a, gaps = theta[:p], theta[p], theta[p + 1 :]
    t = a + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    s = np.bincount(row, w[col], n)
    cdf = 1 / (1 + np.exp(-np.clip(t[None, :] - s[:, None], -40, 40)))
    full = np.concatenate([np.zeros((n, 1)), cdf, np.ones((n, 1))], axis=1)
    upper, lower = full[np.arange(n), y + 1], full[np.arange(n), y]
    prob = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / prob, lower * (1 - lower) / prob
    grad_t = np.array([(-du[y == j].sum() + dl[y == j + 1].sum()) / n for j in range(top)])
    grad_w = np.bincount(col, ((du - dl) / n)[row], p) + penalty * w
    grad_gaps = [grad_t[j + 1 :].sum() * np.exp(gaps[j]) for j in range(top - 1)]
    return -np.log(prob).mean() + penalty / 2 * (w @ w), np.concatenate([grad_w, [grad_t.sum()], grad_gaps])


def fit(names: np.ndarray, row: np.ndarray, col: np.ndarray, grades: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> OrdinalModel:
    """Maximum likelihood by Adam, full batch. Document row[i] holds the word names[col[i]] (names ascending).

    Without any document there is no evidence: every text gets severity 0.
    """
    p, y = len(names), grades.astype(np.int64)
    if not len(y):
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), np.array([50.0]))
    top = int(y.max(initial=1))
    share = np.array([(y <= j).mean() for j in range(top)])
    base = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3))
    theta = np.concatenate([np.zeros(p), [base[0]], np.log(np.maximum(np.diff(base), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = loss(theta, row, col, y, p, penalty)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    used = np.abs(theta[:p]) > 1e-6
    return OrdinalModel(names[used], theta[:p][used], theta[p] + np.concatenate([[0], np.cumsum(np.exp(theta[p + 1 :]))]))


def severity(row: np.ndarray, col: np.ndarray, p: int, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 of sample documents."""
    bad, good = np.bincount(col[toxic[row]], minlength=p), np.bincount(col[~toxic[row]], minlength=p)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    marks = (bad >= max(3, n_bad // 50)) & (bad / n_bad > 8 * (good + 0.5) / n_good)
    hits = np.bincount(row, marks[col], len(toxic))
    middle = np.median(hits[toxic]) if toxic.any() else 0
    return np.where(toxic, np.where(hits > middle, 2, 1), 0)


def _bags(batches):
    for b in batches:
        bags = [words(t) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.int64()))], ["doc_id", "toxic", "words"])


def _present(names: np.ndarray):
    """Which of the names each document holds, a bit each."""
    def run(batches):
        for b in batches:
            rows = [np.packbits(np.isin(names, np.array(w, np.int64))).tobytes() for w in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["doc_id", "toxic", "bits"])

    return run


def train(docs: DataFrame, labels: DataFrame, space, sample: int = SAMPLE) -> OrdinalModel:
    """Fitted on a hashed sample of labelled rows: half toxic, half not, sample at most in all.

    Rows whose doc_id, toxic or text is null are left out; of repeated labels of a document the highest counts, of repeated
    texts one. Without labelled rows every text gets severity 0. The driver gets VOCABULARY hashes and a bit for each of
    them and each sample document: 38 MB at most.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = None
    for x in (0, 1):
        part = known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample // 2)
        pick = part if pick is None else pick.union(part)
    # the sample has a fixed bound, so its ids may be broadcast
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(pick), "doc_id").select(
        F.col("doc_id").cast("long"), F.col("toxic").cast("long"), "text").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    bags = space.save(rows.mapInArrow(_bags, "doc_id long, toxic long, words array<long>"), "sample")
    seen = bags.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    names = np.sort(np.array([r[0] for r in seen.orderBy(F.desc("n"), "w").limit(VOCABULARY).collect()], np.int64))
    got = bags.mapInArrow(_present(names), "doc_id long, toxic long, bits binary").orderBy("doc_id").collect()
    cols = [np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(names))) for r in got]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols]).astype(np.int64)
    col = np.concatenate(cols) if cols else np.empty(0, np.int64)
    return fit(names, row, col, severity(row, col, len(names), np.array([r.toxic == 1 for r in got], bool)))


def _score(sent, limit: float):
    def run(batches):
        model = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                e = model.expected(model.scores([words(t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(e), pa.array(np.rint(e).astype(np.int32)), pa.array(e >= limit)],
                    ["doc_id", "expected_severity", "grade", "toxic"])

    return run


def grade(docs: DataFrame, model: OrdinalModel, limit: float = 0.5) -> DataFrame:
    """doc_id, expected_severity, grade (nearest whole), toxic (expected severity of limit or more), for every row.

    A null or empty text has no words, and so the severity of a text without any evidence; long texts are taken whole.
    Repeated rows are scored each; other columns are ignored. An empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _score(sent, limit), "doc_id long, expected_severity double, grade int, toxic boolean")
