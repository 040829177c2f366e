"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import chaining, licenses, mixing, packed, quality, simhash, suffix, tokenbin, topk, toxicity, viterbi
from millrace.llm.common import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size_note string, words int, block string"


def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long, shared = make(3000), make(70)
    near = shared.split()
    near[30] = "changed"
    texts = [make(rng.randint(5, 120)) for _ in range(40)]
    texts += ["", None, " \n\t ", long, long, make(60) + " " + shared + " " + make(20), make(9) + "\n" + shared, make(50) + " " + " ".join(near),
              "é" * 150 + " x", "é" * 150 + " y", "ab " * 80, texts[0], texts[0].upper(), "一二三 " * 60, "#$% & a.\nb\nb\n b"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 9 else None, len(t or ""), "x", i, "y") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_suffix_dedup(spark, docs, empty):
    def brute(items):
        seen, out = set(), {}
        for i, t in items:
            n, mask = len(t), bytearray(len(t))
            for s in range(n - 99):
                w = t[s : s + 100]
                if w in seen:
                    mask[s : s + 100] = b"\1" * 100
                seen.add(w)
            runs = sum(1 for k in range(n) if mask[k] and (k == 0 or not mask[k - 1]))
            out[i] = (n, sum(mask), runs, hashlib.sha256(bytes(c for c, m in zip(t, mask) if not m)).hexdigest())
        return out

    want = brute([(r[0], (r[1] or "").encode()) for r in rows()])
    for crowd in (64, 1):
        suffix.CROWDED, old = crowd, suffix.CROWDED
        try:
            got = {r[0]: tuple(r)[1:] for r in suffix.dedup(docs, Workspace(spark, "t")).collect()}
        finally:
            suffix.CROWDED = old
        assert got == want
    assert suffix.dedup(empty, Workspace(spark, "t")).collect() == []


def test_suffix_dedup_null_and_repeated_ids(spark):
    import corpus_pipeline as C

    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q, long = make(150), make(160), make(900)
    data = [(1, make(300) + p), (1, p[:120]), (1, make(700)), (None, make(500) + q), (None, q), (None, make(120)), (2, long), (2, long), (2, long),
            (3, make(40) + q + make(30)), (3, make(200)), (4, None), (4, "x"), (None, None), (5, make(400) + p)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    seen, want, left = set(), [], []
    for r in docs.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect():
        t = (r.text or "").encode()
        mask = bytearray(len(t))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                mask[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        kept = bytes(c for c, m in zip(t, mask) if not m)
        want.append((r.doc_id, len(t), sum(mask), hashlib.sha256(kept).hexdigest()))
        if not any(mask) or kept.split():
            left.append((r.doc_id, kept.decode() if any(mask) else r.text))
    got = suffix.dedup(docs, Workspace(spark, "t")).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = C.drop_repeated_passages(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, left))


@pytest.mark.parametrize("gathered", [0, 1, 3, 4096])
def test_segments_of_crowded_minimizers(monkeypatch, gathered):
    monkeypatch.setattr(suffix, "GATHERED", gathered)
    rng, rows, n = random.Random(7), [], suffix.LENGTH
    for h in range(6):
        shared = [rng.randbytes(n + 30) for _ in range(3)]  # equal windows have equal minimizers
        for doc in rng.sample(range(40), 5 + h):
            data = rng.choice(shared) if rng.random() < 0.6 else rng.randbytes(20) + rng.choice(shared)[:n + 5]
            data = bytes([h]) * 2 + data if h % 2 else data
            rows.append((h, 0, doc, 10 * h, 10 * h + len(data) - n, data))
        if h == 4:
            rows.append((h, 3, 0, 0, 0, None))
    rows.sort(key=lambda r: (r[0], -r[1]))
    want, first = set(), {}
    places = {(h, doc, start + j): data[j : j + n] for h, kind, doc, start, _, data in rows if not kind for j in range(len(data) - n + 1)}
    for (h, doc, at), w in places.items():
        first[h, w] = min(first.get((h, w), (doc, at)), (doc, at))
    want = {(doc, at) for (h, doc, at), w in places.items() if first[h, w] != (doc, at)}
    batches = [suffix.emit([(0, k, h, None, d, a, b, x) for h, k, d, a, b, x in rows[i : i + 4]], *suffix._B) for i in range(0, len(rows), 4)]
    got, least, later = set(), {}, []
    for b in suffix._cover(batches):
        for key, doc, start, stop in zip(*[b.column(c).to_pylist() for c in suffix._C[0]], strict=True):
            if key is None:
                got |= {(doc, at) for at in range(start, stop + 1)}
            else:
                later.append((key, doc, start))
                least[key] = min(least.get(key, (doc, start)), (doc, start))
    assert (gathered == 4096) == (len({d for _, d, _ in later}) == 9)
    got |= {(d, s) for k, d, s in later if least[k] != (d, s)}
    assert got == want


def test_longest_previous_factor():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 700, dtype=np.uint8)
    text[300:520] = text[20:240]
    starts = np.arange(len(text) - suffix.LENGTH + 1)
    got = suffix.longest_previous_factor(text, starts)
    data = text.tobytes()
    for i in starts:
        best = 0
        for j in range(i):
            k = best
            while k < suffix.LENGTH and data[j : j + k + 1] == data[i : i + k + 1]:
                k += 1
            best = max(best, k)
        assert got[i] == best


def test_simhash(spark, docs, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    want = {r[0]: fp(r[1]) for r in rows()}
    comp = {i: i for i in want}
    changed = True
    while changed:
        changed = False
        for a in want:
            for b in want:
                if bin(want[a] ^ want[b]).count("1") <= 3 and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    got = simhash.groups(docs, Workspace(spark, "t")).collect()
    assert {r.doc_id: (int.from_bytes(r.fp, "big"), r.component_id) for r in got} == {i: (want[i], comp[i]) for i in want}
    assert simhash.groups(empty, Workspace(spark, "t")).collect() == []


def test_simhash_null_and_repeated_ids(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    fp = lambda w: simhash.fingerprint(simhash.shingle_hashes(" ".join(w).encode(), 3))
    apart = lambda a, b: bin(int.from_bytes(fp(a), "big") ^ int.from_bytes(fp(b), "big")).count("1")
    chain = [base]
    while len(chain) < 3:  # each near the one before, the third not near the first
        new = list(chain[-1])
        for _ in range(12):
            new[rng.randrange(400)] = "changed"
        if 0 < apart(new, chain[-1]) <= 3 and (len(chain) < 2 or apart(new, base) > 3):
            chain.append(new)
    far = [[f"v{rng.randint(0, 10**6)}" for _ in range(50)] for _ in range(3)]
    data = [(9, chain[0]), (None, chain[1]), (5, chain[2]), (None, far[0]), (None, far[0]), (20, far[1]), (20, far[2]), (20, far[2])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in data], "doc_id long, text string").repartition(3)
    got = simhash.groups(docs, Workspace(spark, "t")).collect()
    want = [(9, fp(chain[0]), 5), (None, fp(chain[1]), 5), (5, fp(chain[2]), 5), *[(None, fp(far[0]), None)] * 2, (20, fp(far[1]), 20), *[(20, fp(far[2]), 20)] * 2]
    assert sorted(map(repr, ((r.doc_id, bytes(r.fp), r.component_id) for r in got))) == sorted(map(repr, want))


def test_simhash_crowded_keys(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fps = {int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (700, 2))}
    fps |= {int(x) for x in rng.integers(0, 2**63, 500, dtype=np.uint64)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "big"))) for i, x in enumerate(fps)], "node long, fp binary")
    edges = simhash.links(nodes, Workspace(spark, "t"), 3, simhash.BlockKeys()).collect()
    m = np.array(fps, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    pairs = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(simhash.hamming(m[i], m[i + 1 :]) <= 3) + i + 1]
    want = simhash._union(len(fps), *(np.array(x) for x in zip(*pairs)))
    have = simhash._union(len(fps), np.array([e.a for e in edges]), np.array([e.b for e in edges]))
    assert (want == have).all()


def near_groups(items):
    """Least place of each component of similarity 0.8 or more, all pairs compared; items: texts."""
    sets = []
    for t in items:
        w = words((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(items)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            x, n, m = len(sets[i] & sets[j]), len(sets[i]), len(sets[j])
            if 5 * x >= 4 * (n + m - x):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def similar_texts():
    rng = random.Random(8)

    def make(n):
        return [f"w{rng.randint(0, 10**9)}" for _ in range(n)]

    def changed(base, share):
        return [f"x{rng.random()}" if rng.random() < share else w for w in base]

    common, out = make(120), []
    for n in (6, 8, 12, 25, 60, 300):  # pairs about the limit, short ones too
        for _ in range(25):
            base = make(n)
            out += [base, changed(base, rng.choice((0.01, 0.02, 0.03)))]
            out.append(base[: rng.randint(n // 2, n)])
    template = make(200)
    out += [changed(template, rng.choice((0.005, 0.012, 0.03))) for _ in range(150)]
    out += [common + make(rng.randint(10, 60)) for _ in range(60)]
    out += [make(4) for _ in range(5)] + [["one"], ["one"], ["One"], ["two", "one"]]
    out = [" ".join(x) for x in out]
    return out + ["", None, " \n", out[0].upper(), out[0], out[5].replace(" ", "  ")]


@pytest.mark.parametrize("block,shingles,most", [(4096, 1 << 21, 64), (20, 1 << 21, 64), (4096, 5000, 64), (10, 3000, 0)])
def test_similar_equals_brute_force(spark, monkeypatch, block, shingles, most):
    """Whole groups, groups dealt into blocks by rows and by shingles, and groups met by key."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(simhash, "MAX_BLOCKS", most)
    texts = similar_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(5)
    got = {r._row: r.component for r in simhash.similar(docs, Workspace(spark, "t")).collect()}
    assert [got[i] for i in range(len(texts))] == near_groups(texts)
    if most:
        assert simhash.similar(docs.limit(0), Workspace(spark, "t")).collect() == []


def test_near_stage_null_and_repeated_ids(spark):
    import corpus_pipeline as C

    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    near = " ".join(base[:100] + ["other"] + base[101:])
    base = " ".join(base)
    alone = [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(50)) for _ in range(4)]
    data = [(None, base), (7, near), (9, base), (3, alone[0]), (3, alone[1]), (3, alone[1]), (None, alone[2]), (None, alone[3]), (None, alone[3]), (4, None), (5, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = C.drop_near_duplicates(spark, docs, "").collect()
    want = [(7, near), (3, alone[0]), (3, alone[1]), (None, alone[2]), (None, alone[3]), (4, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_mixing(spark, docs, empty):
    def run(d):
        m = mixing.mix(d.select("doc_id", "source", "text"), Workspace(spark, "t"), docs_per_block=3, words_per_shard=700)
        return {r.doc_id: (r.size, r.source_size, r.target, sum(x.words for x in r.draws), tuple(r.draws), r.source_size) for r in m.collect()}

    got = run(docs)
    size = {r[0]: len(words(r[1])) for r in rows()}
    source = {r[0]: r[3] for r in rows()}
    total = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    names = sorted([s for s in total if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(total.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.discard(s)
    for i, (n, whole, t, taken, _, _) in got.items():
        assert n == size[i] and whole == total[source[i]] and math.isclose(t, target[source[i]]) and taken <= 2 * n
    for s in names:
        assert abs(sum(v[3] for i, v in got.items() if source[i] == s) - target[s]) <= 0.51
    assert run(docs.repartition(7)) == got
    assert len({d.shard for v in got.values() for d in v[4]}) > 1
    assert run(empty) == {}


def test_mix_does_not_depend_on_broadcasts(spark, docs, monkeypatch):
    def drawn():
        found = mixing.mix(docs.select("doc_id", "source", "text"), Workspace(spark, "t"), docs_per_block=4, words_per_shard=500)
        return sorted((r.doc_id, r.size, r.target, tuple(map(tuple, r.draws))) for r in found.collect())

    small = drawn()
    monkeypatch.setattr("millrace.llm.common.SMALL_CHARS", 0)
    assert drawn() == small


def test_mixed_documents_keep_words(spark, docs):
    sp = Workspace(spark, "t")
    out = mixing.mixed_documents(docs, sp, docs_per_block=3, words_per_shard=700)
    assert out.columns == docs.columns
    size = {r[0]: r[1] for r in rows()}
    for r in out.collect():
        assert size[r.doc_id].startswith(r.text) and words(r.text)


def test_splitting_tree_is_exact(spark):
    q = spark.sql("select array(1000L, 3L, 500L, 0L, 77L) as counts")
    got = mixing.split_quotas(q, 8, 5).collect()
    assert [sum(r.quota for r in got if r.source_no == s) for s in range(5)] == [1000, 3, 500, 0, 77]
    assert {sum(r.quota for r in got if r.shard == k) for k in range(8)} <= {197, 198}
    one = [mixing.split_quotas(spark.sql("select array(10L, 6L) as counts"), 2, s).where("shard = 0 and source_no = 0").first().quota for s in range(30)]
    assert 4 < np.mean(one) < 6 and len(set(one)) > 2


@pytest.mark.parametrize("block", [1 << 20, 256])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(0, 0.1, 16)]) for i in range(300)]
    data[7] = (7, None)
    data[50] = (50, [float("nan")] * 16)
    data[60] = (60, data[61][1])
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, Workspace(spark, "t")).orderBy("query_id", "rank").collect()]
    v = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in data if x and np.isfinite(x).all()}
    want = []
    for q in sorted(i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), Workspace(spark, "t")).collect() == []


def test_top_k_repeated_rows_short_vectors_and_extra_columns(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0]), (1, [2.0]), (2, []), (None, [9.0, 9.0]), (3, [None, 1.0]), (4, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, query_id string, score int")
    got = [tuple(r) for r in topk.top_k(df, Workspace(spark, "t")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 2, 0), (0, 4, 4, 0)]
    assert topk.top_k(df.where("vec_id = 1"), Workspace(spark, "t")).count() == 0


def test_search_shard_equals_brute_force():
    rng = np.random.default_rng(3)
    for n, dims, spread in ((1, 3, 40), (3, 4, 40), (700, 8, 6), (2000, 32, 500), (400, 16, 1 << 27)):
        vectors = rng.integers(-spread, spread + 1, (n, dims)) + (spread // 4)
        ids = rng.permutation(n * 2)[:n].astype(np.int64)
        ids[n // 2 :] = ids[: n - n // 2]  # repeated ids
        asked = np.unique(ids)[:12]
        queries = np.stack([vectors[np.flatnonzero(ids == a)[0]] for a in asked])
        best = topk.Best(asked, 5)
        for at in range(0, n, 300):
            topk.search_shard(ids[at : at + 300], vectors[at : at + 300], queries, best)
        got = list(zip(*[c.tolist() for c in best.rows()], strict=True))
        want = []
        for a, q in zip(asked.tolist(), queries, strict=True):
            found = sorted((-int(q @ v), i) for i, v in zip(ids.tolist(), vectors, strict=True) if i != a)[:5]
            want += [(a, i, -s) for s, i in found]
        assert got == want


def test_sentencepiece(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in viterbi.encode(docs, path, keep_ids=True).collect()}
    model = viterbi.Model.load(path)
    assert all(r.round_trip for r in got.values())
    for r in rows():
        ids = np.array(got[r[0]].piece_ids, np.int64)
        assert viterbi.decode(model, ids).decode() == (r[1] or "") and got[r[0]].n_pieces == len(ids)
    score = {p: s for size, (_, _, ids, ss) in model.tables.items() for i, s in zip(ids, ss) for p in [model.pieces[i]]}
    for word in ("abcdefgh", "unbelievable", "naïveté", "日本語x", "x\ny"):
        unit = viterbi.MARK + word
        best = [0.0] + [-1e18] * len(unit)
        for j in range(1, len(unit) + 1):
            for i in range(max(0, j - 16), j):
                s = score.get(unit[i:j], model.unknown if j - i == 1 else None)
                if s is not None:
                    best[j] = max(best[j], best[i] + s)
        pieces = viterbi.segment(model, np.frombuffer(unit.encode("utf-32-le"), np.uint32).reshape(1, -1))[0]
        cost = sum(score[model.pieces[i]] for i in pieces if i not in model.bytes_at)
        cost += model.unknown * sum(1 for c in unit if c not in score)
        assert math.isclose(cost, best[-1])
    assert viterbi.encode(empty, path).collect() == []


def test_sentencepiece_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), viterbi.Encoder(viterbi.Model.load(path))
    rng = random.Random(4)
    bits = ["the", "un", "believ", "able", "a", "B", "é", " ", " ", "   ", "\n", "\t", "<", "</", "p>", "<!--", "<=", "日本", "語", "'s", "23", "😀", "\u3000", "<s>", "<0x0A>", viterbi.MARK]
    texts = ["the a<b and x</p>", "a<b", "x</p>", " <", "naïveté", ""] + ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(rng.choices("abcdethé<日\n", k=n)) for n in (100, 127, 128, 129, 130, 1000, 3000)]
    want = library.encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)] == want


def test_every_ordinary_piece_is_in_the_tables():
    P = pytest.importorskip("public_tokenizers")
    model = viterbi.Model.load(P.path("piece_bpe_32k.model"))
    code = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32).reshape(1, -1)
    for word, piece in (("a<b", "<"), ("x</p>", "</")):
        assert model.pieces.index(piece) in viterbi.segment(model, code(word))[0]


def covered_words(texts):
    """Words of each text in passages shared with any earlier one: all pairs, all common k-mers."""
    w = [packed.word_hashes((t or "").encode()) for t in texts]
    index, cover, whole = {}, [np.zeros(len(x), bool) for x in w], set()
    for i, x in enumerate(w):
        if len(x) >= chaining.MIN_WORDS and x.tobytes() in whole:
            cover[i][:] = True
        whole.add(x.tobytes())
        kmers = packed.kmer_hashes(x, chaining.K).tolist() if len(x) >= chaining.K else []
        matches = {}
        for at, h in enumerate(kmers):
            for j, y in index.get(h, ()):
                matches.setdefault(j, []).append((at, y))
        for j, m in matches.items():
            m = np.array(m)
            for own in chaining.chains(m[:, 0], m[:, 1]):
                x0, x1, y0, y1, equal = chaining.align(x, w[j], m[own, 0], m[own, 1])
                if x1 - x0 >= chaining.MIN_WORDS and equal >= chaining.IDENTITY * max(x1 - x0, y1 - y0):
                    cover[i][x0:x1] = True
        for at, h in enumerate(kmers):
            index.setdefault(h, []).append((i, at))
    return cover


def passage_texts():
    rng = random.Random(1)
    make = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    changed = lambda b, share: [f"x{rng.random()}" if rng.random() < share else w for w in b]
    p, lines, fuzzy = make(200), [make(35), make(35)], make(150)
    out = [make(30) + p[i : i + 20] + make(30) for i in range(180)]  # pieces too short to count
    out += [make(20) + x + make(20) for x in lines] + [make(30) + fuzzy[i : i + 20] + make(10) for i in range(0, 130, 5)]
    out += [make(50) + p + make(50) for _ in range(8)] + [make(50) + lines[0] + lines[1] + make(50) for _ in range(6)]
    out += [make(20) + changed(fuzzy, 0.06) + make(20) for _ in range(6)]
    for share in (0.05, 0.1, 0.15):
        for n in (45, 60, 100):
            for _ in range(4):
                q = make(n)
                out += [make(60) + q + make(60), make(60) + changed(q, share) + make(60)]
    return [" ".join(x) for x in out]


def test_passages_against_all_pairs(spark):
    texts = passage_texts()
    want = covered_words(texts)
    got = [np.zeros(len(x), bool) for x in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in chaining.passages(docs, Workspace(spark, "t")).collect():
        assert r.other_doc_id < r.doc_id and r.n_equal >= 0.8 * max(r.end_word - r.start_word, r.other_end - r.other_start)
        got[r.doc_id][r.start_word : r.end_word] = True
    assert not any((g & ~w).any() for g, w in zip(got, want))
    held = [i for i, w in enumerate(want) if w.any()]
    assert np.mean([(got[i] & want[i]).any() for i in held]) > 0.98
    assert sum(int((g & w).sum()) for g, w in zip(got, want)) > 0.98 * sum(int(w.sum()) for w in want)
    assert all(got[i].any() for i in range(209, 216)) and all(got[i].any() for i in range(217, 222))  # those that share p, and both lines


def test_passages_of_every_two_documents(spark):
    rng = random.Random(9)
    make = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    texts, want = [], set()
    for _ in range(12):  # all but the whole of p stands in earlier documents, in runs too short to count
        p = make(42)
        texts += [make(30) + p[i : i + 39] + make(30) for i in range(4)]
        texts += [make(30) + p + make(30) for _ in range(3)]
        n = len(texts)
        want |= {(n - 1, n - 2), (n - 1, n - 3), (n - 2, n - 3)}
    line, common = make(14), make(60)
    variant = [w if i % 20 else "other" for i, w in enumerate(common)]
    texts += [make(20) + line + make(20) for _ in range(60)]
    first = len(texts)
    texts += [make(20) + common + make(20) + line for _ in range(50)] + [make(20) + variant + make(9) + line for _ in range(50)]
    a, b = make(26), make(26)
    texts += [make(20) + x + line + y + make(20) for x, y in ((a, b), (a, make(26)), (make(26), b), (a, b))]
    got = chaining.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3), Workspace(spark, "t")).collect()
    pairs = {(r.doc_id, r.other_doc_id) for r in got}
    assert want <= pairs
    n = len(texts)
    assert {(n - 1, n - 4), (n - 3, n - 4), (n - 1, n - 3), (n - 2, n - 4), (n - 1, n - 2)} <= pairs and (n - 2, n - 3) not in pairs
    near = lambda i: {j for j in range(first, i) if (i, j) in pairs} | {i}
    assert all(near(i) & near(j) for i in range(first, first + 100) for j in range(first, i))  # linked, or to one and the same
    assert not {r.doc_id for r in got} & set(range(first - 60, first))


def test_links_of_frequent_seeds_grow_with_their_rows():
    rng = np.random.default_rng(4)
    n, width = 300, chaining.K + 2 * chaining.SIDE
    near = np.where(rng.random((n, width)) < 0.07, rng.integers(1, 255, (n, width)), rng.integers(1, 255, width)).astype(np.uint8)
    near[:, chaining.SIDE : chaining.SIDE + chaining.K] = [1, 2, 3, 4, 5]
    near[::7, chaining.SIDE + chaining.K + 6 :] = 0  # texts that end soon after the seed
    later, earlier = chaining._links(np.zeros(n, np.uint64), np.arange(n), near)
    assert (later > earlier).all() and len(later) < 10 * n
    partners = [{i} for i in range(n)]
    for i, j in zip(later.tolist(), earlier.tolist()):
        partners[i].add(j)
        partners[j].add(i)
    for i in range(n):  # every two that make a passage are linked, or to one and the same
        for j in np.flatnonzero(chaining._makes_passage((near[i] == near) & (near != 0))).tolist():
            assert partners[i] & partners[j]


def test_seeds_of_repeated_words_are_few():
    line = packed.word_hashes(b"is on " * 200)
    at, _ = chaining.seeds(line)
    assert 2 <= len(at) < 40 and at[0] < chaining.WINDOW and at[-1] >= len(line) - chaining.K - chaining.WINDOW


def test_passages(spark, docs, empty):
    got = chaining.passages(docs, Workspace(spark, "t")).collect()
    pairs = {(r.doc_id, r.other_doc_id): r for r in got}
    assert pairs[44, 43].n_equal == 3000
    assert pairs[46, 45].end_word - pairs[46, 45].start_word >= 68
    found = pairs.get((47, 45)) or pairs[47, 46]  # either holds it
    assert found.end_word - found.start_word >= 68 and found.n_equal < 70
    assert all(r.doc_id > r.other_doc_id for r in got)
    assert not {r.doc_id for r in got} & set(range(40))
    assert chaining.passages(empty, Workspace(spark, "t")).collect() == []


def test_passages_null_and_repeated_ids_and_long_texts(spark):
    rng = random.Random(2)
    make = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    p, q, long = make(100), make(50), make(200_000)
    data = [(None, make(10) + " " + p), (None, None), (3, make(20) + " " + p + " " + make(5)), (5, q + " " + make(9)), (5, make(700) + " " + q), (7, q), (7, q), (8, long), (9, long + " end"), (9, "short")]
    got = chaining.passages(spark.createDataFrame(data, "doc_id long, text string").repartition(3), Workspace(spark, "t")).collect()
    size = {3: {125}, 5: {59, 750}, 7: {50}, 9: {200_001}}
    assert {(r.doc_id, r.other_doc_id) for r in got} >= {(3, None), (5, 5), (9, 8)} and {r.doc_id for r in got} == {3, 5, 7, 9}
    assert all(r.end_word <= max(size[r.doc_id]) for r in got)
    by = {(r.doc_id, r.other_doc_id): r for r in got}
    assert (by[3, None].start_word, by[3, None].end_word, by[3, None].n_equal) == (20, 120, 100)
    assert by[7, 7].n_equal == 50 and by[9, 8].n_equal == 200_000


def test_chains():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x, y = rng.integers(0, 200, (2, 25))
        got = chaining.chains(x, y)
        for own in got:
            assert (np.diff(x[own]) > 0).all() and (np.diff(y[own]) > 0).all()
            assert (np.diff(x[own]) <= chaining.MAX_GAP).all() and (np.diff(y[own]) <= chaining.MAX_GAP).all()
        assert sorted(i for own in got for i in own) == list(range(25))


def toxic_rows():
    rng = random.Random(3)
    plain, bad = [f"w{'abcdefghij'[i // 30]}{'abcdefghij'[i // 3 % 10]}{'xyz'[i % 3]}" for i in range(300)], ["awful", "nasty", "vile", "horrid"]
    label = [i % 4 == 0 for i in range(400)]
    return [(i, " ".join(rng.choices(plain, k=60) + (rng.sample(bad, rng.randint(2, 4)) if x else [])), int(x)) for i, x in enumerate(label)]


def test_toxicity(spark, docs, empty):
    data = toxic_rows()
    held = spark.createDataFrame(data, "doc_id long, text string, toxic int").repartition(3)
    labels = held.where("doc_id < 250").select("doc_id", "toxic")
    odd = spark.createDataFrame([(None, 1), (300, None), (0, 0), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(held.select("doc_id", "text"), labels.union(odd), Workspace(spark, "t"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade(held, model).collect()}
    assert np.mean([got[i].toxic == bool(x) for i, _, x in data[250:]]) > 0.97
    # whole texts, plain Python
    weights = dict(zip(model.names.tolist(), model.weights.tolist()))
    for i, t, _ in data[:50]:
        score = sum(weights.get(xxhash.xxh64_intdigest(w) >> 1, 0.0) for w in set(t.split()))
        want = sum(1 / (1 + math.exp(c - score)) for c in model.thresholds)
        assert math.isclose(got[i].expected_severity, want, abs_tol=1e-9) and got[i].grade == round(want)
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    assert len(got) == len(rows()) and not got[41].toxic and got[40].expected_severity == got[41].expected_severity
    assert toxicity.grade(empty, model).collect() == []
    for d, x in ((held, labels.limit(0)), (empty, labels)):
        none = toxicity.grade(held, toxicity.train(d, x, Workspace(spark, "t"))).collect()
        assert len(none) == 400 and all(r.expected_severity < 1e-6 and r.grade == 0 and not r.toxic for r in none)
    long = spark.createDataFrame([(None, "plain " * 300_000 + "vile nasty awful horrid"), (None, "plain")], "doc_id long, text string")
    assert [r.toxic for r in toxicity.grade(long.coalesce(1), model).collect()] == [True, False]


def test_toxicity_gradient():
    rng = np.random.default_rng(4)
    n, p = 40, 6
    held = rng.random((n, p)) < 0.4
    row, col = np.nonzero(held)
    y, theta = rng.integers(0, 4, n), rng.normal(0, 0.5, p + 3)
    _, grad = toxicity.loss(theta, row, col, y, p, 0.01)
    for i in range(len(theta)):
        step = np.eye(len(theta))[i] * 1e-5
        slope = (toxicity.loss(theta + step, row, col, y, p, 0.01)[0] - toxicity.loss(theta - step, row, col, y, p, 0.01)[0]) / 2e-5
        assert math.isclose(slope, grad[i], rel_tol=1e-4, abs_tol=1e-7)


def test_token_ids(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    space, start, want = Workspace(spark, "t"), 0, {}
    for r in rows():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[r[0]] = (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    one = docs.coalesce(1)  # in order, in runs that follow or overlap each other, in many runs
    orders = [("doc_id",), (F.col("doc_id") < 30, "doc_id"), (F.col("doc_id") % 3, "doc_id"), (F.desc("doc_id"),)]
    for d in (docs, docs.orderBy("doc_id"), *[one.sortWithinPartitions(*o) for o in orders]):
        out = tokenbin.read_ids(spark, space, tokenbin.write_ids(d, space, path), keep_ids=True)
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in out.collect()} == want
    assert tokenbin.read_ids(spark, space, tokenbin.write_ids(empty, space, path)).collect() == []


def test_piece_tokenizer_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = tokenbin.PieceTokenizer(f.read())
    rng = random.Random(1)
    bits = ["a", "B", "é", "  ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u3000", "\r\n", ".", ",", "23", "'s", "日本", "a.", "x.\ny", ""]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)] + [None, "", " ", "  ", "\n"]
    for at in range(0, len(texts), 500):  # later slices meet pieces that are known by then
        part = texts[at : at + 500]
        ids, n = own.encode(pa.array(part, pa.string()))
        want = [e.ids for e in own.t.encode_batch([x or "" for x in part], add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 700])
def test_huffman(n):
    rng = np.random.default_rng(n)
    counts = (1.6 ** rng.integers(0, 30, n)).astype(np.int64)
    lengths = tokenbin.code_lengths(counts, 12)
    assert lengths.max() <= 12 and sum(2.0 ** -float(x) for x in lengths) <= 1
    ids = rng.integers(0, n, 5000)
    bits, offsets = tokenbin.encode_block(ids, lengths, tokenbin.canonical_codes(lengths))
    assert (tokenbin.Decoder(lengths).decode(bits, offsets, len(ids)) == ids).all()


def test_quality_base(spark, docs, empty):
    got = {r.doc_id: r for r in quality.base_features(docs).collect()}
    for r in rows():
        t, w = r[1] or "", words(r[1])
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {x for x in runs if runs.count(x) > 1}
        cover = {j for i, x in enumerate(runs) if x in twice for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        g = got[r[0]]
        assert (g.n_words, g.n_repeat_words, g.n_dup_lines) == (len(w), len(cover), len(lines) - len(set(lines)))
        assert g.word_chars == sum(len(x.decode()) for x in w) and g.n_symbols == sum(c in quality.SYMBOLS for c in t)
    assert quality.base_features(empty).collect() == []


def test_risk_control(spark):
    for n, k, a in ((100, 2, 0.05), (1000, 30, 0.05), (5000, 10, 0.005), (50, 0, 0.1), (20000, 900, 0.05)):
        got = spark.range(1).select(quality.binomial_cdf(F.lit(n).cast("double"), F.lit(k).cast("double"), a)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log(1 - a)) for i in range(k + 1))
        assert math.isclose(got, want, rel_tol=1e-6)
    good = [(i, "one two three four five six seven eight nine ten " * 1 + " ".join(f"w{j}" for j in range(30)), "en") for i in range(3000)]
    bad = [(i, " ".join(f"W{j}&&&".upper() for j in range(40)), "en") for i in range(3000, 3100)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = d.selectExpr("doc_id", "int(doc_id < 3000) as quality", "0 as toxic")
    f = quality.base_features(d).cache()
    kept = {r.doc_id for r in quality.judge(f, quality.thresholds(f, labels)).where("kept").collect()}
    assert kept == set(range(3000))
    none = quality.judge(f, quality.thresholds(f, labels.where("doc_id < 20"))).where("kept").count()
    assert none == 3100


def test_licenses(spark, docs):
    filler = " ".join(f"w{i}" for i in range(500))
    mit = licenses.TEMPLATES["MIT"][2]
    changed = mit.replace("obtaining", "getting").replace("limitation", "limits")
    more = spark.createDataFrame([(1, f"{filler} {changed} {filler}"), (2, "released under the MIT license"), (3, filler), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.license, r.template): r for r in licenses.scan(more).collect()}
    assert set(got) == {(1, "MIT", 2), (2, "MIT", 0)}
    assert abs(got[1, "MIT", 2].first_word - 500) <= 2 and 0.8 <= got[1, "MIT", 2].containment < 1
    assert licenses.scan(docs).collect() == []


def test_pipeline_stages(spark, docs, empty):
    """Stage by stage against plain Python: what goes, what stays, names that clash."""
    import corpus_pipeline as C

    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    import tempfile

    folder = tempfile.mkdtemp()
    labels.write.parquet(f"{folder}/labels.parquet")
    first = C.keep_quality(spark, docs, folder)
    kept = {r.doc_id for r in first.collect()}
    for r in rows():
        w = words(r[1])
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        cover = {j for i, x in enumerate(runs) if runs.count(x) > 1 for j in range(i, i + 8)}
        assert (r[0] in kept) == (len(w) >= 20 and 100 * len(cover) <= 30 * len(w))
    second = C.drop_near_duplicates(spark, first, folder)
    ids = {r.doc_id for r in second.collect()}
    assert 43 in ids and 44 not in ids and ids <= kept
    third = C.drop_repeated_passages(spark, docs, folder)
    after = {r.doc_id: r.text for r in third.collect()}
    assert 44 not in after and after[45] == rows()[45][1] and len(after[46]) < 120
    assert first.columns == second.columns == third.columns == docs.columns
    for stage in (C.keep_quality, C.drop_near_duplicates, C.drop_repeated_passages, C.mix_sources):
        assert stage(spark, empty, folder).collect() == []
