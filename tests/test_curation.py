"""Curation queries on rows that the test tables lack."""

import hashlib

from millrace.plans import curation


def test_balanced_sample_draws_an_id_once(spark, tmp_path):
    def place(i):
        return hashlib.md5(f"{i}|42".encode()).hexdigest(), i

    spark.range(1, 61).selectExpr("id as doc_id", "if(id % 2 = 0, 'en', 'fr') as lang", "'x' as text").write.parquet(f"{tmp_path}/documents.parquet")
    used = {i for k in (0, 1) for i in sorted((i for i in range(1, 61) if i % 2 == k), key=place)[:25]}
    labels = [(i, i % 3 % 2, 0) for i in range(1, 61)] + [(i, 1, 1) for i in range(1, 61)] + [(99, 0, 0), (99, 0, 0), (98, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    first = {}
    for i, q, t in sorted(labels, key=lambda r: r[1:]):  # an id counts once, by its least row
        first.setdefault(i, q)
    left = {q: sorted((i for i, x in first.items() if x == q and i not in used), key=place) for q in (0, 1)}
    least = min(map(len, left.values()))
    got = curation.anti_join_balanced_sample(spark, str(tmp_path)).collect()
    assert len(used) == 50 and least > 0
    assert sorted((r.quality, r["rank"], r.doc_id) for r in got) == [(q, n + 1, i) for q in (0, 1) for n, i in enumerate(left[q][:least])]


def test_keep_first_reads_whole_texts(spark, tmp_path):
    head = "one head of many characters "
    texts = [head + "a", head + "b", (head + "a").upper(), "", "", None, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in curation.dedup_keep_first(spark, str(tmp_path)).collect()) == [0, 1, 3, 4, 5]


def test_mask_covers_phones(spark, tmp_path):
    texts = {1: ("call 13812345678 or someone@example.org", "call 1********** or so***@example.org"), 2: ("nothing here", "nothing here")}
    spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.h for r in curation.mask_email_phone(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(m.encode()).hexdigest() for i, (_, m) in texts.items()}
