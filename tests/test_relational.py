"""Ranks and first rows against plain Python, on nulls, ties, empty keys and empty tables."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators import relational as R


def test_keep_first(spark):
    rows = [(3, "a"), (1, "a"), (2, ""), (4, ""), (5, None), (6, None), (7, "b")]
    df = spark.createDataFrame(rows, "pos long, k string")
    assert sorted(r.pos for r in R.keep_first(df, "k", "pos").collect()) == [1, 2, 4, 5, 7]
    assert sorted(r.pos for r in R.keep_first(df, "k", "pos", empty_repeats=False).collect()) == [1, 2, 5, 7]
    assert R.keep_first(df.where("false"), "k", "pos").columns == ["pos", "k"]


@pytest.mark.parametrize("digits", [1, 4])
def test_stratified_rank(spark, monkeypatch, digits):
    monkeypatch.setattr(R, "HASH_DIGITS", digits)
    rows = [(i, [None, "x", "y"][i % 3], "extra") for i in range(400)] + [(5, "x", "again")]
    df = spark.createDataFrame(rows, "id long, s string, _n string")
    want, seen = defaultdict(list), defaultdict(list)
    for i, s, _ in rows:
        want[s].append((hashlib.md5(f"{i}|42".encode()).hexdigest(), i))
    for r in R.stratified_rank(df, "s", "id").collect():
        seen[r.s].append((r["rank"], r.id))
    assert {s: [i for _, i in sorted(v)] for s, v in seen.items()} == {s: [i for _, i in sorted(v)] for s, v in want.items()}
    assert all(sorted(n for n, _ in v) == list(range(1, len(v) + 1)) for v in seen.values())
    assert R.stratified_rank(df.where("false"), "s", "id").count() == 0


def test_nested_splits(spark):
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("s"))
    spec = spark.createDataFrame([("small", "x", 10), ("large", "x", 40), ("large", "y", 400)], "split string, s string, n int")
    got = defaultdict(set)
    for r in R.nested_splits(df, "s", "id", spec).collect():
        got[r.split, r.s].add(r.id)
    assert {k: len(v) for k, v in got.items()} == {("small", "x"): 10, ("large", "x"): 40, ("large", "y"): 150}
    assert got["small", "x"] < got["large", "x"]


@pytest.mark.parametrize("buckets", [2, 256])
def test_average_rank(spark, buckets):
    values = [4.0, 1.0, 4.0, None, -2.5, 1.0, 1.0, 9.0] + [float(i * 37 % 101) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    known = sorted(v for v in values if v is not None)
    got = {r.id: r["rank"] for r in M.with_average_rank(df, "v", "rank", buckets).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        below, same = sum(x < v for x in known) if v is not None else 0, known.count(v)
        assert got[i] == (None if v is None else below + (same + 1) / 2)
    assert M.with_average_rank(df.where("false"), "v", "rank").count() == 0
    assert {r["rank"] for r in M.with_average_rank(df.where("v is null"), "v", "rank").collect()} == {None}
