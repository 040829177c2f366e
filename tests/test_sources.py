"""Readers, sinks, streaming state, model calls and grids on files written here."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import calls, evaluate, grid
from millrace.plans import benchmark
from millrace.sources import files
from millrace.streaming import resume

LINE = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])


def test_text_documents(spark, tmp_path):
    for kind, names in (("起诉", ["b", "a[2024]"]), ("不起诉", ["c", "d", "e"])):
        (tmp_path / kind).mkdir()
        for n in names:
            (tmp_path / kind / f"{n}.txt").write_text(f"{n}\nx", encoding="utf-8")
    assert files.text_documents(spark, str(tmp_path)).count() == 5
    got = files.text_documents(spark, str(tmp_path), ("不起诉", "起诉"), 2).orderBy("pos").collect()
    assert [(r.doc_type, r.case_id, r.text) for r in got] == [("不起诉", "c", "c\nx"), ("不起诉", "d", "d\nx"), ("起诉", "a[2024]", "a[2024]\nx"), ("起诉", "b", "b\nx")]


def test_json_lines_checkpoints_and_arrays(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "v": 1}\n\n{bad\n{"id": "a", "v": 2}\n{"id": "b", "v": 3}\n{"v": 4}\n')
    assert [tuple(r) for r in files.json_lines(spark, str(p), LINE, index=True).orderBy("line").collect()] == [(0, "a", 1), (3, "a", 2), (4, "b", 3), (5, None, 4)]
    assert files.json_lines(spark, str(p), LINE).count() == 4
    assert [r.line for r in files.first_matching(files.json_lines(spark, str(p), LINE, index=True), F.col("v") > 1, 2).collect()] == [3, 4]
    assert {tuple(r) for r in files.checkpoint(spark, str(p), LINE, "id").collect()} == {("a", 2), ("b", 3)}
    a = tmp_path / "records.json"
    a.write_text(json.dumps([{"id": "k", "meta": {"date": "2020-01-01"}}, {"id": "l", "relevant_articles": ["cl:x"]}, 5, "x"]))
    got = {r.id: r for r in files.case_records(spark, str(a), coerce=True).where("id <> ''").collect()}
    assert got["k"].meta.province == "" and got["k"].relevant_articles == [] and got["l"].relevant_articles == ["cl:x"]
    assert files.skipped_records(spark, str(a)) == 2


def test_details_csv_and_markdown(spark, tmp_path):
    d = tmp_path / "details"
    d.mkdir()
    (d / "details_a.json").write_text('[{"sample_index": 3, "run_id": 1}, {"index": 9}]')
    (d / "details_b.json").write_text('[{"sample_index": 3, "run_id": 0}, {"id": "z"}]')
    (d / "other.json").write_text('[{"index": 1}]')
    got = files.details(spark, str(d), T._parse_datatype_string("index long, sample_index long, run_id long, id string")).orderBy("order_key").collect()
    assert [(r["index"], r.sample_index, r.run_id, r.id) for r in got] == [(9, None, None, None), (None, 3, 0, None), (None, 3, 1, None), (None, None, None, "z")]
    c = tmp_path / "w.csv"
    c.write_bytes("﻿step,a,b\n1,0.5,\n,9,9\n2,1.5,2\n".encode())
    rows = {(r.step, r.series): r.value for r in files.wide_csv(spark, str(c), "step", ["a", "b"]).collect()}
    assert rows[1, "a"] == 0.5 and math.isnan(rows[1, "b"]) and rows[2, "b"] == 2 and len(rows) == 4
    with pytest.raises(ValueError, match="columns missing: q"):
        files.wide_csv(spark, str(c), "step", ["q"])
    e = benchmark.entries(spark, "/root/testdata/sf0.001")
    m = tmp_path / "metrics.md"
    m.write_text(evaluate.report(e, "m", "original"), encoding="utf-8")
    read = {r.label: r for r in files.markdown_table(spark, str(m), "Level2", ["precision", "recall", "f1", "count"]).collect()}
    want = {r.label: r for r in evaluate.classes(e, 2).collect()}
    assert set(read) == set(want)
    assert all(math.isclose(read[k].f1, want[k].f1, abs_tol=5.1e-5) and read[k]["count"] == want[k].support for k in want)
    assert "稳定性汇总" in m.read_text(encoding="utf-8") and "稳定性汇总" not in evaluate.report(e.drop("run_id"), "m", "v")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], "p/q"), ("b", [], "正确")], "id string, warnings array<string>, outcome string")
    files.write_json_array(df, str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text(encoding="utf-8"))[1]["outcome"] == "正确"
    with pytest.raises(ValueError):
        files.write_json_array(df, str(tmp_path / "b.json"), most=1)
    files.write_rejects(df, str(tmp_path / "rejects"))
    assert {(r.id, r.reason) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()} == {("a", "x"), ("a", "y")}
    files.write_by_outcome(df, str(tmp_path / "groups"))
    assert (tmp_path / "groups" / "group=p_q").is_dir()
    for _ in range(2):
        files.append_lines(df.select("id"), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    files.write_splits(df.withColumn("split", F.lit("test")), str(tmp_path / "splits"))
    assert files.named_split(spark, [str(tmp_path / "none"), str(tmp_path / "splits")], "test").count() == 2


def test_upsert_and_resolution(spark, tmp_path):
    path = str(tmp_path / "state")
    run = resume.upsert(path, "k", "pos", "done", buckets=4)
    schema = "k string, pos long, v string, done boolean"
    batches = [[("a", 1, "x", False), ("b", 1, "y", False), ("a", 2, "z", False)], [("b", 3, "w", True), ("c", 3, "q", False)], [("c", 4, "q", True), ("a", 5, "u", None)]]
    want = [{"a": "z", "b": "y"}, {"a": "z", "c": "q"}, {"a": "u"}]
    for epoch, (rows, state) in enumerate(zip(batches, want, strict=True)):
        for _ in range(2):  # a batch may come again
            run(spark.createDataFrame(rows, schema), epoch)
        assert {r.k: r.v for r in resume.current(spark, path, "k").collect()} == state


def test_calls(spark):
    df = spark.createDataFrame([(i, f"p{i}" if i else None) for i in range(6)], "id int, prompt string").repartition(2)

    def flaky():
        seen = {}

        def client(p):
            seen[p] = seen.get(p, 0) + 1
            if p == "p1" or p == "p2" and seen[p] < 3 or p == "p3":
                raise RuntimeError("overloaded" if p != "p3" else "refused")
            return p.upper()

        return client

    got = {r.id: r for r in calls.call(df, flaky, tries=3, wait=lambda k: 0, retry_on=("overloaded",)).collect()}
    assert {i: (r.reply, r.attempts, r.error) for i, r in got.items()} == {
        0: (None, 0, None), 1: (None, 3, "overloaded"), 2: ("P2", 3, None), 3: (None, 1, "refused"), 4: ("P4", 1, None), 5: ("P5", 1, None)}
    asked = []

    def ask(todo):
        asked.append(todo.count())
        return todo.withColumn("reply", F.when(F.col("id") % 3 < len(asked), F.col("prompt")))

    done = calls.rounds(df.where("id > 0"), "id", ask, lambda d, _: spark.createDataFrame(d.collect(), d.schema))
    assert asked == [5, 4, 2] and done.count() == 5

    def reply(d):
        return d.withColumn("reply", F.when(F.col("prompt").contains("short"), "long enough").otherwise(F.col("prompt")))

    kept = calls.repaired(df.where("id in (1, 2)"), lambda c: F.when(F.length(c) < 5, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")),
                          reply, lambda d, _: spark.createDataFrame(d.collect(), d.schema), "id").collect()
    assert {(r.id, r.reply, r["pass"]) for r in kept} == {(1, "long enough", 1), (2, "long enough", 1)}
    turns = df.where("id = 1").select(calls.messages("s", F.col("prompt"), ("q", "a")).alias("m")).select("m", calls.flat_prompt(F.col("m")).alias("f")).first()
    assert [(t.role, t.content) for t in turns.m] == [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "p1")]
    assert turns.f == "system: s\n\nuser: q\n\nassistant: a\n\nuser: p1" and calls.stub("x") == calls.stub("x")


def test_grid(spark):
    g = grid.run_grid(spark, ["a/b-1", "c"], ["0", "low", "2048"], ["original", "one_shot"], 2)
    assert g.count() == 24
    by = {(r.budget): (r.effort, r.max_tokens) for r in g.collect()}
    assert by == {"0": ("none", None), "low": ("low", None), "2048": (None, 2048)}
    assert g.where("model = 'a/b-1' and budget = 'low' and variant = 'original'").first().run_name == "a_b_1_low_original"
    samples = spark.range(3).withColumnRenamed("id", "sample_index")
    every = grid.to_run(g, samples)
    assert every.count() == 72 and grid.to_run(g, samples, every.where("run_id = 0")).count() == 36
    done = spark.createDataFrame([(0, 0, "x", 1), (0, 0, "y", 2), (1, 4, "z", 3), (1, 9, "w", 4)], "sample_index long, run_id int, result string, pos int")
    kept, todo = grid.upgraded(done, samples, 8)
    assert {tuple(r) for r in kept.collect()} == {(0, 0, "x"), (1, 4, "z")} and todo.count() == 22
    paths = spark.createDataFrame([("r/checkpoint-9",), ("r/checkpoint-10",), ("s",), ("s/checkpoint-5",)], "path string")
    assert {tuple(r) for r in grid.latest_checkpoint(paths).collect()} == {("r", "r/checkpoint-10"), ("s", "s")}
    m, v = grid.model_and_variant(F.col("x"))
    assert spark.createDataFrame([("gpt_one_shot_r8",), ("qwen",)], "x string").select(m, v).collect() == [("gpt", "one_shot"), ("qwen", "original")]
    assert grid.split_name("P-40", ["p_40", "P_40"]) == "P_40"
    with pytest.raises(KeyError):
        grid.split_name("x", ["y"])
