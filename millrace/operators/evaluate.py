"""Whole evaluation of predictions: articles as sets, decisions in four classes and in two, by run, and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import legal as L
from . import metrics as M

LEVEL2 = sorted(L.LABELS)
LEVEL1 = sorted({"不起诉", L.PROSECUTION})
#: Figures whose stability over runs is reported.
STABLE = (("Articles F1", "articles_f1"), ("Level1 Macro-F1", "level1_macro_f1"), ("Level1 Micro-F1", "level1_micro_f1"),
          ("Level2 Macro-F1", "level2_macro_f1"), ("Level2 Micro-F1", "level2_micro_f1"))


def scored(entries: DataFrame) -> DataFrame:
    """entries (ref_decision, pred_decision, ref_articles, pred_articles) with the labels they state, at both levels, and
    the scores of their articles. A label that is none of the four is null."""
    out = entries.withColumn("ref", L.normalize_label(F.col("ref_decision"))).withColumn("pred", L.normalize_label(F.col("pred_decision")))
    up = {f"{c}1": F.when(F.col(c).isNotNull(), L.to_level1(F.col(c))) for c in ("ref", "pred")}
    empty = F.array().cast("array<string>")
    return out.withColumns(up).withColumn("s", M.set_scores(F.coalesce("pred_articles", empty), F.coalesce("ref_articles", empty)))


def classes(entries: DataFrame, level: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    gold, pred, labels = ("ref", "pred", LEVEL2) if level == 2 else ("ref1", "pred1", LEVEL1)
    return M.per_class(scored(entries), labels, gold, pred, by)


def summary(entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group: n, articles_*, counts of what couldn't be parsed, accuracies and F1 of both levels.

    Articles are averaged over all rows, decisions taken over those with a valid reference; there an unparsed prediction
    is wrong.
    """
    s = scored(entries)
    valid = F.col("ref").isNotNull()

    def right(gold: str, pred: str):
        return F.avg(F.when(valid, F.col(pred).eqNullSafe(F.col(gold)).cast("double")))

    out = s.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(f"s.{k}").alias(f"articles_{name}") for k, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))],
        F.count_if(valid).alias("decision_eval_count"), F.count_if(~valid).alias("reference_parse_fail_count"),
        F.count_if(valid & F.col("pred").isNull()).alias("decision_parse_fail_count"),
        F.coalesce(right("ref", "pred"), F.lit(0.0)).alias("level2_accuracy"), F.coalesce(right("ref1", "pred1"), F.lit(0.0)).alias("level1_accuracy"))
    for level in (1, 2):
        f = M.macro_micro(classes(entries, level, by), by).select(*by, *[F.col(c).alias(f"level{level}_{c}") for c in (
            "macro_f1", "micro_precision", "micro_recall", "micro_f1")])
        out = out.join(f, list(by)) if by else out.crossJoin(f)  # one row on either side
    return out


def stability(runs: DataFrame) -> DataFrame:
    """metric, n, mean, sd, se, ci_low, ci_high over a summary by run."""
    tall = runs.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).alias("v")) for name, c in STABLE])).alias("x")).select("x.*")
    s = tall.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    s = s.withColumn("se", F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n")).otherwise(0.0))
    half = F.when(F.col("n") > 1, M.t95(F.col("n") - 1) * F.col("se")).otherwise(0.0)
    return s.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def has_runs(entries: DataFrame) -> bool:
    """Whether every entry has a run, and there are two or more."""
    r = entries.agg(F.count_if(F.col("run_id").isNull()).alias("none"), F.count_distinct("run_id").alias("n")).first()
    return r["none"] == 0 and r["n"] >= 2


def multilabel_summary(df: DataFrame, labels: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row on predictions of several labels: macro-F1 over the labels that occur as gold, micro figures over all labels
    of the space, exact matches of sets, empty predictions, predicted labels outside the space (repeats counted)."""
    space = F.array(*[F.lit(x) for x in labels])
    sets = df.select(F.array_distinct(F.array_compact(gold)).alias("g"), F.array_compact(pred).alias("raw")).withColumn("p", F.array_distinct("raw"))
    c = M.multilabel(sets, "g", "p").where(F.col("label").isin(*labels))
    c = c.withColumn("f1", M.f1(M.ratio(F.col("tp"), F.col("tp") + F.col("fp")), M.ratio(F.col("tp"), F.col("tp") + F.col("fn"))))
    f = c.agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
              *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")])
    f = f.select("macro_f1", M.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("micro_precision"),
                 M.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("micro_recall"))
    f = f.withColumn("micro_f1", M.f1(F.col("micro_precision"), F.col("micro_recall")))
    whole = sets.agg(
        F.count("*").alias("num_samples"), F.lit(len(labels)).alias("num_labels"),
        F.coalesce(F.avg((F.array_sort("g") == F.array_sort("p")).cast("double")), F.lit(0.0)).alias("exact_match"),
        F.count_if(F.size("raw") == 0).alias("parse_fail_count"),
        F.coalesce(F.sum(F.size(F.filter("raw", lambda x: ~F.array_contains(space, x)))), F.lit(0)).alias("invalid_prediction_count"))
    return whole.crossJoin(f)  # one row on either side


def _table(head: list[str], rows: list[list], align: list[str] | None = None) -> list[str]:
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    rule = align or ["---:"] * len(head)
    return ["| " + " | ".join(x) + " |" for x in (head, rule, *[[cell(v) for v in r] for r in rows])]


def report(entries: DataFrame, model: str, variant: str) -> str:
    """Markdown of an evaluation, with the figures of each run and their stability where there are several."""
    m = summary(entries).first()
    several = has_runs(entries) if "run_id" in entries.columns else False
    runs = summary(entries, ("run_id",)).orderBy("run_id").collect() if several else []
    spread = {r["metric"]: r for r in stability(entries.sparkSession.createDataFrame(runs)).collect()} if several else {}

    def with_se(name: str, value: float) -> str:
        return f"{spread[name]['mean']:.4f} ± {spread[name]['se']:.4f}" if several else f"{value:.4f} ± 0.0000"

    lines = ["# 评估指标", "", f"- model: `{model}`", f"- variant: `{variant}`", f"- num_samples: `{m['n']}`"]
    lines += [f"- {k}: `{m[k]}`" for k in ("decision_parse_fail_count", "reference_parse_fail_count", "decision_eval_count")]
    lines += ["", "## 过程指标（法条）", "", *_table(["Precision", "Recall", "F1"], [[m["articles_precision"], m["articles_recall"], m["articles_f1"]]])]
    lines += ["", "## 结果指标（决定）", "", *_table(["Metric", "F1"], [[n, with_se(n, m[c])] for n, c in STABLE[1:]], ["---", "---:"])]
    for level, title in ((1, "### Level1 各类别（起诉 / 不起诉）"), (2, "### Level2 各类别（四分类）")):
        rows = classes(entries, level).orderBy("label").collect()
        lines += ["", title, "", *_table(["类别", "Precision", "Recall", "F1", "Count"],
                                         [[r["label"], r["precision"], r["recall"], r["f1"], r["support"]] for r in rows], ["---"] + ["---:"] * 4)]
    if several:
        own = [[r["run_id"], r["n"], *[r[c] for _, c in STABLE], r["decision_parse_fail_count"]] for r in runs]
        lines += ["", "### 各 run 指标", "", *_table(["Run", "N", *[n for n, _ in STABLE], "Parse Fail"], own), "", "### 稳定性汇总", ""]
        lines += _table(["Metric", "Mean", "SD", "SE", "95% CI"], [
            [n, spread[n]["mean"], spread[n]["sd"], spread[n]["se"], f"[{spread[n]['ci_low']:.4f}, {spread[n]['ci_high']:.4f}]"] for n, _ in STABLE],
            ["---"] + ["---:"] * 3 + ["---"])
    return "\n".join([*lines, ""])


def charge_report(df: DataFrame, labels: list[str], model: str, top: int = 30) -> str:
    """Markdown of a multi-label evaluation: its summary and the labels of greatest support, ties by label."""
    m = multilabel_summary(df, labels).first()
    c = M.multilabel(df.select(F.array_distinct("gold").alias("g"), F.array_distinct("pred").alias("p")), "g", "p").where(F.col("label").isin(*labels))
    rows = c.orderBy(F.desc("support"), "label").limit(top).collect()
    lines = ["# 罪名预测指标", "", f"- model: `{model}`", *[f"- {k}: `{m[k]}`" for k in (
        "num_samples", "num_labels", "parse_fail_count", "invalid_prediction_count")]]
    lines += ["", *_table(["Macro-F1", "Micro-P", "Micro-R", "Micro-F1", "Exact"], [[m[k] for k in (
        "macro_f1", "micro_precision", "micro_recall", "micro_f1", "exact_match")]])]
    lines += ["", *_table(["Label", "TP", "FP", "FN", "Support"], [[r["label"], r["tp"], r["fp"], r["fn"], r["support"]] for r in rows], ["---"] + ["---:"] * 4)]
    return "\n".join([*lines, ""])


def dataset_card(records: DataFrame, name: str) -> str:
    """Markdown on a dataset (split, decision, date, province): rows by split and label, dates, provinces."""
    pivot = records.groupBy("split").pivot("decision", LEVEL2).count().na.fill(0).orderBy("split").collect()
    s = records.agg(F.min(F.nullif("date", F.lit(""))).alias("first"), F.max(F.nullif("date", F.lit(""))).alias("last"),
                    F.count_distinct(F.nullif("province", F.lit(""))).alias("provinces")).first()
    lines = [f"# {name}", "", *_table(["split", *LEVEL2, "total"], [[r["split"], *[r[x] for x in LEVEL2], sum(r[x] for x in LEVEL2)] for r in pivot],
                                      ["---"] + ["---:"] * 5)]
    return "\n".join([*lines, "", f"- dates: {s['first']} to {s['last']}", f"- provinces: {s['provinces']}", ""])
