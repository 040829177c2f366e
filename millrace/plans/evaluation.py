"""Queries on predictions: classes, sets, labels, runs, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import EVAL_SQL, eval_rows, table

CLASSES_SQL = """
  classes as (select unnest(['0', '1']) as label),
  counts as (select label, count(*) filter (where gold = label and pred = label) as tp,
      count(*) filter (where gold <> label and pred = label) as fp,
      count(*) filter (where gold = label and pred is distinct from label) as fn,
      count(*) filter (where gold = label) as support
    from classes cross join eval_rows group by label),
  scored as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall from counts),
  per as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from scored)"""


def metrics_l2_per_class(spark, sf):
    return M.per_class(eval_rows(spark, sf), ["0", "1"])


def metrics_l1_per_class(spark, sf):
    e = eval_rows(spark, sf)
    up = {c: F.when(F.col(c).isNotNull(), F.when(F.col(c) == "1", "keep").otherwise("drop")) for c in ("gold", "pred")}
    return M.per_class(e.withColumns(up), ["drop", "keep"]).select("label", "support", "f1")


def metrics_macro_micro(spark, sf):
    return M.macro_micro(M.per_class(eval_rows(spark, sf), ["0", "1"]))


def metrics_accuracy_levels(spark, sf):
    e = eval_rows(spark, sf)
    return e.agg(F.avg(F.when(F.col("pred").eqNullSafe(F.col("gold")), 1.0).otherwise(0.0)).alias("accuracy"),
                 F.count_if(F.col("pred").isNull()).alias("parse_fail"), F.count("*").alias("n"))


def metrics_confusion_groups(spark, sf):
    e = eval_rows(spark, sf)
    group = F.when(F.col("gold").isNull(), "bad_reference").when(F.col("pred").isNull(), "not_parsed").when(
        F.col("gold") == F.col("pred"), "right").otherwise(F.concat_ws("_", "gold", "pred"))
    return e.groupBy(group.alias("outcome")).agg(F.count("*").alias("n"))


def metrics_set_f1(spark, sf):
    s = eval_rows(spark, sf).select("sample_index", M.set_scores(F.col("pred_set"), F.col("gold_set")).alias("s"))
    return s.select("sample_index", "s.p", "s.r", "s.f")


def metrics_multilabel(spark, sf):
    return M.multilabel(eval_rows(spark, sf).select(F.col("gold_set").alias("g"), F.col("pred_set").alias("p")), "g", "p")


def metrics_by_run(spark, sf):
    return M.per_class(eval_rows(spark, sf), ["0", "1"], by=("run_id",)).select("run_id", "label", "tp", "fp", "fn", "f1")


def metrics_run_ci95(spark, sf):
    runs = M.macro_micro(M.per_class(eval_rows(spark, sf), ["0", "1"], by=("run_id",)), by=("run_id",))
    s = M.mean_se_ci(runs, "macro_f1")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "se", "ci95")])


def stats_pearson_spearman(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("x"), F.count("*").cast("double").alias("y"))
    c = M.with_average_rank(M.with_average_rank(c, "x", "rx"), "y", "ry")
    return c.agg(F.round(M.correlation("x", "y"), 6).alias("pearson"), F.round(M.correlation("rx", "ry"), 6).alias("spearman"))


def stats_regression(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    a = p.agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.coalesce(F.try_divide("c", "v"), F.lit(0.0))
    return a.select(F.round(slope, 6).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), 4).alias("intercept"))


_W = f"with {EVAL_SQL}, {CLASSES_SQL}"
SQL = {
    "metrics_l2_per_class": f"{_W} select label, tp, fp, fn, support, precision, recall, f1 from per",
    "metrics_l1_per_class": f"{_W} select case label when '1' then 'keep' else 'drop' end as label, support, f1 from per",
    "metrics_macro_micro": f"""{_W}, s as (select avg(f1) as macro_f1, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from per),
        m as (select macro_f1, (tp / (tp + fp))::double as micro_precision, (tp / (tp + fn))::double as micro_recall from s)
        select *, 2 * micro_precision * micro_recall / (micro_precision + micro_recall) as micro_f1 from m""",
    "metrics_accuracy_levels": f"""with {EVAL_SQL} select avg(case when pred is not distinct from gold then 1.0::double else 0 end) as accuracy,
        count(*) filter (where pred is null) as parse_fail, count(*) as n from eval_rows""",
    "metrics_confusion_groups": f"""with {EVAL_SQL} select case when gold is null then 'bad_reference' when pred is null then 'not_parsed'
        when gold = pred then 'right' else gold || '_' || pred end as outcome, count(*) as n from eval_rows group by 1""",
    "metrics_set_f1": f"""with {EVAL_SQL}, s as (select sample_index, len(gold_set) as g, len(pred_set) as q,
          len(list_intersect(gold_set, pred_set)) as n from eval_rows),
        t as (select sample_index, g, q, n / nullif(q, 0)::double as p0, n / nullif(g, 0)::double as r0 from s)
        select sample_index, case when g = 0 and q = 0 then 1 else coalesce(p0, 0) end::double as p,
          case when g = 0 and q = 0 then 1 else coalesce(r0, 0) end::double as r,
          case when g = 0 and q = 0 then 1 else coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) end::double as f from t""",
    "metrics_multilabel": f"""with {EVAL_SQL}, t as (select unnest(list_distinct(list_concat(gold_set, pred_set))) as label, gold_set, pred_set from eval_rows),
        u as (select label, list_contains(gold_set, label) as g, list_contains(pred_set, label) as p from t)
        select label, count(*) filter (where g and p) as tp, count(*) filter (where not g and p) as fp,
          count(*) filter (where g and not p) as fn, count(*) filter (where g) as support from u group by label""",
    "metrics_by_run": f"""with {EVAL_SQL}, c as (select run_id, label, count(*) filter (where gold = label and pred = label) as tp,
          count(*) filter (where gold <> label and pred = label) as fp,
          count(*) filter (where gold = label and pred is distinct from label) as fn
          from eval_rows cross join (select unnest(['0', '1']) as label) group by all),
        s as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as p, coalesce(tp / nullif(tp + fn, 0)::double, 0) as r from c)
        select run_id, label, tp, fp, fn, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from s""",
    "metrics_run_ci95": f"""with {EVAL_SQL}, c as (select run_id, label, count(*) filter (where gold = label and pred = label) as tp,
          count(*) filter (where gold <> label and pred = label) as fp,
          count(*) filter (where gold = label and pred is distinct from label) as fn
          from eval_rows cross join (select unnest(['0', '1']) as label) group by all),
        s as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as p, coalesce(tp / nullif(tp + fn, 0)::double, 0) as r from c),
        m as (select run_id, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) as f from s group by 1),
        a as (select count(*) as n, avg(f) as mean, stddev_samp(f) as sd from m)
        select n, round(mean, 6) as mean, round(sd, 6) as sd, round(sd / sqrt(n), 6) as se, round(2.776 * sd / sqrt(n), 6) as ci95 from a""",
    "stats_pearson_spearman": """with c as (select c_nationkey, sum(c_acctbal) as x, count(*)::double as y from customer group by 1),
        r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx,
          rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from c)
        select round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r""",
    "stats_regression": """select round(regr_slope(p_retailprice, p_size), 6) as slope, round(regr_intercept(p_retailprice, p_size), 4) as intercept from part""",
}
QUERIES = {n: globals()[n] for n in SQL}
