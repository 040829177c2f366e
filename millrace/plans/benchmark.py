"""Queries on the whole evaluation: four classes with unparsed and invalid labels, articles, runs, several labels a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import metrics as M
from ..sources.tables import table

LABELS = ("起诉", "相对不起诉", "法定不起诉", "存疑不起诉")
CHARGES = ("盗窃", "抢夺", "诈骗", "抢劫", "放火", "敲诈勒索")


def entries(spark, sf):
    """Predictions on documents, labels written as models write them."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("source").alias("k"))
    labels = F.array(*[F.lit(x) for x in LABELS])
    gold = F.get(labels, F.element_at(F.array(*[F.lit(x) for x in (0, 0, 0, 0, 1, 1, 2, 3, 9)]), (F.col("doc_id") % 9 + 1).cast("int")))
    guess = F.when(F.col("n_chars") % 3 == 0, (F.col("n_chars") + F.col("k")) % 4).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 0, 0, 0, 1, 1, 2, 3, 0)]), (F.col("doc_id") % 9 + 1).cast("int")))
    pred = F.get(labels, guess.cast("int"))
    written = F.when(F.col("n_chars") % 11 == 0, F.lit(None)).when(F.col("n_chars") % 11 == 1, F.lit("无法判断")).when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit(" **"), pred, F.lit("** 。 "))).otherwise(pred)

    def articles(*parts):
        return F.transform(F.array(*[p.cast("string") for p in parts]), lambda x: F.concat(F.lit("cl:"), x))

    i, n = F.col("doc_id"), F.col("n_chars")
    none = F.array().cast("array<string>")
    return d.select(
        i.alias("sample_index"), (i % 5).cast("int").alias("run_id"), F.coalesce(gold, F.lit("撤回")).alias("ref_decision"),
        written.alias("pred_decision"), F.when(i % 10 == 0, none).otherwise(articles(i % 5, i % 3, n % 4)).alias("ref_articles"),
        F.when(n % 10 == 0, none).otherwise(articles(i % 5, n % 3, n % 3)).alias("pred_articles"))


def eval_summary(spark, sf):
    return E.summary(entries(spark, sf))


def eval_level2_classes(spark, sf):
    return E.classes(entries(spark, sf), 2).select("label", "tp", "fp", "fn", "support", "f1")


def eval_level1_classes(spark, sf):
    return E.classes(entries(spark, sf), 1).select("label", "tp", "fp", "fn", "support", "f1")


def eval_stability(spark, sf):
    s = E.stability(E.summary(entries(spark, sf), ("run_id",)))
    return s.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "se", "ci_low", "ci_high")])


def several(spark, sf):
    charges = F.array(*[F.lit(x) for x in CHARGES])
    i, n = F.col("doc_id"), F.col("n_chars")
    # the last charge never is gold; 杀人 is no label
    gold = F.array(F.get(charges, (i % 5).cast("int")), F.get(charges, (i % 2).cast("int")))
    pred = F.array(F.get(charges, F.when(n % 4 == 0, n % 6).otherwise(i % 5).cast("int")), F.when(n % 7 == 0, F.lit("杀人")).otherwise(F.get(charges, (i % 2).cast("int"))))
    return table(spark, sf, "documents").select(
        F.array_distinct(gold).alias("gold"), F.when(n % 13 == 0, F.array().cast("array<string>")).otherwise(pred).alias("pred"))


def charges_summary(spark, sf):
    return E.multilabel_summary(several(spark, sf), list(CHARGES))


def charges_top_support(spark, sf):
    c = M.multilabel(several(spark, sf), "gold", "pred").where(F.col("label").isin(*CHARGES))
    return c.orderBy(F.desc("support"), "label").limit(3)


def charges_label_summary(spark, sf):
    s = several(spark, sf)
    return s.agg(F.count("*").alias("n"), F.count_if(F.size("gold") == 1).alias("single"), F.count_if(F.size("gold") > 1).alias("multi"),
                 F.sum(F.size("gold")).alias("labels")).crossJoin(s.select(F.explode("gold").alias("g")).agg(F.count_distinct("g").alias("distinct_labels")))


def charges_label_lengths(spark, sf):
    return several(spark, sf).groupBy(F.size("gold").alias("length")).agg(F.count("*").alias("n"))


def charges_sample_label(spark, sf):
    """Share of each sample label: the charge, or all of them sorted and joined."""
    name = F.when(F.size("pred") == 0, "（未提取）").otherwise(F.array_join(F.array_sort(F.array_distinct("pred")), " + "))
    c = several(spark, sf).groupBy(name.alias("label")).agg(F.count("*").alias("n"))
    total = several(spark, sf).agg(F.count("*").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"),
                                                 F.round(100 * F.col("n") / F.col("total"), 4).alias("percent"))


_ENTRIES = """g(doc, ref) as (select doc_id, (['起诉', '起诉', '起诉', '起诉', '相对不起诉', '相对不起诉', '法定不起诉', '存疑不起诉', null])[doc_id % 9 + 1] from documents),
  e as (select doc_id as i, (doc_id % 5)::int as run_id, n_chars as n, ref,
    case when n_chars % 11 in (0, 1) then null
      when n_chars % 3 = 0 then (['起诉', '相对不起诉', '法定不起诉', '存疑不起诉'])[(n_chars + length(source)) % 4 + 1]
      else coalesce(ref, '起诉') end as pred,
    case when doc_id % 10 = 0 then [] else list_distinct([doc_id % 5, doc_id % 3, n_chars % 4]) end as ra,
    case when n_chars % 10 = 0 then [] else list_distinct([doc_id % 5, n_chars % 3]) end as pa
    from documents join g on doc = doc_id),
  s as (select *, case when ref is null then null when ref = '起诉' then ref else '不起诉' end as ref1,
    case when pred is null then null when pred = '起诉' then pred else '不起诉' end as pred1,
    len(list_intersect(ra, pa))::double as hit from e),
  a as (select *, case when len(ra) = 0 and len(pa) = 0 then 1 when len(ra) = 0 or len(pa) = 0 then 0 else hit / len(pa) end::double as ap,
    case when len(ra) = 0 and len(pa) = 0 then 1 when len(ra) = 0 or len(pa) = 0 then 0 else hit / len(ra) end::double as ar from s),
  f as (select *, case when ap + ar > 0 then 2 * ap * ar / (ap + ar) else 0 end as af from a),
  tall as (select run_id, 2 as level, ref as gold, pred as guess from f where ref is not null
    union all select run_id, 1, ref1, pred1 from f where ref is not null),
  names(level, label) as (values (2, '起诉'), (2, '相对不起诉'), (2, '法定不起诉'), (2, '存疑不起诉'), (1, '起诉'), (1, '不起诉'))"""


def _class_sql(by: str) -> str:
    on = f"{by}, " if by else ""
    return f"""c as (select {on}names.level, label, count(*) filter (where gold = label and guess = label) as tp,
      count(*) filter (where gold <> label and guess = label) as fp, count(*) filter (where gold = label and guess is distinct from label) as fn,
      count(*) filter (where gold = label) as support from names join tall using (level) group by all),
    cf as (select *, case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) else 0 end::double as f1 from c),
    m as (select {on}level, avg(f1) as macro, sum(tp) / nullif(sum(tp) + sum(fp), 0)::double as mp, sum(tp) / nullif(sum(tp) + sum(fn), 0)::double as mr from cf group by all),
    mm as (select *, case when mp + mr > 0 then 2 * mp * mr / (mp + mr) else 0 end as mf from m)"""


_CHARGES_SQL = """x as (select doc_id as i, n_chars as n, ['盗窃', '抢夺', '诈骗', '抢劫', '放火', '敲诈勒索'] as c from documents),
  y as (select i, list_distinct([c[i % 5 + 1], c[i % 2 + 1]]) as gold, case when n % 13 = 0 then []
    else [c[case when n % 4 = 0 then n % 6 else i % 5 end + 1], case when n % 7 = 0 then '杀人' else c[i % 2 + 1] end] end as pred, c from x),
  u as (select unnest(c) as label, c, gold, pred from y),
  v as (select label, count(*) filter (where list_contains(gold, label) and list_contains(pred, label)) as tp,
    count(*) filter (where not list_contains(gold, label) and list_contains(pred, label)) as fp,
    count(*) filter (where list_contains(gold, label) and not list_contains(pred, label)) as fn,
    count(*) filter (where list_contains(gold, label)) as support from u group by label)"""
SQL = {
    "eval_summary": f"""with {_ENTRIES}, {_class_sql('')}
      select count(*) as n, avg(ap) as articles_precision, avg(ar) as articles_recall, avg(af) as articles_f1,
        count(ref) as decision_eval_count, count(*) - count(ref) as reference_parse_fail_count,
        count(*) filter (where ref is not null and pred is null) as decision_parse_fail_count,
        avg((pred is not distinct from ref)::int::double) filter (where ref is not null) as level2_accuracy,
        avg((pred1 is not distinct from ref1)::int::double) filter (where ref is not null) as level1_accuracy,
        {', '.join(f"(select {c} from mm where level = {k}) as level{k}_{n}" for k in (1, 2) for c, n in (
            ('macro', 'macro_f1'), ('mp', 'micro_precision'), ('mr', 'micro_recall'), ('mf', 'micro_f1')))} from f""",
    "eval_level2_classes": f"with {_ENTRIES}, {_class_sql('')} select label, tp, fp, fn, support, f1 from cf where level = 2",
    "eval_level1_classes": f"with {_ENTRIES}, {_class_sql('')} select label, tp, fp, fn, support, f1 from cf where level = 1",
    "eval_stability": f"""with {_ENTRIES}, {_class_sql('run_id')},
      r as (select 'Articles F1' as metric, run_id, avg(af) as v from f group by run_id
        union all select 'Level' || level || ' Macro-F1', run_id, macro from mm union all select 'Level' || level || ' Micro-F1', run_id, mf from mm),
      z as (select metric, count(*) as n, avg(v) as mean, stddev_samp(v) as sd, stddev_samp(v) / sqrt(count(*)) as se from r group by metric),
      t(k, q) as (values (1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776))
      select metric, n, round(mean, 6) as mean, round(sd, 6) as sd, round(se, 6) as se, round(mean - q::double * se, 6) as ci_low,
        round(mean + q::double * se, 6) as ci_high from z join t on k = n - 1""",
    "charges_summary": f"""with {_CHARGES_SQL}, q as (select *, case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end::double as f1 from v),
      w as (select avg(f1) filter (where support > 0) as macro_f1, sum(tp) / (sum(tp) + sum(fp))::double as micro_precision,
        sum(tp) / (sum(tp) + sum(fn))::double as micro_recall from q)
      select w.*, 2 * micro_precision * micro_recall / (micro_precision + micro_recall) as micro_f1, num_samples, 6 as num_labels, exact_match,
        parse_fail_count, invalid_prediction_count from w, (select count(*) as num_samples,
          avg((list_sort(gold) = list_sort(list_distinct(pred)))::int::double) as exact_match, count(*) filter (where len(pred) = 0) as parse_fail_count,
          sum(len(list_filter(pred, lambda p: p = '杀人')))::bigint as invalid_prediction_count from y)""",
    "charges_top_support": f"with {_CHARGES_SQL} select label, tp, fp, fn, support from v order by support desc, label limit 3",
    "charges_label_summary": f"""with {_CHARGES_SQL} select count(*) as n, count(*) filter (where len(gold) = 1) as single,
      count(*) filter (where len(gold) > 1) as multi, sum(len(gold))::bigint as labels,
      (select count(distinct g) from (select unnest(gold) as g from y)) as distinct_labels from y""",
    "charges_label_lengths": f"with {_CHARGES_SQL} select len(gold)::int as length, count(*) as n from y group by 1",
    "charges_sample_label": f"""with {_CHARGES_SQL}, k as (select case when len(pred) = 0 then '（未提取）'
        else array_to_string(list_sort(list_distinct(pred)), ' + ') end as label from y)
      select label, count(*) as n, round(count(*) / (select count(*) from y)::double, 6) as ratio,
        round(100 * count(*) / (select count(*) from y)::double, 4) as percent from k group by label""",
}
QUERIES = {n: globals()[n] for n in SQL}
