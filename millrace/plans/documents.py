"""Queries on parsing: documents put together from the rows of documents, replies of models from those of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import legal as L
from ..functions import records as R
from ..functions import text as X
from ..sources.tables import inline, table, values_sql

PROVINCES = ("云南省", "四川省", "山东省")
REASONS = (("情节轻微，依照《中华人民共和国刑事诉讼法》第177条第2款的规定", "相对不起诉"), ("没有犯罪事实，依照《刑事诉讼法》第一百七十七条第一款", "法定不起诉"),
           ("证据不足，依照《刑法》第264条、《刑事诉讼法》第一百七十五条第四款", "存疑不起诉"), ("无法说明", None))
LABELS = ("盗窃", "抢夺", "诈骗", "[走私、贩卖]毒品")


def _pick(values, n):
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


def made_documents(spark, sf):
    """Documents with every part, without their persons (one in seven), without a date (one in five)."""
    i = F.col("doc_id")
    word = F.concat(F.lit("甲"), (i % 97).cast("string"))
    parts = [
        F.lit("来源：某网"), F.concat(_pick(PROVINCES, i % 3), F.lit("某县人民检察院")), F.lit("不起诉决定书"),
        F.concat(F.lit("某检诉〔2021〕"), (i % 1000).cast("string"), F.lit("号")),
        F.when(i % 7 != 0, F.concat(F.lit("被不起诉人"), word, F.lit("，住某路12号\n辩护人某某"))), F.lit("本案由某县公安局侦查终结"),
        F.lit("经本院依法审查查明：\n当事人于某日取走财物"), F.concat(F.lit("本院认为，"), _pick([r for r, _ in REASONS], i % 4)),
        F.lit("某县人民检察院"), F.when(i % 5 != 0, F.concat(F.lit("2021年"), (i % 12 + 1).cast("string"), F.lit("月3日")))]
    return table(spark, sf, "documents").select(i, F.concat_ws("\n", *parts).alias("text"))


def doc_parse(spark, sf):
    p = made_documents(spark, sf).select("doc_id", D.parse_document(F.col("text"), F.lit("non_prosecution")).alias("r"))
    return p.select("doc_id", "r.id", "r.meta.date", "r.meta.province", "r.person_info", "r.fact", F.array_join("r.relevant_articles", "|").alias("articles"),
                    "r.decision", F.array_join("r.warnings", "|").alias("warnings"))


def doc_reject(spark, sf):
    p = made_documents(spark, sf).select(D.parse_document(F.col("text"), F.lit("non_prosecution"))["warnings"].alias("w"))
    return p.groupBy(F.when(D.rejected(F.col("w")), F.array_join("w", "|")).otherwise("kept").alias("status")).agg(
        F.count("*").alias("n"))


def doc_identify(spark, sf):
    i = F.col("doc_id")
    long = F.when(i % 2 == 0, F.repeat(F.lit("事实经过。"), F.lit(60))).otherwise(F.lit("短"))
    t = table(spark, sf, "documents").select(i, F.concat(
        F.lit("某县人民检察院\n"), F.when(i % 3 == 0, F.lit("起诉书")).otherwise(F.lit("不起诉决定书")), F.lit("\n某检刑诉〔2020〕 "), (i % 50).cast("string"),
        F.lit(" 号\n"), long, F.lit("\n2020 年 "), (i % 9 + 1).cast("string"), F.lit(" 月 7 日")).alias("t"))
    return t.select("doc_id", D.identify(F.col("t")).alias("d")).select("doc_id", "d.case_number", "d.doc_type", "d.date")


def forms_map():
    pairs = {}
    for label in LABELS:  # what R.label_forms gives for these
        for form in ([label] if "[" not in label else ["走私毒品", "贩卖毒品", label, "走私、贩卖毒品"]):
            pairs[form] = label
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def reply_labels(spark, sf):
    """Charges read from replies written in five ways."""
    i = F.col("doc_id")
    a, b = _pick(LABELS[:3], i % 3), _pick(LABELS[:3], i / 3 % 3)
    reply = F.when(i % 5 == 0, F.concat(F.lit('<think>a</think>{"accusation": ["'), a, F.lit('罪", "'), b, F.lit('"]}'))).when(
        i % 5 == 1, F.concat(F.lit('```json\n{"罪名": "'), a, F.lit("、"), b, F.lit('"}\n```'))).when(
        i % 5 == 2, F.concat(F.lit("预测罪名："), a, F.lit("罪；贩卖毒品罪"))).when(
        i % 5 == 3, F.concat(F.lit('["'), a, F.lit("、"), b, F.lit('罪"]'))).otherwise(F.concat(F.lit("杀人/"), b))
    return table(spark, sf, "documents").select(i, F.array_join(D.predicted_labels(reply, forms_map()), "|").alias("labels"))


def label_dictionary(spark, sf):
    """Forms of labels with the label that a form stands for: the later one, if several have it."""
    rows = inline(spark, ["label"], [(x,) for x in (*LABELS, "走私毒品罪")]).withColumn("pos", F.monotonically_increasing_id())
    tall = rows.select("label", "pos", F.explode(F.transform(R.label_forms(F.col("label")), R.compact_label)).alias("form")).distinct()
    return tall.groupBy("form").agg(F.max_by("label", "pos").alias("label"))


def reply_verdicts(spark, sf):
    """Verdicts of a judge over three criteria, one of them missing or unclear at times."""
    i = F.col("doc_id")
    reply = F.concat(
        F.lit('ok {"a": {"compliant": '), F.when(i % 2 == 0, F.lit("true")).otherwise(F.lit('"否"')), F.lit('}, "b": '),
        F.when(i % 3 == 0, F.lit('"是"')).when(i % 3 == 1, F.lit("0")).otherwise(F.lit('"maybe"')), F.lit(', "c": {"compliant": 1, "leakage_spans": [" x ", ""]}}'))
    v = table(spark, sf, "documents").select(i, D.verdict(D.reply_object(reply), ("a", "b", "c"), "c").alias("v"))
    return v.select("doc_id", "v.flagged", F.array_join("v.violations", "|").alias("violations"), F.array_join("v.issues", "|").alias("issues"),
                    F.array_join("v.spans", "|").alias("spans"))


def violations_per_criterion(spark, sf):
    v = reply_verdicts(spark, sf).select(F.split("violations", "\\|").alias("v"))
    sums = v.agg(*[F.count_if(F.array_contains("v", k)).alias(k) for k in ("a", "b", "c")])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(k).alias("n")) for k in ("a", "b", "c")])).alias("x")).select("x.*")


OBJECTS = [('{"a": 1}', '{"a": 1}', '{"a": 1}'), ('x {"a": 1} y {"b": {"c": 2}} z', '{"b": {"c": 2}}', None), ('<think>{"q": 0}</think>\n```json\n{"a": "}"}\n```', '{"a": "}"}', '{"a": "}"}'),
           ('say {"a": 1', None, None), ("[1]", None, None), ('pre {"a": "x\\"y{"} post', '{"a": "x\\"y{"}', '{"a": "x\\"y{"}'), ("", None, None)]


def reply_objects(spark, sf):
    d = inline(spark, ["raw"], [(r[0],) for r in OBJECTS])
    return d.select("raw", D.reply_object(F.col("raw")).alias("last"), D.reply_object(F.col("raw"), "span").alias("span"))


NUMBERS = [("某县人民检察院不起诉决定书某检刑不诉〔2020〕12号", "某检刑不诉〔2020〕12号"), ("张某盗窃案某检诉〔2021〕 3 号及其他文字若干", "某检诉〔2021〕3号"), ("无案号", "无案号")]


def zh_clean_case_number(spark, sf):
    return inline(spark, ["raw"], [(r[0],) for r in NUMBERS]).select("raw", D.clean_case_number(F.col("raw")).alias("number"))


CLEANED = [("来源：网\n张 某 某 a b\n\n\n时间：x", "张某某ab\n\n时间：x"), ("甲　乙 丙", "甲乙丙"), ("", "")]


def zh_preclean(spark, sf):
    return inline(spark, ["raw"], [(r[0],) for r in CLEANED]).select("raw", D.preclean(F.col("raw")).alias("clean"))


def report_blank_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.col("source")).alias("s"))
    return d.groupBy(X.or_blank(F.col("s")).alias("source")).agg(F.count("*").alias("n"))


def label_leakage_removed(spark, sf):
    i = F.col("doc_id")
    t = F.concat(F.lit("被不起诉人"), i.cast("string"), F.lit("与被告人"))
    return table(spark, sf, "documents").select(i, L.remove_label_leakage(t).alias("t"))


_I = "doc_id as i"
SQL = {
    "doc_identify": f"""with d as (select {_I} from documents)
      select i as doc_id, case when i % 2 = 0 then '某检刑诉〔2020〕' || (i % 50) || '号' end as case_number,
        case when i % 2 = 0 then case when i % 3 = 0 then '起诉' else '不起诉' end end as doc_type,
        case when i % 2 = 0 then '2020-0' || (i % 9 + 1) || '-07' end as date from d""",
    "reply_labels": f"""with d as (select {_I}, (['盗窃', '抢夺', '诈骗'])[doc_id % 3 + 1] as a, (['盗窃', '抢夺', '诈骗'])[(doc_id // 3) % 3 + 1] as b from documents)
      select i as doc_id, case when i % 5 in (0, 1, 3) then case when a = b then a else a || '|' || b end
        when i % 5 = 2 then a || '|[走私、贩卖]毒品' else b end as labels from d""",
    "label_dictionary": values_sql(["form", "label"], [(x, x) for x in LABELS[:3]] + [
        ("走私毒品", "走私毒品罪"), ("贩卖毒品", LABELS[3]), ("[走私、贩卖]毒品", LABELS[3]), ("走私、贩卖毒品", LABELS[3])]),
    "reply_verdicts": f"""with d as (select {_I} from documents),
      v as (select i, list_filter([case when i % 2 = 1 then 'a' end, case when i % 3 > 0 then 'b' end], lambda x: x is not null) as v from d)
      select i as doc_id, len(v) > 0 as flagged, array_to_string(v, '|') as violations, case when i % 3 = 2 then 'missing_or_bad_b' else '' end as issues,
        'x' as spans from v""",
    "violations_per_criterion": """select 'a' as criterion, count(*) filter (where doc_id % 2 = 1) as n from documents
      union all select 'b', count(*) filter (where doc_id % 3 > 0) from documents union all select 'c', 0""",
    "reply_objects": values_sql(["raw", "last", "span"], OBJECTS),
    "zh_clean_case_number": values_sql(["raw", "number"], NUMBERS),
    "zh_preclean": values_sql(["raw", "clean"], CLEANED),
    "report_blank_sources": """select coalesce(nullif(trim(case when doc_id % 4 = 0 then ' ' else source end), ''), '（空）') as source, count(*) as n
      from documents group by 1""",
    "label_leakage_removed": "select doc_id, '犯罪嫌疑人' || doc_id || '与犯罪嫌疑人' as t from documents",
    "doc_parse": f"""with d as (select {_I} from documents)
      select i as doc_id, '某检诉〔2021〕' || (i % 1000) || '号' as id,
        case when i % 7 = 0 or i % 5 = 0 then '' else '2021-' || lpad((i % 12 + 1)::varchar, 2, '0') || '-03' end as date,
        (['云南省', '四川省', '山东省'])[i % 3 + 1] as province,
        case when i % 7 = 0 then '' else '犯罪嫌疑人甲' || (i % 97) || '，住某路**号' end as person_info,
        case when i % 7 = 0 then '' else '当事人于某日取走财物' end as fact,
        case when i % 7 = 0 then '' else (['cpl:第一百七十七条第二款', 'cpl:第一百七十七条第一款', 'cl:第二百六十四条|cpl:第一百七十五条第四款', ''])[i % 4 + 1] end as articles,
        case when i % 7 = 0 then null else (['相对不起诉', '法定不起诉', '存疑不起诉', null])[i % 4 + 1] end as decision,
        case when i % 7 = 0 then 'empty' else concat_ws('|', case when i % 4 = 3 then 'unclassified_decision' end,
          case when i % 4 = 3 then 'missing_procedural_law' end, case when i % 4 = 0 then 'missing_cl' end, case when i % 5 = 0 then 'missing_date' end) end as warnings
      from d""",
    "doc_reject": f"""with d as (select {_I} from documents), w as (select case when i % 7 = 0 then 'empty' else concat_ws('|',
        case when i % 4 = 3 then 'unclassified_decision' end, case when i % 4 = 3 then 'missing_procedural_law' end, case when i % 4 = 0 then 'missing_cl' end,
        case when i % 5 = 0 then 'missing_date' end) end as w from d)
      select coalesce(nullif(w, ''), 'kept') as status, count(*) as n from w group by 1""",
}
QUERIES = {n: globals()[n] for n in SQL}
