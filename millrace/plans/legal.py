"""Queries on the rules for prosecution documents, over inline fixtures with expected values worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import text as X
from ..sources.tables import inline, values_sql

DIGITS = [("0", "零"), ("1", "一"), ("10", "十"), ("16", "十六"), ("20", "二十"), ("100", "一百"), ("101", "一百零一"), ("110", "一百一十"),
          ("111", "一百一十一"), ("133", "一百三十三"), ("177", "一百七十七"), ("1000", "一千"), ("1001", "一千零零一"), ("1010", "一千零一十"),
          ("1100", "一千一百"), ("9999", "九千九百九十九"), ("10000", "10000")]
ARTICLES = [("第133条之1", "第一百三十三条之一"), ("264条", "第二百六十四条"), ("第一百七十七条第2款", "第一百七十七条第二款"), ("", "第"), ("第１３３条", "第一百三十三条")]
DECISIONS = [
    ("依照《中华人民共和国刑事诉讼法》第十六条的规定", L.STATUTORY), ("依照刑事诉讼法第一百七十七条第一款", L.STATUTORY),
    ("依照刑事诉讼法第一百七十七条第一款、第一百七十七条第二款", None), ("其行为不构成盗窃罪", L.STATUTORY), ("没有犯罪事实", L.STATUTORY),
    ("根据第一百七十五条第四款", L.INSUFFICIENT), ("证据不足，犯罪情节轻微", L.INSUFFICIENT), ("依照第一百七十七条第二款的规定", L.DISCRETIONARY),
    ("情节较为轻微", L.DISCRETIONARY), ("免予刑事处罚", L.DISCRETIONARY), ("刑事诉讼法\n第十六条", None), ("本院认为", None)]
LABELS = [(" **起诉**。", L.PROSECUTION, L.PROSECUTION), ("相对不起诉。。", None, L.DISCRETIONARY), ("存疑不起诉；", None, L.INSUFFICIENT),
          ("法定不起诉", L.STATUTORY, L.STATUTORY), (" 起诉 。", L.PROSECUTION, L.PROSECUTION), ("不起诉", None, None), ("", None, None)]
_GOOD = "<think>x</think>【适用法条】\n刑法：第一条、第二条\n刑事诉讼法:第三条\n【审查分析】\n分析\n【最终结论】\n决定：起诉。"
ANSWERS = [(_GOOD, "起诉", "cl:第一条|cl:第二条|cpl:第三条", "起诉。", 1.0), (_GOOD, "法定不起诉", "cl:第一条|cl:第二条|cpl:第三条", "起诉。", 0.1),
           ("【审查分析】a【最终结论】决定：起诉", "起诉", "", "起诉", 0.0), (_GOOD.replace("\n分析", ""), "起诉", "cl:第一条|cl:第二条|cpl:第三条", "起诉。", 0.0),
           (_GOOD + "【附】", "起诉", "cl:第一条|cl:第二条|cpl:第三条", "起诉。【附】", 0.0), ("", "起诉", "", "", 0.0)]
DATES = [("2020年1月2日受理，2021年11月30日", "2021-11-30"), ("无日期", None)]
KEYS = [("甲检诉〔2020〕1号", "甲检诉[2020]1号", "甲检诉[2020]1号"), (" 乙【2021】2号", " 乙【2021】2号", "乙[2021]2号")]
MASKS = [("身份证110101199003074512，电话13800138000", "身份证******************，电话1**********"), ("生于1990年3月7日", "生于19**年**月**日"),
         ("1990年3月7日出生", "19**年**月**日出生"), ("邮箱alice@example.com", "邮箱alice@example.com"), ("寄 alice@example.com", "寄 al***@example.com"),
         ("车牌京A12345", "车牌京A****"), ("******1990******12", "******************")]
ADDRESSES = [("人民路123号", "人民路**号"), ("12345号", "1**号"), ("3村5队", "**村**队")]
SECTIONS = [
    ("non_prosecution", "某人民检察院\n不起诉决定书\n被不起诉人张某\n本案由某局移送\n经本院依法审查查明：旧\n甲\n经审查查明：新\n本院认为，轻微\n某人民检察院",
     "某人民检察院\n不起诉决定书", "被不起诉人张某", "本案由某局移送", "经审查查明：新", "本院认为，轻微", "某人民检察院"),
    ("prosecution", "无人\n本案由某局移送\n本院认为", "无人\n本案由某局移送\n本院认为", "", "", "", "", ""),
    ("prosecution", "被告人李某\n本案由某局\n犯罪事实\n本院认为\n此致\n某院", "", "被告人李某", "本案由某局", "犯罪事实", "本院认为", "此致\n某院")]


def zh_digit(spark, sf):
    return inline(spark, ["n"], [(a,) for a, _ in DIGITS]).select("n", L.digit_to_chinese(F.col("n")).alias("numeral"))


def zh_article_normalize(spark, sf):
    return inline(spark, ["a"], [(a,) for a, _ in ARTICLES]).select("a", L.normalize_article(F.col("a")).alias("article"))


def zh_decision_rules(spark, sf):
    return inline(spark, ["t"], [(a,) for a, _ in DECISIONS]).select("t", L.decision_type(F.col("t")).alias("decision"))


def zh_label_norm(spark, sf):
    d = inline(spark, ["t"], [(r[0],) for r in LABELS])
    return d.select("t", L.normalize_label(F.col("t")).alias("strict"), L.lenient_label(F.col("t")).alias("lenient"))


def zh_answer_parse(spark, sf):
    d = inline(spark, ["t", "gold"], [r[:2] for r in ANSWERS])
    return d.select("t", "gold", F.array_join(L.answer_articles(F.col("t")), "|").alias("articles"), L.answer_decision(F.col("t")).alias("decision"))


def zh_reward(spark, sf):
    d = inline(spark, ["t", "gold"], [r[:2] for r in ANSWERS])
    return d.select("t", "gold", L.reward(F.col("t"), F.col("gold")).alias("reward"))


def zh_dates(spark, sf):
    return inline(spark, ["t"], [(r[0],) for r in DATES]).select("t", L.last_date(F.col("t")).alias("d"))


def zh_case_key(spark, sf):
    d = inline(spark, ["t"], [(r[0],) for r in KEYS])
    return d.select("t", X.case_key(F.col("t")).alias("plain"), X.case_key(F.col("t"), True, True).alias("full_key"))


def zh_mask(spark, sf):
    return inline(spark, ["t"], [(r[0],) for r in MASKS]).select("t", L.mask(F.col("t")).alias("masked"))


def zh_address(spark, sf):
    return inline(spark, ["t"], [(r[0],) for r in ADDRESSES]).select("t", L.anonymize_address(F.col("t")).alias("masked"))


def zh_segments(spark, sf):
    d = inline(spark, ["kind", "t"], [r[:2] for r in SECTIONS])
    return d.select("kind", "t", L.sections(F.col("t"), F.col("kind")).alias("s")).select("kind", "t", *[F.col(f"s.{n}").alias(f"s_{n}") for n in L.SECTIONS])


def zh_level1(spark, sf):
    d = inline(spark, ["t"], [(x,) for x in (*L.LABELS, "其他")])
    return d.select("t", L.to_level1(F.col("t")).alias("level1"))


SQL = {
    "zh_digit": values_sql(["n", "numeral"], DIGITS), "zh_article_normalize": values_sql(["a", "article"], ARTICLES),
    "zh_decision_rules": values_sql(["t", "decision"], DECISIONS), "zh_label_norm": values_sql(["t", "strict", "lenient"], LABELS),
    "zh_answer_parse": values_sql(["t", "gold", "articles", "decision"], [r[:4] for r in ANSWERS]),
    "zh_reward": "select t, gold, r::double as reward from (" + values_sql(["t", "gold", "r"], [(r[0], r[1], r[4]) for r in ANSWERS]) + ")",
    "zh_dates": values_sql(["t", "d"], DATES), "zh_case_key": values_sql(["t", "plain", "full_key"], KEYS),
    "zh_mask": values_sql(["t", "masked"], MASKS), "zh_address": values_sql(["t", "masked"], ADDRESSES),
    "zh_segments": values_sql(["kind", "t", *[f"s_{n}" for n in L.SECTIONS]], SECTIONS),
    "zh_level1": values_sql(["t", "level1"], [(L.PROSECUTION, "起诉"), (L.DISCRETIONARY, "不起诉"), (L.STATUTORY, "不起诉"), (L.INSUFFICIENT, "不起诉"), ("其他", "起诉")]),
}
QUERIES = {n: globals()[n] for n in SQL}
