"""Queries on the fields of case records, over inline fixtures with expected values worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..sources.tables import inline, values_sql

ARTICLES = [
    ("依照《中华人民共和国刑法》第133条之一第一款、第六十七条和《刑事诉讼法》第一百七十七条第二款的规定", "cl:第一百三十三条之一第一款|cl:第六十七条|cpl:第一百七十七条第二款"),
    ("该行为不属于《刑法》第二条", ""), ("不构成犯罪。依照《刑法》第二条", "cl:第二条"), ("《刑法》第二条，《刑法》第二条", "cl:第二条"),
    ("《人民检察院刑事诉讼规则》 第三百六十五条及《刑法》264条", "cl:第二百六十四条|cpr:第三百六十五条"), ("刑法第二条", ""), ("", "")]
LISTS = [("刑法第一条|《刑事诉讼法》第二条|人民检察院刑事诉讼规则：第三条|cl:第四条|刑法第一条|民法第五条| ", "cl:第一条|cpl:第二条|cpr:第三条|cl:第四条",
          "刑法：第一条、第四条\n刑事诉讼法：第二条\n刑事诉讼规则：第三条"), ("民法", "", "无")]
PROVINCES = [("北京", "", "", "北京市"), ("内蒙古呼和浩特", "", "", "内蒙古自治区"), ("", "河北省", "山东", "河北省"), ("", "河北", "某地\n广东省某市", "广东省"),
             ("", "", "a\nb\nc\nd\ne\nf\ng\nh\n山东省", ""), ("", "", "山东某地，江西省", "江西省"), (None, None, "新疆某地", "新疆维吾尔自治区"), (None, None, None, "")]
HEADERS = [("河北省某院", "河北省"), ("广西某院", ""), ("吉林市某院", "吉林省")]
DATES = [("2020-01-02", "2020-01-02"), ("于2020年1月2日、2021年3月4日", "2020-01-02"), ("2020/11/3", "2020-11-03"), ("去年", ""), (None, "")]
URLS = [("见 https://a.example/x?y=1）。 后文", "https://a.example/x?y=1", ""), ("http://b.example/；", "http://b.example/", "http://b.example/"), ("ftp://c", "", "")]
FACTS = [("犯罪事实：经审查查明：甲盗窃。", "甲盗窃。", False, False), ("。认定上述事实的证据如下：书证", "。认定上述事实的证据如下：书证", True, False),
         ("甲盗窃。认定上述事实的证据如下：书证", "甲盗窃。认定上述事实的证据如下：书证", True, False), ("证据不足", "证据不足", False, True), ("", "", False, False)]
REASONINGS = [
    ("前文\n本院认为，轻微。\n某市人民检察院\n（院印）\n2020年1月2日", "本院认为，轻微。\n某市人民检察院\n（院印）", "前文\n本院认为，轻微。"),
    ("本院认为，轻微。\n2020年1月2日\n（院印）\n某市人民检察院", "本院认为，轻微。", "本院认为，轻微。\n2020年1月2日\n（院印）"),
    ("经审查并退回补充侦查，仍不足\n后文", "经审查并退回补充侦查，仍不足", "经审查并退回补充侦查，仍不足\n后文"), ("本院认为甲\n此致\n某院", "本院认为甲", "本院认为甲\n此致\n某院")]
LABELS = [("[走私、贩卖]毒品罪", "[走私、贩卖]毒品", "[走私、贩卖]毒品|贩卖毒品|走私、贩卖毒品|走私毒品"),
          ("非法[持有、私藏][枪支、弹药]", "非法[持有、私藏][枪支、弹药]", "非法[持有、私藏][枪支、弹药]|非法持有、私藏枪支、弹药|非法持有弹药|非法持有枪支|非法私藏弹药|非法私藏枪支"),
          (" “盗窃罪”。", "盗窃", "盗窃")]
POLICE = [("以张某某涉嫌盗窃罪、抢劫罪移送", "", "", "盗窃罪"), ("涉嫌盗窃罪，又涉嫌犯有抢劫罪", "因涉嫌诈骗罪", "", "盗窃罪|抢劫罪"), ("侦查终结，以犯罪嫌疑人李某甲故意伤害案，移送", "", "", "故意伤害罪"),
          ("", "因涉嫌帮助信息网络犯罪，被拘留。", "", "帮助信息网络犯罪活动罪"), ("", "", "某公安局认为王某的行为构成诈骗罪。", "诈骗罪"), ("移送", "", "", ""), (None, None, None, "")]
MASKS = [("银行卡号：6222021234567890123", "银行卡号：" + "*" * 18, "银行卡号：" + "*" * 18), ("微信号abcde1，电话 13800138000", "微信号a***1，电话 1" + "*" * 10, "微信号a***1，电话 1" + "*" * 10),
         ("住某路12号3室", "住某路12号3室", "住某路**号**室"), ("QQ号12345", "QQ号1***5", "QQ号1***5"), ("", "", "")]
RESIDUE = [("110101199003074512", "possible_id_card_residue"), ("1380***8000，生于1990年3月7日", "possible_mobile_residue|possible_birth_date_residue"),
           ("*" * 18, ""), ("110101********4512", "possible_id_card_residue"), (None, "")]
PDFS = [("某市人民检察院\n不起诉决定书\n- 1 -\n本案由某局移送，第一百七十\n七条\n\n另段 2025 年 9 月 第 1 款\n2", "某市人民检察院\n不起诉决定书\n本案由某局移送，第一百七十七条\n另段 2025年 9月 第1款"), ("", "")]
REPLIES = [("<think>{}</think>{\"a\": 1}", '{"a": 1}'), ("前文 {\"a\": \"}\\\"{\"} 后文 {\"b\": 2}", '{"a": "}\\"{"}'), ("```json\n{\"a\": 1}\n```", '{"a": 1}'),
           ("[1, 2]", None), ("{\"a\": 1", None), ("无", None), ("", None)]
VERDICTS = [(" Yes ", "true"), ("不合规", "false"), ("1", "true"), ("也许", None), (None, None)]
CASES = [  # doc_type, person, procedure, fact, reasoning, decision, date, province, articles, url, issues
    ("prosecution", "甲", "本案由", "甲于某日盗窃" * 12, "依照刑法", "起诉", "2020-01-01", "北京市", "cl:第一条", "https://a", ""),
    ("non_prosecution", "", "", "", "", "", "", "", "", "", "missing_person|missing_procedure|missing_fact|missing_reasoning|decision_empty|missing_date|missing_province"),
    ("non_prosecution", "被告人甲", "提起公诉", "证据不足", "证据不足，依照刑法", "相对不起诉", "d", "p", "", "ftp://a",
     "short_fact|decision_mismatch|missing_articles|fact_contaminated|label_leakage_in_person_info|label_leakage_in_procedure|bad_source_url")]
DOCUMENTS = [  # doc_type, header, person, procedure, fact, reasoning, province, decision, articles, date, warnings
    ("non_prosecution", "某院\n起诉书", "甲", "", "", "", "", None, "", "", "doc_type_mismatch"), ("prosecution", "某院\n 不起诉决定书", "", "", "", "", "", None, "", "", "doc_type_mismatch|empty"),
    ("prosecution", "起诉书", "甲", "", "", "", "", None, "", "", "missing_province|missing_procedure"),
    ("non_prosecution", "不起诉决定书", "甲", "乙", "《刑法》", "丁", "p", None, "", "", "unclassified_decision|fact_contaminated|missing_procedural_law|missing_date"),
    ("non_prosecution", "不起诉决定书", "甲", "乙", "丙", "丁", "p", "相对不起诉", "cpl:第一条", "d", "missing_cl")]
CASE_FIELDS = ["doc_type", "person_info", "procedure", "fact", "reasoning", "decision", "date", "province", "articles", "source_url"]
DOCUMENT_FIELDS = ["doc_type", "header", "person", "procedure", "fact", "reasoning", "province", "decision", "articles", "date"]


def _list(c):
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))


def _joined(c):
    return F.array_join(c, "|")


def _over(fields, rows, **columns):
    """Query that applies functions of the input columns to the rows' first fields."""
    def run(spark, sf):
        d = inline(spark, fields, [r[: len(fields)] for r in rows])
        return d.select(*fields, *[f(*[F.col(n) for n in fields]).alias(n) for n, f in columns.items()])

    return run, values_sql([*fields, *columns], rows)


def _record(fields, function):
    def run(*cols):
        r = dict(zip(fields, cols, strict=True))
        return _joined(function(r | {"articles": _list(r["articles"])}))

    return run


_ALL = {
    "zh_cited_articles": _over(["t"], ARTICLES, articles=lambda t: _joined(R.cited_articles(t))),
    "zh_article_lists": _over(["t"], LISTS, articles=lambda t: _joined(R.prefixed_articles(_list(t))), grouped=lambda t: R.grouped_articles(R.prefixed_articles(_list(t)))),
    "zh_province": _over(["v", "f", "t"], PROVINCES, province=R.province),
    "zh_header_province": _over(["t"], HEADERS, province=R.header_province),
    "zh_iso_date": _over(["t"], DATES, d=R.iso_date),
    "zh_page_address": _over(["t"], URLS, found=R.first_address, own=R.page_address),
    "zh_fact_rules": _over(["t"], FACTS, cleaned=R.clean_fact, evidence_only=R.fact_evidence_only, contaminated=R.fact_contaminated),
    "zh_reasoning_rules": _over(["t"], REASONINGS, cleaned=R.clean_reasoning, tail=R.reasoning_tail),
    "zh_label_forms": _over(["t"], LABELS, label=R.compact_label, forms=lambda t: _joined(R.label_forms(t))),
    "zh_police_charges": _over(["pr", "pe", "fa"], POLICE, charges=lambda *c: _joined(R.police_charges(*c))),
    "zh_mask_all": _over(["t"], MASKS, masked=R.mask_all, with_numbers=lambda t: R.mask_all(t, True)),
    "zh_residue": _over(["t"], RESIDUE, residue=lambda t: _joined(R.residue(t))),
    "zh_pdf_lines": _over(["t"], PDFS, joined=R.pdf_text),
    "zh_json_object": _over(["t"], REPLIES, object=R.json_object),
    "zh_yes_or_no": _over(["t"], VERDICTS, answer=lambda t: R.yes_or_no(t).cast("string")),
    "zh_issues": _over(CASE_FIELDS, CASES, issues=_record(CASE_FIELDS, R.issues)),
    "zh_warnings": _over(DOCUMENT_FIELDS, DOCUMENTS, warnings=_record(DOCUMENT_FIELDS, R.warnings)),
}
QUERIES = {n: run for n, (run, _) in _ALL.items()}
SQL = {n: sql for n, (_, sql) in _ALL.items()}
