"""Rules for prosecution documents: labels, numerals, articles, decisions, answers, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_block, split_list, strip, sub

# The labels.
PROSECUTION, DISCRETIONARY, STATUTORY, INSUFFICIENT = "起诉", "相对不起诉", "法定不起诉", "存疑不起诉"
LABELS = (PROSECUTION, DISCRETIONARY, STATUTORY, INSUFFICIENT)

# Words that decide the kind of a decision, by rank.
STATUTORY_WORDS = ("不构成犯罪", "不认定为犯罪", "没有犯罪事实", "不认为是犯罪", "不具有犯罪事实", "情节显著轻微、危害不大",
                   "情节显著轻微，危害不大", "不负刑事责任", "已过追诉期限")
INSUFFICIENT_WORDS = ("存疑不起诉适用", "证据不足", "事实不清", "现有证据难以证实", "犯罪事实不清", "不符合起诉条件")
DISCRETIONARY_WORDS = ("相对不起诉", "酌定不起诉", "犯罪情节轻微", "犯罪情节较轻", "不需要判处刑罚", "免除刑罚", "免予刑事处罚", "免除处罚")
ADDRESS_SUFFIXES = ("号", "弄", "村", "社", "屯", "队", "街", "路")


def digit_to_chinese(c: Column) -> Column:
    """Numerals of 0 to 9999 (a digit string); others unchanged. 10 to 19 have no leading one; every empty place between
    digits in thousands and hundreds gives its own zero, so 1001 has two."""
    n = F.try_to_number(F.translate(c, "０１２３４５６７８９", "0123456789"), F.lit("9999999999")).cast("long")
    d = F.array(*[F.lit(x) for x in "零一二三四五六七八九"])

    def digit(unit: int) -> Column:
        return F.floor(n / unit).cast("int") % 10

    def name(unit: int) -> Column:
        return F.get(d, digit(unit))

    rest = n % 10 > 0
    thousands = F.when(n >= 1000, F.concat(name(1000), F.lit("千"))).otherwise(F.lit(""))
    hundreds = F.when(digit(100) > 0, F.concat(name(100), F.lit("百"))).when(
        (n >= 1000) & (n % 100 > 0), F.lit("零")).otherwise(F.lit(""))
    tens = F.when((n >= 10) & (n < 20), F.lit("十")).when(digit(10) > 0, F.concat(name(10), F.lit("十"))).when(
        (n >= 100) & rest, F.lit("零")).otherwise(F.lit(""))
    ones = F.when(rest, name(1)).otherwise(F.lit(""))
    return F.when(n.isNull() | (n > 9999), c).when(n == 0, F.lit("零")).otherwise(F.concat(thousands, hundreds, tens, ones))


def let(c: Column, body) -> Column:
    """body(c) with c computed once, however often body refers to it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def normalize_article(c: Column) -> Column:
    """Digit runs (of any script's digits) as numerals, with the ordinal mark in front."""
    parts = F.regexp_extract_all(strip(c), F.lit(r"(?U)\d+|\D+"), F.lit(0))
    out = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"(?U)^\d"), digit_to_chinese(x)).otherwise(x)), "")
    return let(out, lambda x: F.when(x.startswith("第"), x).otherwise(F.concat(F.lit("第"), x)))


def normalize_label(c: Column) -> Column:
    """One of the labels, or null; bold marks and one final stop are dropped."""
    x = strip(sub(F.replace(strip(c), F.lit("**"), F.lit("")), "。$"))
    return let(x, lambda y: F.when(y.isin(*LABELS), y))


def lenient_label(c: Column) -> Column:
    """As normalize_label, but any run of final punctuation is dropped."""
    x = sub(F.replace(strip(c), F.lit("**"), F.lit("")), r"(?U)[。；;，,、\s]+$")
    return F.when(x.isin(*LABELS), x)


def to_level1(c: Column) -> Column:
    return F.when(c.isin(DISCRETIONARY, STATUTORY, INSUFFICIENT), F.lit("不起诉")).otherwise(F.lit(PROSECUTION))


def decision_type(c: Column) -> Column:
    """The kind of non-prosecution that a reasoning states, or null: paragraphs cited first, then words, by rank."""
    p177 = r"(?:一百七十七|一百七七|177)\s*条?\s*(?:之规定\s*)?"
    law = r"(?d)刑事诉讼法》?.{0,50}"
    first = c.rlike(law + p177 + r"第?[一1][款项]")
    second = c.rlike(p177 + r"(?:第?[二2]\s*款|之二)")

    def any_of(words: tuple[str, ...]) -> Column:
        return c.rlike("|".join(words))

    return (
        F.when(first & second, F.lit(None).cast("string"))
        .when(first | c.rlike(law + "第(?:十六|16)条"), F.lit(STATUTORY))
        .when(any_of(STATUTORY_WORDS) | c.rlike("不构成[一-龥、]{2,20}罪"), F.lit(STATUTORY))
        .when(c.rlike(r"(?:一百七十五|175)\s*条\s*(?:之规定\s*)?第?[四4]\s*款"), F.lit(INSUFFICIENT))
        .when(any_of(INSUFFICIENT_WORDS), F.lit(INSUFFICIENT))
        .when(second | any_of(DISCRETIONARY_WORDS) | c.rlike("情节(?:较为)?(?:轻微|较轻)"), F.lit(DISCRETIONARY))
    )


def anonymize_address(c: Column) -> Column:
    for s in ADDRESS_SUFFIXES:
        c = sub(c, r"(?U)\d{1,4}" + s, r"\*\*" + s)
    return c


def remove_label_leakage(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("被不起诉人"), F.lit("犯罪嫌疑人")), F.lit("被告人"), F.lit("犯罪嫌疑人"))


def strip_think(c: Column) -> Column:
    at = F.locate("</think>", c)
    return strip(F.when(at > 0, F.substring(c, at + 8, F.length(c))).otherwise(c))


def _law(section: Column, name: str, prefix: str) -> Column:
    line = F.regexp_extract(section, f"(?d){name}[：:](.*)", 1)
    return F.transform(split_list(strip(line)), lambda a: F.concat(F.lit(prefix), a))


def answer_articles(c: Column) -> Column:
    """Articles of an answer's section on them, prefixed by law."""
    s = F.regexp_extract(strip_think(c), "(?ds)【适用法条】(.*?)(?=【审查分析】|【最终结论】|$(?!\n))", 1)
    return F.concat(_law(s, "刑法", "cl:"), _law(s, "刑事诉讼法", "cpl:"), _law(s, "刑事诉讼规则", "cpr:"))


def answer_decision(c: Column) -> Column:
    s = F.regexp_extract(strip_think(c), "(?ds)【最终结论】(.*)", 1)
    return strip(F.regexp_extract(s, r"(?dU)决定[：:]\s*(.*)", 1))


def answer_format_ok(c: Column) -> Column:
    """Three tags once each and in order, no other bracketed text, an analysis, a decision that is a label."""
    a = strip_think(c)
    tags = ["【适用法条】", "【审查分析】", "【最终结论】"]
    once = [F.size(F.regexp_extract_all(a, F.lit(t), F.lit(0))) == 1 for t in tags]
    at = [F.locate(t, a) for t in tags]
    analysis = strip(F.regexp_extract(a, "(?ds)【审查分析】(.*?)【最终结论】", 1))
    only = F.size(F.regexp_extract_all(a, F.lit("【[^】]*】"), F.lit(0))) == 3
    return (once[0] & once[1] & once[2] & (at[0] < at[1]) & (at[1] < at[2]) & only & (analysis != "")
            & lenient_label(answer_decision(c)).isNotNull())


def reward(answer: Column, decision: Column) -> Column:
    hit = lenient_label(answer_decision(answer)).eqNullSafe(lenient_label(decision))
    return F.when(~F.coalesce(answer_format_ok(answer), F.lit(False)), F.lit(0.0)).when(hit, F.lit(1.0)).otherwise(F.lit(0.1))


def last_date(c: Column) -> Column:
    """The last Y年M月D日 of a text as an ISO date; null without one."""
    c = F.translate(c, "０１２３４５６７８９", "0123456789")
    d = F.try_element_at(F.regexp_extract_all(c, F.lit(r"\d{4}年\d{1,2}月\d{1,2}日"), F.lit(0)), F.lit(-1))
    p = F.regexp_extract_all(d, F.lit(r"\d+"), F.lit(0))
    return F.when(d.isNotNull(), F.concat_ws("-", F.get(p, F.lit(0)), F.lpad(F.get(p, F.lit(1)), 2, "0"), F.lpad(F.get(p, F.lit(2)), 2, "0")))


def case_id(c: Column) -> Column:
    return F.regexp_extract(c, "[一-龥]+[〔\\[]\\d{4}[〕\\]][A-Za-z]?\\d+号", 0)


def mask(c: Column) -> Column:
    """Personal data of a normalised text: birth dates, identity numbers, phone numbers, e-mail, number plates."""
    year = "((?:18|19|20))\\d{2}年\\s*\\d{1,2}月\\s*\\d{1,2}日"
    c = normalize_block(c)
    c = sub(c, r"(?U)(生于|出生日期[:：]?|出生年月日[:：]?|出生时间[:：]?)\s*" + year, r"$1$2\*\*年\*\*月\*\*日")
    c = sub(c, "(?U)" + year + r"\s*(出生|生)", r"$1\*\*年\*\*月\*\*日$2")
    stars = r"\*" * 18
    c = sub(c, r"(?U)(?<![A-Za-z0-9])[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx](?![A-Za-z0-9])", stars)
    c = sub(c, r"(?U)(?<![A-Za-z0-9*])(?:[1-9]\d{5}|\*{6})(?:(?:18|19|20)\d{2}|\*{4})[\d*]{8}(?![A-Za-z0-9*])", stars)
    phone = "1" + r"\*" * 10
    c = sub(c, r"(?U)(?<!\d)1[3-9]\d{2}\*{3,5}\d{4}(?!\d)", phone)
    c = sub(c, r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)", phone)
    c = sub(c, r"(?U)(?<![\w.%-])([A-Za-z0-9._%+-]{2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![\w.%-])", r"$1\*\*\*@$2")
    return sub(c, r"(?U)(?<![A-Za-z0-9])([京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z])[A-Z0-9]{5,6}(?![A-Za-z0-9])",
               r"$1\*\*\*\*")


# What opens a section, tried from the section before it.
PERSON_START = r"^(?:\d+[.、．]\s*)?(?:被不起诉人|被不起诉单位|被告人|犯罪嫌疑人)"
FACT_STARTS = (
    "经本院依法审查查明", "经依法审查查明", "现依法审查查明", "经本院审查查明", "经本院审查认定", "经审查认定的事实", "经审查认定",
    "检察机关认定", "侦查机关认定的犯罪事实", "公安机关认定的事实", "审查认定事实", "移送机关认定", "起诉意见书认定[：:]",
    "本院依法审查查明", "经审查查明", "经本院依法审查明", "现查明[：:]", "经依法审查认定的犯罪事实", "移送审查起诉事实[：:]",
    "认定.{0,20}的?犯罪行为如下", "经依法侦查查明", "依法审查查明", "依法侦查查明", "经我院(?:依法)?审查查明",
    ".{0,30}移送(?:审查)?起诉认定", ".{0,30}(?:公安局|公安分局|分局).{0,15}(?:移送(?:审查)?起诉)?认定[：:]",
)
FACT_TITLES = ("犯罪事实", "指控事实", "案件事实")
REASONING_STARTS = ("本院(?:审查|仍然?)?认为", "经(?:本院|依法)审查(?:，)?认为", "本院依据",
                    r"经(?:本院|依法)?审查并(?:经)?(?:[一二三四五六七八九两\d]+次)?(?:退回)?补充(?:侦查|调查)")
END_STARTS = (r".{0,10}(?:人民检察院|检察院)\s*$", r"\d{4}年\d{1,2}月\d{1,2}日\s*$")
APPEAL_STARTS = ("被不起诉人如(?:果)?不服", "被害人(?:的?(?:近亲属|法定代理人|家属))?如(?:果)?不服")
SECTIONS = ("header", "person", "procedure", "fact", "reasoning", "end")


def sections(body: Column, doc_type: Column) -> Column:
    """Struct of a document's sections: a fold over its lines that only moves forward; a second opening of the facts
    clears those collected. doc_type is 'prosecution' or another value."""
    def starts(x: Column, patterns) -> Column:
        return x.rlike("(?dU)^(?:" + "|".join(patterns) + ")")

    def step(acc: Column, line: Column) -> Column:
        x, cur = strip(line), acc["cur"]
        appeal = F.when(doc_type == "prosecution", x.startswith("此致")).otherwise(starts(x, APPEAL_STARTS))
        fact = starts(x, FACT_STARTS) | x.isin(*FACT_TITLES)
        new = (
            F.when(x == "", cur)
            .when((cur == 0) & x.rlike("(?U)" + PERSON_START), F.lit(1))
            .when((cur == 1) & x.startswith("本案由"), F.lit(2))
            .when((cur == 2) & fact, F.lit(3))
            .when((cur == 3) & ~fact & starts(x, REASONING_STARTS), F.lit(4))
            .when((cur == 4) & (appeal | starts(x, END_STARTS)), F.lit(5))
            .otherwise(cur)
        )
        reset = (cur == 3) & (x != "") & fact
        return F.struct(
            new.alias("cur"),
            *[F.when(new == i, F.when(reset & F.lit(s == "fact"), F.array(line)).otherwise(F.array_append(acc[s], line)))
              .otherwise(acc[s]).alias(s) for i, s in enumerate(SECTIONS)],
        )

    empty = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).alias("cur"), *[empty.alias(s) for s in SECTIONS])
    return F.aggregate(F.split(body, "\n"), zero, step,
                       lambda acc: F.struct(*[strip(F.array_join(acc[s], "\n")).alias(s) for s in SECTIONS]))
