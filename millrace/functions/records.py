"""Rules for the fields of a case record: places, dates, addresses of pages, articles, charges, issues, residue, JSON.

Null in, null out, unless said otherwise; every rule is a column expression, so that a scan stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import legal
from .text import compact_len, normalize_block, strip, sub

# Provinces, short name and full name, in the order in which they are tried.
PROVINCES = (
    ("北京", "北京市"), ("天津", "天津市"), ("上海", "上海市"), ("重庆", "重庆市"), ("河北", "河北省"), ("山西", "山西省"),
    ("辽宁", "辽宁省"), ("吉林", "吉林省"), ("黑龙江", "黑龙江省"), ("江苏", "江苏省"), ("浙江", "浙江省"), ("安徽", "安徽省"),
    ("福建", "福建省"), ("江西", "江西省"), ("山东", "山东省"), ("河南", "河南省"), ("湖北", "湖北省"), ("湖南", "湖南省"),
    ("广东", "广东省"), ("海南", "海南省"), ("四川", "四川省"), ("贵州", "贵州省"), ("云南", "云南省"), ("陕西", "陕西省"),
    ("甘肃", "甘肃省"), ("青海", "青海省"), ("广西", "广西壮族自治区"), ("内蒙古", "内蒙古自治区"), ("西藏", "西藏自治区"),
    ("宁夏", "宁夏回族自治区"), ("新疆", "新疆维吾尔自治区"),
)
# An article as cited, what negates a citation, and the law names by prefix.
ARTICLE = (r"第?[零一二三四五六七八九十百千\d]+条(?:之[一二三四五六七八九十\d]+)?(?:第[一二三四五六七八九十\d]+款)?"
           r"(?:第[（(]?[一二三四五六七八九十\d]+[）)]?项)?")
NEGATION = "不(?:属于|符合|构成|适用|是)"
LAWS = (("cl:", "《刑法》"), ("cl:", "《中华人民共和国刑法》"), ("cpl:", "《刑事诉讼法》"), ("cpl:", "《中华人民共和国刑事诉讼法》"),
        ("cpr:", "《人民检察院刑事诉讼规则》"))
LAW_NAMES = (("cpr:", "刑事诉讼规则"), ("cpl:", "刑事诉讼法"), ("cl:", "刑法"))
# Words that give a decision away, that spoil a statement of facts, and that open a list of evidence.
LEAKAGE_WORDS = ("被不起诉人", "被告人", "不起诉决定书", "决定不起诉", "提起公诉", "决定起诉", "相对不起诉", "法定不起诉", "存疑不起诉")
CONTAMINATION = "本院认为|依照《|根据《|决定对|决定不起诉|提起公诉|不符合起诉条件|证据不足|情节显著轻微"
EVIDENCE_MARK, EVIDENCE_LAWFUL = "认定上述事实的证据如下", "上述证据收集程序合法"
# Lead-ins of facts, and lines after which a reasoning has ended.
FACT_TITLE = r"^(?:犯罪事实|指控事实|案件事实)[，,：:\s]*"
FACT_LEAD = ("经本院依法审查(?:查)?明", "本院依法审查查明", "(?:经|现)依法(?:审查|侦查)查明", "经本院审查(?:查明|认定(?:的事实)?)",
             "经我院(?:依法)?审查查明", "经审查(?:查明|认定(?:的事实)?)", "经依法审查认定的犯罪事实(?:如下)?", "依法(?:审查|侦查)查明",
             "(?:检察|侦查|公安)机关认定的?(?:犯罪|案件)?事实", "(?:公安局|公安分局|分局).{0,15}(?:移送(?:审查)?起诉)?认定", "审查认定事实",
             "移送(?:审查)?起诉(?:认定|事实)", "移送机关认定", "起诉意见书认定", "现查明", "认定.{0,20}的?犯罪行为如下")
REASONING_ENDS = ("此致", "附件：", "附：", "检察官", "检 察 官", "检  察  官", "书记员", "被不起诉人如", "被害人如")
# Where police documents name a charge, and how names and odd forms are reduced.
CHARGE_PROCEDURE = r"涉嫌(?:犯有)?([^，,。；;\n]+?罪)"
CHARGE_CASE = r"侦查终结，以犯罪嫌疑人[^，,。；;\n]*?(?:涉嫌([^，,。；;\n]+?罪)|([一-鿿、\[\]（）()]{2,40}?(?:案|罪)))[，,]"
CHARGE_PERSON = r"因涉嫌(?:犯有)?([^，,。；;\n]+?罪)"
CHARGE_OPINION = r"(?:公安局|公安机关)[^。；;\n]{0,80}?(?:认为|认定)[^。；;\n]{0,50}?(?:构成|涉嫌)(?:犯有)?([^，,。；;\n]+?罪)"
CHARGE_NOISE = r"（另案处理）|等人|等\d+人|等人?涉嫌"
CHARGE_NAME = r"^(?:[一-鿿]{1,4}某[甲乙丙丁\d]?|[一-鿿]{1,2}某)+"
CHARGE_TAIL = r'[一-鿿㐀-䶿豈-﫿、\[\]（）()《》""]{2,50}?罪$'
CHARGE_ALIASES = (("帮助信息网络犯罪", "帮助信息网络犯罪活动罪"), ("掩饰、隐瞒犯罪", "掩饰、隐瞒犯罪所得罪"), ("掩饰隐瞒犯罪", "掩饰、隐瞒犯罪所得罪"),
                  ("隐瞒犯罪", "掩饰、隐瞒犯罪所得罪"), ("隐瞒犯罪所得", "掩饰、隐瞒犯罪所得罪"))
# Personal data that may be left, and accounts behind their labels.
FULL_ID = r"(?U)(?<![A-Za-z0-9])[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx](?![A-Za-z0-9])"
PARTIAL_ID = r"(?U)(?<![A-Za-z0-9*])(?:[1-9]\d{5}|\*{6})(?:(?:18|19|20)\d{2}|\*{4})[\d*]{8}(?![A-Za-z0-9*])"
MOBILE = r"(?U)(?<!\d)1[3-9](?:\d{9}|\d{2}\*{3,5}\d{4})(?!\d)"
BIRTH_DATE = (r"(?U)(?:生于|出生日期[:：]?|出生年月日[:：]?|出生时间[:：]?)\s*(?:18|19|20)\d{2}年\s*\d{1,2}月\s*\d{1,2}日"
              r"|(?:18|19|20)\d{2}年\s*\d{1,2}月\s*\d{1,2}日\s*(?:出生|生)")
ACCOUNT = (r"(?U)((?:银行卡(?:号)?|银行账号|卡号|账号|账户号|支付宝(?:账号|账户)?|微信(?:号|账号)?|QQ号|快递单号|物流号|运单号|收件电话|联系电话|联系方式"
           r"|手机号码|手机号|电话)\s*[为是:：]?\s*)([A-Za-z0-9][A-Za-z0-9_@.\-*]{4,})")
ADDRESS_NUMBER = "(?U)\\d{1,5}(?=号楼|栋|幢|单元|室|房|号|组)"
# Lines of a PDF that begin a paragraph.
PDF_START = (r"(?dU)^(?:[一-鿿]{2,20}人民检察院\s*$|不起诉决定书|起诉书|[一-鿿]+\s*[〔\[【]\s*\d{4}|(?:\d+[.、]\s*)?(?:被不起诉人|被告人|犯罪嫌疑人|被不起诉单位)"
             r"|辩护人|指定辩护人|本案由|经本院|经依法|现依法|经我院|经审查|依法审查|本院认为|本院审查认为|经本院审查|被不起诉人如不服|被害人.*?如不服"
             r"|认定上述事实|证明上述|综上|据此|此致|\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)")
# What a model may write for yes and no.
YES, NO = ("true", "yes", "1", "是", "满足", "合规", "compliant"), ("false", "no", "0", "否", "不满足", "违反", "不合规", "non-compliant")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_province(c: Column, *suffixes: str) -> Column:
    """Full name of the first province in list order whose short name (with one of the suffixes) a text holds."""
    known = F.array(*[F.struct(F.lit(s).alias("short"), F.lit(f).alias("full")) for s, f in PROVINCES])

    def held(p: Column) -> Column:
        found = F.lit(False)
        for s in suffixes or ("",):
            found = found | F.contains(c, F.concat(p["short"], F.lit(s)))
        return found

    return F.get(F.filter(known, held), F.lit(0))["full"]


def _full_province(c: Column) -> Column:
    names = F.array(*[F.lit(f) for _, f in PROVINCES])
    return F.get(F.filter(names, lambda f: F.contains(c, f)), F.lit(0))


def header_province(c: Column) -> Column:
    """A province that a header names in full, else by its short name and 省 or 市; none: empty."""
    return F.coalesce(_full_province(c), _first_province(c, "省", "市"), F.lit(""))


def province(value: Column, fallback: Column, text: Column) -> Column:
    """The stated province, else a full name given as fallback, else one in the first eight lines; none: empty."""
    head = F.array_join(F.slice(F.split(_text(text), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"), 1, 8), "\n")
    other = normalize_block(fallback)
    return F.coalesce(_first_province(normalize_block(value)), F.when(other.isin(*[f for _, f in PROVINCES]), other),
                      _full_province(head), _first_province(head), F.lit(""))


def iso_date(c: Column) -> Column:
    """An ISO date as it is, else the first date in figures as one; none: empty."""
    x = normalize_block(c)
    pattern = r"(\d{4})[年/\-.](\d{1,2})[月/\-.](\d{1,2})日?"
    made = F.concat_ws("-", F.regexp_extract(x, pattern, 1), *[F.lpad(F.regexp_extract(x, pattern, k), 2, "0") for k in (2, 3)])
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x).when(x.rlike(pattern), made).otherwise(F.lit(""))


def page_address(c: Column) -> Column:
    """An http address without closing punctuation; another value: empty."""
    x = sub(normalize_block(c), r"[，。；,;）)\]】》]+$")
    return F.when(x.rlike("^https?://"), x).otherwise(F.lit(""))


def first_address(c: Column) -> Column:
    return page_address(F.regexp_extract(c, r"(?U)https?://[^\s<>\"]+", 0))


def cited_articles(c: Column) -> Column:
    """Articles that a reasoning cites right behind a law's name, prefixed, by law and then by place.

    The text is split at the name. A citation is void if, of the ten characters before the name, the first negation
    has no punctuation behind it; three pieces hold these ten characters, whatever stands between two names.
    """
    found = []
    for prefix, name in LAWS:
        parts = F.split(c, name)
        void = f"(?s)^(?:(?!{NEGATION}).)*{NEGATION}[^，。；！？]*$"
        chain = f"(?U)^\\s*({ARTICLE}(?:[、，和及]{ARTICLE})*)"
        places = F.transform(parts, lambda x, i: F.struct(
            F.right(F.array_join(F.slice(parts, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), name), F.lit(10)).alias("before"),
            F.when(i > 0, F.regexp_extract(x, chain, 1)).otherwise(F.lit("")).alias("chain")))  # noqa: B023
        valid = F.filter(places, lambda p: (p["chain"] != "") & ~p["before"].rlike(void))  # noqa: B023
        each = F.flatten(F.transform(valid, lambda p: F.regexp_extract_all(p["chain"], F.lit(ARTICLE), F.lit(0))))
        found.append(F.transform(each, lambda a: F.concat(F.lit(prefix), legal.normalize_article(a))))  # noqa: B023
    return F.array_distinct(F.concat(*found))


def prefixed_articles(items: Column) -> Column:
    """Items of a list with their law as a prefix; those of no known law go, repeats too."""
    def one(item: Column) -> Column:
        x = normalize_block(item)
        out = F.when(x.rlike("^(?:cl|cpl|cpr):"), x)
        for prefix, name in LAW_NAMES:
            out = out.when(F.contains(x, F.lit(name)), F.concat(F.lit(prefix), sub(sub(x, f"(?d)^.*?{name}》?"), "^[：:]+")))
        return out

    return F.array_distinct(F.filter(F.transform(items, one), lambda x: x.isNotNull()))


def grouped_articles(items: Column) -> Column:
    """A line for each law with its articles, others last; none: 无."""
    lines, known = [], F.lit(False)
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), strip)
    for prefix, label in (("cl:", "刑法"), ("cpl:", "刑事诉讼法"), ("cpr:", "刑事诉讼规则"), (None, "其他")):
        if prefix:
            own = F.transform(F.filter(trimmed, lambda x: x.startswith(prefix)), lambda x: strip(F.substr(x, F.lit(len(prefix) + 1))))  # noqa: B023
        else:
            own = F.filter(trimmed, lambda x: ~x.rlike("^(?:cl|cpl|cpr):"))
        lines.append(F.when(F.size(own) > 0, F.concat(F.lit(label + "："), F.array_join(own, "、"))))
    return F.when(F.size(trimmed) == 0, F.lit("无")).otherwise(F.concat_ws("\n", *lines))


def clean_fact(c: Column) -> Column:
    """Facts without a title in front and without their first lead-in."""
    x = sub(normalize_block(c), "(?U)" + FACT_TITLE)
    return normalize_block(sub(x, "(?dU)^.*?(?:" + "|".join(FACT_LEAD) + r")[，,：:\s]*"))


def reasoning_tail(c: Column) -> Column:
    """Without a date, a seal and an office's name at the end, in that order."""
    for end in (r"\d{4}年\d{1,2}月\d{1,2}日", "[（(]院印[）)]", "[一-龥]{2,30}人民检察院"):
        c = strip(sub(c, rf"(?U)\s*{end}\s*$"))
    return c


def clean_reasoning(c: Column) -> Column:
    """From the opinion on (without one: the line of the further inquiry) to the first closing line; name, seal, date go."""
    x = normalize_block(c)
    inquiry = F.regexp_extract(x, r"(?dU)经(?:本院|依法)?审查并(?:经)?(?:[一二三四五六七八九两\d]+次)?(?:退回)?补充(?:侦查|调查).*", 0)
    at = F.locate("本院认为", x)
    x = F.when(at > 0, F.substr(x, at)).when(inquiry != "", inquiry).otherwise(x)
    x = sub(x, r"(?s)\n(?:" + "|".join(REASONING_ENDS) + ").*$")
    for end in ("[一-龥]{2,30}人民检察院", "[（(]院印[）)]", r"\d{4}年\d{1,2}月\d{1,2}日"):
        x = strip(sub(x, rf"(?U)\n{end}\s*$"))
    return normalize_block(x)


def prefer(primary: Column, fallback: Column, least: int) -> Column:
    """The first text, unless it is empty, or shorter than least and than the other."""
    a, b = normalize_block(primary), normalize_block(fallback)
    return F.when((b != "") & ((a == "") | (compact_len(a) < least) & (compact_len(b) > compact_len(a))), b).otherwise(a)


def leaks_label(c: Column) -> Column:
    return _text(c).rlike("|".join(LEAKAGE_WORDS))


def fact_contaminated(c: Column) -> Column:
    return _text(c).rlike(CONTAMINATION)


def fact_evidence_only(c: Column) -> Column:
    """Whether facts are a list of evidence: it opens them, or fewer than 20 characters stand before it."""
    x = normalize_block(c)
    x = F.when(x.startswith("。"), sub(x, "^[。；;，, ]+")).otherwise(x)
    before = sub(normalize_block(F.substring_index(x, EVIDENCE_MARK, 1)), "^[。；;，, ]+")
    return x.startswith(EVIDENCE_MARK) | x.startswith(EVIDENCE_LAWFUL) | F.contains(x, F.lit(EVIDENCE_MARK)) & (compact_len(before) < 20)


def expected_decision(doc_type: Column, reasoning: Column, *stated: Column) -> Column:
    """What a record should decide: by kind of document, reasoning, then the stated labels of non-prosecution; none: empty."""
    kinds = (legal.DISCRETIONARY, legal.STATUTORY, legal.INSUFFICIENT)
    return F.coalesce(F.when(doc_type == "prosecution", F.lit(legal.PROSECUTION)), legal.decision_type(reasoning),
                      *[F.when(s.isin(*kinds), s) for s in stated], F.lit(""))


def issues(r: dict[str, Column], least_fact: int = 60) -> Column:
    """Issue codes of a record, in a fixed order. r: doc_type, person_info, procedure, fact, reasoning, decision, date,
    province, articles, source_url; a null field is missing."""
    def has(name: str) -> Column:
        return _text(r[name]) != ""

    fact, expected = _text(r["fact"]), expected_decision(r["doc_type"], r["reasoning"], r["decision"])
    cites = _text(r["reasoning"]).rlike("刑法|刑事诉讼法|刑事诉讼规则")
    rules = [
        ("missing_person", ~has("person_info")), ("missing_procedure", ~has("procedure")), ("missing_fact", ~has("fact")),
        ("missing_reasoning", ~has("reasoning")), ("short_fact", has("fact") & (compact_len(fact) < least_fact)),
        ("fact_evidence_only", fact_evidence_only(fact)), ("decision_empty", ~has("decision")),
        ("decision_mismatch", (expected != "") & (_text(r["decision"]) != expected)), ("missing_date", ~has("date")),
        ("missing_province", ~has("province")), ("missing_articles", cites & (F.coalesce(F.size(r["articles"]), F.lit(0)) <= 0)),
        ("fact_contaminated", fact_contaminated(fact)), ("label_leakage_in_person_info", leaks_label(r["person_info"])),
        ("label_leakage_in_procedure", leaks_label(r["procedure"])), ("label_leakage_in_fact", leaks_label(fact)),
        ("bad_source_url", has("source_url") & (page_address(r["source_url"]) == "")),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def warnings(r: dict[str, Column]) -> Column:
    """Warnings on an extracted document. A wrong kind hides the rest, and of missing sections only the first is told.
    r: doc_type, header, person, procedure, fact, reasoning, province, decision, articles, date."""
    has = {k: _text(r[k]) != "" for k in ("person", "procedure", "fact", "reasoning", "province", "date")}
    top = F.slice(F.split(_text(r["header"]), "\n"), 1, 6)
    first = F.array_join(top, "\n")
    wrong = F.when(r["doc_type"] == "prosecution", F.exists(top, lambda x: strip(x).startswith("不起诉决定书"))).otherwise(
        F.contains(first, F.lit("起诉书")) & ~F.contains(first, F.lit("不起诉")))
    order = ("person", "procedure", "fact", "reasoning")
    empty = ~(has["person"] | has["procedure"] | has["fact"] | has["reasoning"])
    open_ = ~wrong & ~empty
    full = open_ & has["person"] & has["procedure"] & has["fact"] & has["reasoning"]
    missing = F.lit(None).cast("string")
    for k in reversed(order):
        missing = F.when(~has[k], F.lit("missing_" + k)).otherwise(missing)

    def cites(*prefixes: str) -> Column:
        return F.exists(F.coalesce(r["articles"], F.array().cast("array<string>")), lambda a: a.rlike("^(?:" + "|".join(prefixes) + "):"))

    wants = (r["doc_type"] == "prosecution") | F.coalesce(r["decision"] == legal.DISCRETIONARY, F.lit(False))
    law = "《(?:中华人民共和国)?(?:刑法|刑事诉讼法)》|《人民检察院刑事诉讼规则》"
    return F.array_compact(F.array(
        F.when(wrong, F.lit("doc_type_mismatch")), F.when(empty, F.lit("empty")), F.when(open_ & ~has["province"], F.lit("missing_province")),
        F.when(open_, missing), F.when(full & r["decision"].isNull(), F.lit("unclassified_decision")),
        F.when(full & _text(r["fact"]).rlike(law), F.lit("fact_contaminated")),
        F.when(full & ~cites("cpl", "cpr"), F.lit("missing_procedural_law")), F.when(full & wants & ~cites("cl"), F.lit("missing_cl")),
        F.when(full & ~has["date"], F.lit("missing_date"))))


def compact_label(c: Column) -> Column:
    """A charge without spaces, quotes, final punctuation and one final 罪."""
    return sub(sub(F.translate(strip(c), ' 　“”"《》', ""), r"(?U)[。；;，,、：:\s]+$"), "罪$")


def label_forms(c: Column) -> Column:
    """Sorted forms of a charge: each bracketed list expanded to each of its items, and the charge with and without brackets."""
    x = compact_label(c)
    group = r"(?s)(.*?)\[([^\]]+)\]"
    pairs = F.arrays_zip(F.regexp_extract_all(x, F.lit(group), F.lit(1)).alias("lead"), F.regexp_extract_all(x, F.lit(group), F.lit(2)).alias("items"))

    def step(made: Column, p: Column) -> Column:
        items = F.filter(F.split(p["items"], "[、,，/]"), lambda i: i != "")
        return F.flatten(F.transform(made, lambda m: F.transform(items, lambda i: F.concat(m, p["lead"], i))))

    rest = sub(x, r"(?s)^.*\[[^\]]+\]")
    made = F.aggregate(pairs, F.array(F.lit("")), step)
    return F.array_sort(F.array_distinct(F.concat(F.transform(made, lambda m: F.concat(m, rest)), F.array(x, F.translate(x, "[]", "")))))


def normalize_charge(c: Column) -> Column:
    """A charge without names, noise and what stands before it, under its full name, with 罪 at its end."""
    x = sub(sub(sub(c, r"(?U)\s+"), "^[、,，;；]+"), CHARGE_NOISE)
    x = sub(sub(F.substring_index(x, "涉嫌", -1), "^犯有"), CHARGE_NAME)  # the greedy run of names leaves none in front
    tail = F.regexp_extract(x, CHARGE_TAIL, 0)
    x = sub(F.when(tail != "", tail).otherwise(x), "案$", "罪")
    full = F.create_map(*[F.lit(v) for pair in CHARGE_ALIASES for v in pair])
    x = F.coalesce(F.try_element_at(full, x), x)
    return F.when((x == "") | x.endswith("罪"), x).otherwise(F.concat(x, F.lit("罪")))


def police_charges(procedure: Column, person: Column, fact: Column) -> Column:
    """Charges by the police, from the first of four places that has a valid one; in order, without repeats."""
    def charges(raw: Column) -> Column:
        def parts(x: Column) -> Column:
            y = sub(strip(x), "^[、,，;；]+")
            named = F.regexp_extract_all(y, F.lit("[^、,，;；]+?罪"), F.lit(0))
            return F.when(F.size(named) > 0, named).otherwise(F.array(y))

        made = F.transform(F.flatten(F.transform(raw, parts)), normalize_charge)
        return F.array_distinct(F.filter(made, lambda x: x.endswith("罪") & (F.length(x) >= 3) & ~F.contains(x, F.lit("某")) & ~x.startswith("、")))

    def every(c: Column, pattern: str) -> Column:
        return charges(F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(1)))

    case = [F.regexp_extract(_text(procedure), CHARGE_CASE, k) for k in (1, 2)]
    once = charges(F.filter(F.array(F.when(case[0] != "", case[0]).otherwise(case[1])), lambda x: x != ""))
    places = (every(procedure, CHARGE_PROCEDURE), once, every(person, CHARGE_PERSON), every(fact, CHARGE_OPINION))
    return F.coalesce(*[F.when(F.size(p) > 0, p) for p in places], F.array().cast("array<string>"))


def mask_account(c: Column) -> Column:
    """One account: phone numbers by their first digit, figures as asterisks (18 at most), others by first and last."""
    n = F.length(c)
    email = r"(?U)(?<![\w.%-])([A-Za-z0-9._%+-]{2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![\w.%-])"
    return (F.when(F.contains(c, F.lit("@")) & F.contains(c, F.lit(".")), sub(c, email, r"$1\*\*\*@$2"))
            .when(c.rlike(r"^1(?:\*{10}|[3-9][\d*]{9})$"), F.lit("1" + "*" * 10))
            .when(c.rlike(r"^\d{6,}$"), F.repeat(F.lit("*"), F.least(n, F.lit(18))))
            .when(n <= 2, F.repeat(F.lit("*"), n))
            .otherwise(F.concat(F.left(c, F.lit(1)), F.lit("***"), F.right(c, F.lit(1)))))


def mask_accounts(c: Column) -> Column:
    """Accounts behind a label that names them, masked."""
    labels, values = [F.regexp_extract_all(c, F.lit(ACCOUNT), F.lit(k)) for k in (1, 2)]
    masked = F.transform(values, lambda v, i: F.concat(F.get(labels, i), mask_account(v)))
    between = F.split(c, ACCOUNT)
    return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(masked, i), F.lit("")))), "")


def mask_all(c: Column, address_numbers: bool = False) -> Column:
    """All personal data of a text: those of legal.mask, labelled accounts, and numbers of addresses on request."""
    c = mask_accounts(legal.mask(c))
    return sub(c, ADDRESS_NUMBER, r"\*\*") if address_numbers else c


def residue(*texts: Column) -> Column:
    """Codes of personal data left in the texts, taken together."""
    c = F.concat_ws("\n", *[_text(t) for t in texts])
    partial = F.exists(F.regexp_extract_all(c, F.lit(PARTIAL_ID), F.lit(0)), lambda x: x.rlike(r"(?U)\d"))
    return F.array_compact(F.array(
        F.when(c.rlike(FULL_ID) | partial, F.lit("possible_id_card_residue")), F.when(c.rlike(MOBILE), F.lit("possible_mobile_residue")),
        F.when(c.rlike(BIRTH_DATE), F.lit("possible_birth_date_residue"))))


def pdf_text(c: Column) -> Column:
    """Text of a PDF without page numbers, wrapped lines joined, no space beside figures.

    A line begins a paragraph if it looks like one or a blank line stands before it, so no state is carried.
    """
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: ~(x.rlike(r"(?U)^-?\s*\d{1,4}\s*-?$") & (F.length(x) < 10)))
    joined = F.array_join(F.transform(lines, lambda x, i: F.when(
        (x != "") & (x.rlike(PDF_START) | (F.get(lines, i - 1) == "")), F.concat(F.lit("\n"), x)).otherwise(x)), "")
    out = sub(sub(joined, "^\n"), r"(?U)(\d)\s+([年月日时分秒条款项号元])", "$1$2")
    return sub(sub(out, r"(?U)第\s+(\d)", "第$1"), r"(?U)(\d)\s+([、，。；])", "$1$2")


def yes_or_no(c: Column) -> Column:
    """What a model answered as a boolean; null where it is neither."""
    x = F.lower(strip(c))
    return F.when(x.isin(*YES), F.lit(True)).when(x.isin(*NO), F.lit(False))


def balanced_object(c: Column) -> Column:
    """The balanced braces that open at the first brace, braces within quotes apart; null if they never close.

    A regular expression takes quoted strings and single braces in turn; a fold over these few tokens, not over
    characters, finds where the depth returns to zero.
    """
    x = F.substr(c, F.locate("{", c))
    tokens = F.regexp_extract_all(x, F.lit(r'(?s)"(?:[^"\\]|\\.)*+(?:"|\\?$)|[{}]|[^"{}]++'), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(F.struct(
            depth.alias("depth"), (acc["length"] + F.length(t)).alias("length"), (depth == 0).alias("done")))

    end = F.aggregate(tokens, zero, step)
    return F.when((F.locate("{", c) > 0) & end["done"], F.substr(x, F.lit(1), end["length"]))


def parses(c: Column) -> Column:
    """Whether a text is JSON; an object with anything behind it is not."""
    return c.isNotNull() & F.try_parse_json(c).isNotNull() & (~c.startswith("{") | F.coalesce(balanced_object(c) == strip(c), F.lit(False)))


def json_object(c: Column) -> Column:
    """The JSON object in a model's reply, as text: the whole, the first balanced braces, or what a code fence holds; the
    first of them that parses decides, and is null if it's no object."""
    def pick(x: Column) -> Column:
        tries = F.array(x, balanced_object(x), strip(sub(x, r"(?U)```(?:json)?\s*\n?")))
        return legal.let(F.get(F.filter(tries, parses), F.lit(0)), lambda found: F.when(found.startswith("{"), found))

    return legal.let(strip(F.translate(legal.strip_think(c), "﻿", "")), pick)
