"""From a document's text to a record, and from a model's reply to labels and verdicts. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import legal as L
from . import records as R
from .text import compact_len, drop_meta_lines, normalize_block, strip, sub

# Words of lines about the page, the titles that open facts, and the lines of a lawyer.
META_WORDS = ("来源：", "作者：", "编辑：", "时间：", "字体：")
FACT_TITLES = ("犯罪事实", "指控事实", "案件事实")
LAWYER = r"(?U)^\s*(?:指定)?辩护人"
# Warnings that reject a document.
REJECTING = ("empty", "doc_type_mismatch", "unclassified_decision", "missing_person", "missing_procedure", "missing_fact",
             "missing_reasoning", "missing_province", "missing_date", "missing_cl", "missing_procedural_law", "fact_contaminated")
CASE_NUMBER = r"[一-龥]+\s*[〔\[（(]\s*\d{4}\s*[〕\]）)]\s*[A-Za-z]?\d+\s*号"


def strip_meta(c: Column, normalized: bool = False) -> Column:
    """Without lines on the page among the first three; stripped, or with blanks normalized too."""
    out = drop_meta_lines(normalize_block(c) if normalized else c, META_WORDS)
    return normalize_block(out) if normalized else strip(out)


def preclean(c: Column) -> Column:
    """Without page lines, and within lines without blanks between Chinese characters and without any ASCII space."""
    line = lambda x: F.replace(sub(x, r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])"), F.lit(" "), F.lit(""))
    return normalize_block(F.array_join(F.transform(F.split(strip_meta(c, True), "\n"), line), "\n"))


def first_case_number(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, CASE_NUMBER, 0), F.lit(" "), F.lit(""))


def clean_case_number(c: Column) -> Column:
    """The case number behind the document's title, the office's name, and a charge in the first half; else any in the whole."""
    x = F.when(F.contains(c, F.lit("不起诉决定书")), F.substring_index(c, "不起诉决定书", -1)).otherwise(F.substring_index(c, "起诉书", -1))
    x = F.substring_index(x, "人民检察院", -1)

    def behind_charge(y: Column) -> Column:
        lead = F.regexp_extract(y, "(?s)^(.*?[罪案])[一-鿿]", 1)
        return F.when((lead != "") & ((F.length(lead) - 1) * 2 < F.length(y) - F.length(y) % 2), F.substr(y, F.length(lead) + 1)).otherwise(y)

    own, whole = first_case_number(L.let(x, behind_charge)), first_case_number(c)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(whole, F.lit("")), c)


def late_date(c: Column) -> Column:
    """The last date of the last 500 characters, blanks within allowed; none: empty."""
    tight = sub(F.right(c, F.lit(500)), r"(?U)(?<=[\d年月])\s+(?=[\d年月日])")
    return F.coalesce(L.last_date(tight), F.lit(""))


def identify(c: Column) -> Column:
    """Struct case_number, doc_type, date of a fetched page's text; null if it is no such document."""
    number = clean_case_number(first_case_number(c))
    head = F.left(c, F.lit(2000))
    refusal = F.contains(head, F.lit("不起诉决定书")) | F.contains(head, F.lit("不起诉")) & ~F.contains(head, F.lit("起诉书"))
    kind = F.when(refusal, F.lit("不起诉")).when(
        F.contains(head, F.lit("起诉书")) | F.contains(F.left(c, F.lit(5000)), F.lit("提起公诉")), F.lit("起诉"))
    fit = (F.length(c) >= 200) & F.contains(c, F.lit("检察院")) & number.contains("检") & number.contains("诉") & kind.isNotNull()
    return F.when(fit, F.struct(number.alias("case_number"), kind.alias("doc_type"), late_date(c).alias("date")))


def kind_of(c: Column, folder: Column) -> Column:
    """prosecution or non_prosecution: by the title among the first six lines, else by the folder."""
    top = F.array_join(F.slice(F.split(F.coalesce(c, F.lit("")), "\n"), 1, 6), "\n")
    return (F.when(F.contains(top, F.lit("不起诉决定书")), F.lit("non_prosecution")).when(F.contains(top, F.lit("起诉书")), F.lit("prosecution"))
            .otherwise(F.when(folder == "起诉", F.lit("prosecution")).otherwise(F.lit("non_prosecution"))))


def parse_document(text: Column, doc_type: Column) -> Column:
    """Struct of a record (id, meta, person_info, procedure, fact, relevant_articles, decision, raw_reasoning_and_decision)
    with its warnings; null for a blank text. Each step is computed once."""
    def record(s: Column) -> Column:
        person = F.array_join(F.filter(F.split(s["person"], "\n"), lambda x: ~x.rlike(LAWYER)), "\n")
        fact = sub(s["fact"], "(?dU)^.*?(?:" + "|".join((*R.FACT_LEAD, *FACT_TITLES)) + r")[，,：:\s]*")
        return F.struct(
            s["id"].alias("id"), s["header"].alias("header"), F.coalesce(L.last_date(s["end"]), F.lit("")).alias("date"),
            R.header_province(s["header"]).alias("province"), L.remove_label_leakage(L.anonymize_address(strip(person))).alias("person"),
            L.remove_label_leakage(s["procedure"]).alias("procedure"), L.remove_label_leakage(fact).alias("fact"), s["reasoning"].alias("reasoning"))

    def judged(r: Column) -> Column:
        return F.struct(r.alias("r"), R.cited_articles(r["reasoning"]).alias("articles"),
                        F.when(doc_type == "prosecution", F.lit(L.PROSECUTION)).otherwise(L.decision_type(r["reasoning"])).alias("decision"))

    def full(j: Column) -> Column:
        r = j["r"]
        fields = {k: r[k] for k in ("header", "person", "procedure", "fact", "reasoning", "province", "date")}
        told = R.warnings(fields | {"doc_type": doc_type, "articles": j["articles"], "decision": j["decision"]})
        return F.struct(
            r["id"].alias("id"), F.struct(r["date"].alias("date"), r["province"].alias("province")).alias("meta"), r["person"].alias("person_info"),
            r["procedure"].alias("procedure"), r["fact"].alias("fact"), j["articles"].alias("relevant_articles"), j["decision"].alias("decision"),
            r["reasoning"].alias("raw_reasoning_and_decision"), told.alias("warnings"))

    def cut(body: Column) -> Column:
        s = L.sections(body, doc_type)
        return L.let(s, lambda x: F.struct(L.case_id(body).alias("id"), *[x[k].alias(k) for k in ("header", "person", "procedure", "fact", "end")],
                                           R.reasoning_tail(x["reasoning"]).alias("reasoning")))

    whole = L.let(L.let(L.let(L.let(strip_meta(text), cut), record), judged), full)
    return F.when(strip(text) != "", whole)


def rejected(warnings: Column) -> Column:
    return F.arrays_overlap(warnings, F.array(*[F.lit(w) for w in REJECTING]))


def fallback_record(model: dict[str, Column], rule: dict[str, Column], doc_type: Column, text: Column, least_fact: int = 60) -> dict[str, Column]:
    """Fields of a record by a model, each from the rules where it is missing, too short, or contaminated."""
    out = {k: R.prefer(model[k], rule[k], 1) for k in ("person_info", "procedure")}
    own = R.clean_fact(model["fact"])
    out["fact"] = F.when(R.fact_contaminated(own) & (R.clean_fact(rule["fact"]) != ""), R.clean_fact(rule["fact"])).otherwise(
        R.prefer(own, R.clean_fact(rule["fact"]), least_fact))
    out["reasoning"] = R.prefer(R.clean_reasoning(model["reasoning"]), R.clean_reasoning(rule["reasoning"]), 1)
    out["date"] = F.coalesce(F.nullif(R.iso_date(model["date"]), F.lit("")), F.nullif(R.iso_date(rule["date"]), F.lit("")), L.last_date(text), F.lit(""))
    out["province"] = R.province(model["province"], rule["province"], text)
    articles = R.prefixed_articles(model["articles"])
    out["articles"] = F.when(F.size(articles) > 0, articles).otherwise(F.coalesce(rule["articles"], F.array().cast("array<string>")))
    out["decision"] = R.expected_decision(doc_type, out["reasoning"], rule["decision"], model["decision"])
    out["source_url"] = F.coalesce(F.nullif(R.page_address(model["source_url"]), F.lit("")), R.first_address(text))
    return out


def masked_fields(model: dict[str, Column], base: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Text fields as a model masked them (where it gave them, else as they were), masked by rule too; and the sorted issues."""
    out = {k: R.mask_all(F.coalesce(model[k], base[k], F.lit(""))) for k in base}
    missing = F.array(*[F.when(model[k].isNull(), F.lit(f"missing_{k}")) for k in base])
    return out, F.array_sort(F.array_distinct(F.concat(F.array_compact(missing), R.residue(*out.values()))))


def last_balanced_object(c: Column) -> Column:
    """The last outermost balanced braces of a text; null without any."""
    tokens = F.regexp_extract_all(c, F.lit(r'(?s)"(?:[^"\\]|\\.)*+(?:"|\\?$)|[{}]|[^"{}]++|"'), F.lit(0))
    zero = F.struct(*[F.lit(0).alias(k) for k in ("depth", "at", "open", "low", "high")])

    def step(a: Column, t: Column) -> Column:
        up, down = t == "{", (t == "}") & (a["depth"] > 0)
        closes = down & (a["depth"] == 1)
        at = a["at"] + F.length(t)
        return F.struct(
            (a["depth"] + F.when(up, 1).when(down, -1).otherwise(0)).alias("depth"), at.alias("at"),
            F.when(up & (a["depth"] == 0), a["at"]).otherwise(a["open"]).alias("open"),
            F.when(closes, a["open"]).otherwise(a["low"]).alias("low"), F.when(closes, at).otherwise(a["high"]).alias("high"))

    return L.let(F.aggregate(tokens, zero, step), lambda e: F.when(e["high"] > 0, F.substr(c, e["low"] + 1, e["high"] - e["low"])))


def reply_object(c: Column, order: str = "last") -> Column:
    """The JSON object of a model's reply, as text, or null. order "last": the whole, the last balanced braces, the first
    ones, then without code fences; "span": without fences, the whole, then from the first brace to the last."""
    def pick(x: Column) -> Column:
        plain = strip(sub(x, r"(?U)```(?:json)?\s*\n?"))
        if order == "last":
            tries = F.array(x, last_balanced_object(x), R.balanced_object(x), plain)
        else:
            tries = F.array(plain, x, F.regexp_extract(plain, r"(?s)\{.*\}", 0))
        return F.get(F.filter(F.transform(tries, strip), lambda t: F.coalesce(t.startswith("{"), F.lit(False)) & R.parses(t)), F.lit(0))

    return L.let(strip(F.translate(L.strip_think(c), "﻿", "")), pick)


def verdict(reply: Column, criteria: tuple[str, ...], spans: str | None = None) -> Column:
    """Struct flagged, violations, issues, spans of a judge's JSON object: a criterion is {"compliant": ...} or the bare
    answer; one that is missing or unclear counts as violated, and as an issue."""
    def judged(v: Column) -> Column:
        def answer(k: str) -> Column:
            inner = F.try_variant_get(v, f"$.{k}.compliant", "string")
            return R.yes_or_no(F.coalesce(inner, F.try_variant_get(v, f"$.{k}", "string")))

        answers = F.array(*[F.struct(F.lit(k).alias("k"), answer(k).alias("ok")) for k in criteria])
        found = F.try_variant_get(v, f"$.{spans}.leakage_spans", "array<string>") if spans else F.lit(None).cast("array<string>")
        texts = F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), strip), lambda x: x != "")
        return L.let(answers, lambda a: F.struct(
            F.exists(a, lambda x: ~F.coalesce(x["ok"], F.lit(False))).alias("flagged"),
            F.transform(F.filter(a, lambda x: ~F.coalesce(x["ok"], F.lit(False))), lambda x: x["k"]).alias("violations"),
            F.array_sort(F.transform(F.filter(a, lambda x: x["ok"].isNull()), lambda x: F.concat(F.lit("missing_or_bad_"), x["k"]))).alias("issues"),
            texts.alias("spans")))

    return L.let(F.try_parse_json(reply), judged)


def split_labels(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[、，,;；/\n]+"), strip), lambda x: x != "")


def predicted_labels(reply: Column, forms: Column) -> Column:
    """Labels that a reply states, each once, in order. forms: map of compact forms to labels. Stated are the list or
    string under accusation, 罪名 or charges of a JSON object, a JSON list, what follows such a name, or the whole reply. An
    item that is no label as a whole is split."""
    def filled(x: Column) -> Column:
        return F.when(F.size(x) > 0, x)

    def under(v: Column, path: str) -> Column:
        items = F.try_variant_get(v, path, "array<string>")
        return F.coalesce(filled(F.array_compact(items)), F.when(items.isNull(), split_labels(F.try_variant_get(v, path, "string"))))

    def stated(x: Column) -> Column:
        named = F.regexp_extract(x["raw"], r"(?is)(?:accusation|罪名|预测罪名)\s*[:：]\s*(.*)", 1)
        listed = F.try_variant_get(x["v"], "$", "array<string>")
        return F.coalesce(*[filled(under(x["v"], p)) for p in ("$.accusation", "$['罪名']", "$.charges")], filled(listed),
                          filled(split_labels(named)), split_labels(x["raw"]))

    def match(item: Column) -> Column:
        parts = F.transform(split_labels(item), lambda p: F.try_element_at(forms, R.compact_label(p)))
        return L.let(F.try_element_at(forms, R.compact_label(item)), lambda whole: F.when(
            whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(parts)))

    def read(raw: Column) -> Column:
        fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
        v = F.try_parse_json(F.when(fenced != "", strip(fenced)).otherwise(raw))
        return L.let(F.struct(raw.alias("raw"), v.alias("v")), stated)

    return F.array_distinct(F.flatten(F.transform(L.let(L.strip_think(reply), read), match)))


def length_ok(c: Column, least: int) -> Column:
    return compact_len(F.coalesce(c, F.lit(""))) >= least
