"""Queries on curation: dedup, comparison, merges, resuming, sampling, reports, text cleaning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import pages as P
from ..functions import text as X
from ..operators import relational as R
from ..sources.tables import inline, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def dedup_keep_first(spark, sf):
    t = F.lower("text")
    d = _docs(spark, sf).select("doc_id", F.when(t == "", "").otherwise(F.md5(t)).alias("k"))
    return R.keep_first(d, "k", "doc_id")


def dedup_normalized_text(spark, sf):
    t = X.normalize_block(F.col("text"))
    d = _docs(spark, sf).select("doc_id", F.when(t == "", "").otherwise(F.md5(t)).alias("k"))
    return R.keep_first(d, "k", "doc_id")


def dedup_keep_last(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return R.keep_last(c, "conv_id", "turn")


def dedup_ordered_union(spark, sf):
    d = _docs(spark, sf).select(F.md5("text").alias("k"), F.col("doc_id").alias("pos"), F.col("source").alias("record"))
    return R.ordered_union(d, "k", "pos", "record")


def dedup_case_url_key(spark, sf):
    p = table(spark, sf, "pages").select("page_id", X.url_prefix(F.col("url")).alias("site"))
    return R.keep_first(p.where("site is not null"), "site", "page_id", empty_repeats=False)


def compare_full_outer(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_size <= 40").select("p_partkey", F.struct("p_name", "p_brand").alias("rec"))
    b = p.where("p_size >= 10").select("p_partkey", F.struct("p_name", F.when(F.col("p_size") % 7 == 0, "?").otherwise(F.col("p_brand")).alias("p_brand")).alias("rec"))
    return R.compare(a, b, "p_partkey", "rec").groupBy("outcome").agg(F.count("*").alias("n"))


def update_join_protected(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    patch = o.where("o_orderkey % 3 = 0").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"))
    return R.update_join(o, patch, "o_orderkey", ["o_orderstatus"], ["o_orderpriority"])


def flagged_subset_in_order(spark, sf):
    v = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return _docs(spark, sf).join(v, "doc_id").select("doc_id", "source", "n_chars").orderBy("doc_id")


def resume_pending(spark, sf):
    d = R.with_runs(_docs(spark, sf).select("doc_id"), 3)
    done = d.where("(doc_id + run_id) % 4 = 0")
    return R.pending(d, done, ["doc_id", "run_id"])


def resume_missing(spark, sf):
    d = R.with_runs(_docs(spark, sf).select("doc_id"), 3)
    return R.pending(d, d.where("doc_id % 50 <> 0 or run_id <> 2"), ["doc_id", "run_id"]).agg(F.count("*").alias("missing"))


def anti_join_balanced_sample(spark, sf):
    """As many labelled documents of each quality, none that sample_stratified() has drawn."""
    used = sample_stratified(spark, sf).select("doc_id")
    left = R.pending(table(spark, sf, "labels"), used, ["doc_id"])
    left = R.keep_first(left, "doc_id", F.struct("quality", "toxic"), empty_repeats=False)
    low = left.groupBy("quality").agg(F.count("*").alias("n")).agg(F.min("n").alias("k"))
    return R.stratified_rank(left, "quality", "doc_id").join(low, F.col("rank") <= F.col("k")).select("doc_id", "quality", "rank")


def sample_simple(spark, sf):
    return R.sample(_docs(spark, sf).select("doc_id", "lang"), "doc_id", 50)


def sample_stratified(spark, sf):
    return R.stratified_rank(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id").where("rank <= 25")


SPEC = [("a", "en", 30), ("a", "fr", 10), ("b", "en", 60), ("b", "fr", 5), ("b", "de", 20)]


def sample_nested_splits(spark, sf):
    spec = inline(spark, ["split", "lang", "n"], SPEC).withColumn("n", F.col("n").cast("int"))
    return R.nested_splits(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", spec)


def split_by_date(spark, sf):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").groupBy(F.when(d < "1996-01-01", "train").otherwise("test").alias("split")).agg(F.count("*").alias("n"))


def count_by_class_sorted(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "o_orderpriority")


def split_class_pivot(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return c.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


def top_k_first_seen(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_pos"))
    return c.orderBy(F.desc("n"), "first_pos").limit(10)


def explode_prefix_counts(spark, sf):
    w = table(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("w"))
    return w.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


def share_of_total(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 4))


def _issues():
    rules = {"short": F.col("n_chars") < 300, "symbols": F.col("text").rlike(r"[#$%&]{2}"), "link": F.col("text").contains("http"),
             "no_stop": ~F.col("text").contains(".")}
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def issue_array_and_histogram(spark, sf):
    d = _docs(spark, sf).select(F.explode(_issues()).alias("issue"))
    return d.groupBy("issue").agg(F.count("*").alias("n")).orderBy("issue")


def route_by_severity(spark, sf):
    d = _docs(spark, sf).withColumn("i", _issues())
    route = F.when(F.arrays_overlap("i", F.array(F.lit("short"), F.lit("no_stop"))), "issue_log").when(
        F.size("i") > 0, "manual_review").otherwise("processed")
    return d.groupBy(route.alias("route")).agg(F.count("*").alias("n"))


def best_candidate(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    order = F.struct("l_discount", (-F.col("l_quantity")).alias("q"), "l_linenumber")
    return x.groupBy("l_orderkey").agg(F.min_by("l_linenumber", order).alias("best"))


def text_normalize_block(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(X.normalize_block(F.col("text"))).alias("h"))


def text_compact_len(spark, sf):
    return _docs(spark, sf).select("doc_id", X.compact_len(F.col("text")).cast("long").alias("n"))


def text_drop_meta_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(X.drop_meta_lines(F.col("text"), ("License", "Copyright"))).alias("h"))


def text_shorten(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(X.shorten(F.col("text"), 100)).alias("h"))


def mask_email_phone(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(L.mask(F.col("text"))).alias("h"))


def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("h"))


def html_links_same_host(spark, sf):
    """The links of each page to its own host, with or without the host written out, each once."""
    link = P.entries(F.col("html"), F.col("url"), r"""href="(https?://[^"]+|/[^"/][^"]*)\"""")
    return table(spark, sf, "pages").select("page_id", F.explode(link.getField("detail_url")).alias("link"))


def json_props_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def chat_messages_build(spark, sf):
    c = table(spark, sf, "conversations")
    m = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return m.select("conv_id", F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")).alias("h"))


_WS = "[ \\t\\n\\x0b\\f\\r\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
SQL = {
    "dedup_keep_first": """with d as (select doc_id, case when text = '' then '' else md5(lower(text)) end as k from documents)
        select doc_id, k from d qualify row_number() over (partition by k order by doc_id) = 1 or k = ''""",
    "dedup_keep_last": "select conv_id, max_by(role, turn) as role, max(turn) as turn from conversations group by 1",
    "dedup_ordered_union": """with d as (select md5(text) as k, doc_id as pos, source as record, lag(source) over w as b,
          row_number() over w as n from documents window w as (partition by md5(text) order by doc_id))
        select k, min(pos) as first_pos, max_by(record, pos) as record, count(*) filter (where n > 1 and record is not distinct from b) as same,
          count(*) filter (where n > 1 and record is distinct from b) as differing from d group by k""",
    "dedup_case_url_key": """with p as (select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) as site from pages)
        select page_id, site from p where site <> '' qualify row_number() over (partition by site order by page_id) = 1""",
    "compare_full_outer": """with a as (select p_partkey, {'n': p_name, 'b': p_brand} as r from part where p_size <= 40),
          b as (select p_partkey, {'n': p_name, 'b': case when p_size % 7 = 0 then '?' else p_brand end} as r from part where p_size >= 10)
        select case when a.p_partkey is null then 'only_right' when b.p_partkey is null then 'only_left'
          when a.r is not distinct from b.r then 'equal' else 'mismatch' end as outcome, count(*) as n
        from a full join b on a.p_partkey = b.p_partkey group by 1""",
    "update_join_protected": """select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'X' else o_orderstatus end as o_orderstatus,
          o_orderpriority, case when o_orderkey % 3 = 0 and o_orderpriority <> '1-URGENT' then 1 else 0 end::int as conflicts from orders""",
    "flagged_subset_in_order": "select doc_id, source, n_chars from documents join labels using (doc_id) where toxic = 1 order by doc_id",
    "resume_pending": "select doc_id, run_id::int as run_id from documents cross join range(3) r(run_id) where (doc_id + run_id) % 4 <> 0",
    "resume_missing": "select count(*) as missing from documents where doc_id % 50 = 0",
    "anti_join_balanced_sample": """with u as (select doc_id from documents qualify row_number() over (partition by lang order by md5(doc_id || '|42'), doc_id) <= 25),
          l as (select * from labels where doc_id not in (select doc_id from u)),
          r as (select doc_id, quality, (row_number() over (partition by quality order by md5(doc_id || '|42'), doc_id))::int as rank from l)
        select * from r where rank <= (select min(n) from (select count(*) as n from l group by quality))""",
    "sample_simple": "select doc_id, lang from documents order by md5(doc_id || '|42'), doc_id limit 50",
    "sample_stratified": """select doc_id, lang, (row_number() over (partition by lang order by md5(doc_id || '|42'), doc_id))::int as rank
        from documents qualify rank <= 25""",
    "sample_nested_splits": """with r as (select doc_id, lang, (row_number() over (partition by lang order by md5(doc_id || '|42'), doc_id))::int as rank from documents),
          s(split, lang, n) as (values ('a', 'en', 30), ('a', 'fr', 10), ('b', 'en', 60), ('b', 'fr', 5), ('b', 'de', 20))
        select lang, doc_id, rank, split from r join s using (lang) where rank <= n""",
    "split_by_date": "select case when strftime(o_orderdate, '%Y-%m-%d') < '1996-01-01' then 'train' else 'test' end as split, count(*) as n from orders group by 1",
    "count_by_class_sorted": "select o_orderpriority, count(*) as n from orders group by 1 order by n desc, 1",
    "split_class_pivot": """select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o,
        count(*) filter (where o_orderstatus = 'P') as p from orders group by 1""",
    "top_k_first_seen": "select c_nationkey, count(*) as n, min(c_custkey) as first_pos from customer group by 1 order by n desc, first_pos limit 10",
    "explode_prefix_counts": "select lower(w) as word, count(*) as n from (select unnest(string_split(p_type, ' ')) as w from part) group by 1",
    "share_of_total": "select event_type, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as percent from events group by 1",
    "issue_array_and_histogram": """select issue, count(*) as n from (select unnest(list_filter([case when n_chars < 300 then 'short' end,
        case when regexp_matches(text, '[#$%&]{2}') then 'symbols' end, case when contains(text, 'http') then 'link' end,
        case when not contains(text, '.') then 'no_stop' end], lambda x: x is not null)) as issue from documents) group by 1 order by 1""",
    "route_by_severity": """select case when n_chars < 300 or not contains(text, '.') then 'issue_log'
        when regexp_matches(text, '[#$%&]{2}') or contains(text, 'http') then 'manual_review' else 'processed' end as route, count(*) as n
        from documents group by 1""",
    "best_candidate": "select l_orderkey, arg_min(l_linenumber, {'d': l_discount, 'q': -l_quantity, 'n': l_linenumber}) as best from lineitem group by 1",
    "text_normalize_block": f"""with a as (select doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') as t from documents),
        b as (select doc_id, regexp_replace(replace(t, chr(65279), ''), '[\\x{{a0}}\\x{{3000}}\\x{{2000}}-\\x{{200f}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}]', ' ', 'g') as t from a),
        c as (select doc_id, regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g') as t from b)
        select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+', ''), '{_WS}+$', '')) as h from c""",
    "text_compact_len": f"select doc_id, length(regexp_replace(text, '{_WS}+', '', 'g')) as n from documents",
    "text_drop_meta_lines": """select doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)),
        lambda x, i: not (i <= 3 and (contains(x, 'License') or contains(x, 'Copyright')))), chr(10))) as h from documents""",
    "text_shorten": "select doc_id, md5(case when length(text) > 100 then left(text, 100) || '...' else text end) as h from documents",
    "json_props_extract": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "chat_messages_build": """select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn, role, text)) as h from conversations group by 1""",
    "html_links_same_host": """with p as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as root,
          regexp_extract_all(html, 'href="(https?://[^"]+|/[^"/][^"]*)"', 1) as hrefs from pages),
          l as (select page_id, root, unnest(list_distinct(list_transform(hrefs, lambda x: case when x[1] = '/' then root || x else x end))) as link from p)
        select page_id, link from l where regexp_extract(link, '^https?://([^/?#]+)', 1) = regexp_extract(root, '^https?://(.+)$', 1)""",
}
SQL["dedup_normalized_text"] = f"""with n as ({SQL["text_normalize_block"]}), k as (select doc_id, case when h = md5('') then '' else h end as k from n)
        select doc_id, k from k qualify row_number() over (partition by k order by doc_id) = 1 or k = ''"""
QUERIES = {n: globals()[n] for n in [*SQL, "mask_email_phone", "html_to_text"]}
