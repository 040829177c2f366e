"""Fetched pages: text, main content, publication date, entries of list pages, addresses of further list pages.

Balanced tags, all named entities and relative addresses have no column function, so these run as Arrow UDFs over whole
pages; the functions they send are closed in themselves, so that workers need not import this package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Places of the main content, best first; least lengths of a place and of a plain division; the address
# pattern of a detail page; names of the publication date; longest title.
CONTENT_PLACES = (("id", "fontzoom"), ("id", "zoom"), ("class", "TRS_Editor"), ("class", "TRS_PreAppend"), ("class", "contbox"),
                  ("class", "content"), ("id", "article-body"), ("class", "article-body"), ("class", "article"))
LEAST_PLACE, LEAST_DIVISION = 100, 300
DETAIL = r"""(?i)href=["']((?:https?://[^"']+?|(?:\.{1,2}/)*[\w/\-]*?)(?:\d{6}/t\d+_\d+\.s?html|info/\d+/\d+\.html?))["']"""
DATE_NAMES = "publishdate|PubDate|pubdate"
LONGEST_TITLE = 120


def _plain() -> Callable[[str], str]:
    import re
    from html import unescape

    hidden, breaks = re.compile(r"(?is)<(script|style)[^>]*>.*?</\1>"), re.compile(r"(?i)<br\s*/?>|</(?:p|div)\s*>")
    tags, blanks, ends = re.compile(r"<[^>]+>"), re.compile(r"[ \t\f\v]+"), re.compile(r" *\n *")

    def plain(page: str) -> str:
        t = unescape(tags.sub("", breaks.sub("\n", hidden.sub("", page))))
        return ends.sub("\n", blanks.sub(" ", t.replace("\r", "").replace("\xa0", " "))).strip()

    return plain


def _each(one, kind: str) -> Callable[..., Column]:
    """A column function of one, a Python function of one row's strings; null where any of them is null."""
    import pandas as pd

    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(x is None for x in r) else one(*r) for r in rows], dtype="object")

    if one.__code__.co_argcount == 1:
        def first(a: pd.Series) -> pd.Series:
            return run(a)
    else:
        def first(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)
    first.__annotations__ = dict.fromkeys([*first.__code__.co_varnames[: first.__code__.co_argcount], "return"], pd.Series)
    return F.pandas_udf(first, kind)


def page_text(html: Column) -> Column:
    """Text without scripts, styles and tags, all entities resolved; null for null."""
    return _each(_plain(), "string")(html)


def content(html: Column) -> Column:
    """Text of the first of CONTENT_PLACES that is closed and long enough, else of the longest division; null without one."""
    import re

    plain, places, least, division = _plain(), CONTENT_PLACES, LEAST_PLACE, LEAST_DIVISION
    wanted = [re.compile(rf"""(?i)\b{a}\s*=\s*["'][^"']*\b{re.escape(v)}\b[^"']*["']""") for a, v in places]
    tag, body = re.compile(r"<(/?)(\w+)\b([^>]*)>"), re.compile(r"(?is)<body[^>]*>(.*?)</body>")
    divisions = re.compile(r"(?is)<div\b[^>]*>(.*?)</div>")

    def one(page: str) -> str | None:
        begun: dict[str, list[int]] = {}  # open tags by name
        spans: list[list] = []  # attributes, begin, end
        for m in tag.finditer(page):
            name = m[2].lower()
            if not m[1]:
                begun.setdefault(name, []).append(len(spans))
                spans.append([m[3], m.end(), None])
            elif begun.get(name):
                spans[begun[name].pop()][2] = m.start()
        for w in wanted:
            found = next((s for s in spans if w.search(s[0])), None)
            if found and found[2] is not None:
                text = plain(page[found[1] : found[2]])
                if len(text) >= least:
                    return text
        inner = body.search(page)
        texts = [plain(d) for d in divisions.findall(inner[1] if inner else page)]
        return max((t for t in texts if len(t) >= division), key=len, default=None)

    return _each(one, "string")(html)


def publication_date(html: Column) -> Column:
    found = F.regexp_extract(html, rf"""(?i)<meta[^>]+name=["'](?:{DATE_NAMES})["'][^>]+content=["']([^"']+)["']""", 1)
    return F.when(found != "", strip(found))


def entries(html: Column, address: Column, pattern: str = DETAIL) -> Column:
    """detail_url and title of each link of a list page that pattern finds and that stays on the page's host, each address
    once, in the page's order; the title is the text of the first anchor to it. Null without a page or an address."""
    import re
    from urllib.parse import urljoin, urlsplit

    plain, links, longest = _plain(), re.compile(pattern), LONGEST_TITLE
    anchors = re.compile(r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>""")

    def host(url: str) -> str | None:
        try:
            return urlsplit(url).netloc
        except ValueError:
            return None

    def one(page: str, base: str) -> list[dict]:
        inner: dict[str, str] = {}
        for href, text in anchors.findall(page):
            inner.setdefault(href.strip().lower(), text)
        here, out = host(base), {}
        for href in links.findall(page):
            href = href.strip()
            try:
                url = urljoin(base, href)
            except ValueError:  # no address
                continue
            if here is not None and host(url) == here and url not in out:
                out[url] = plain(inner.get(href.lower(), ""))[:longest]
        return [{"detail_url": u, "title": t} for u, t in out.items()]

    return _each(one, "array<struct<detail_url: string, title: string>>")(html, address)


#: Where a first list page says how many pages there are, by style of paging: a variable, or the argument of a call.
PAGING = {"count": r"var\s+countPage\s*=\s*(\d+)", "number": r"_simple_list_gotopage(?:_fun)?\s*\(\s*(\d+)"}


def page_count(html: Column, style: str = "count") -> Column:
    """Pages of a list, as its first page says; 1 where it says nothing."""
    n = F.regexp_extract(html, PAGING[style], 1).try_cast("int")
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(1)))


def list_pages(first: DataFrame, style: str = "count", most: int | None = None) -> DataFrame:
    """first (address, html of the first page of each list) with page, from 1, and list_url, a row for each page.

    'count' names the further pages index_1 and so on beside the first, with its extension (.shtml where it has none); 'number' names them 1.htm and
    so on in a folder of the first page's name. Rows without an address go; no more than most pages of a list are named.
    """
    n = page_count(F.col("html"), style)
    n = n if most is None else F.least(n, F.lit(max(1, most)))
    rows = first.where("address is not null").withColumn("page", F.explode(F.sequence(F.lit(1), n)))
    folder, before = F.regexp_extract("address", "^(.*/)", 1), (F.col("page") - 1).cast("string")
    if style == "count":
        ending = F.lower(F.regexp_extract("address", r"(?i)(\.(?:shtml|html|jhtml|htm))(?:[?#].*)?$", 1))
        further = F.concat(folder, F.lit("index_"), before, F.when(ending != "", ending).otherwise(".shtml"))
    else:
        stem = F.regexp_extract("address", r"^.*/([^/]*?)(?:\.[^./]*)?$", 1)
        further = F.concat(folder, stem, F.lit("/"), before, F.lit(".htm"))
    return rows.withColumn("list_url", F.when(F.col("page") == 1, F.col("address")).otherwise(further))
