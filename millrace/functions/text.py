"""Text functions over columns. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return sub(c, r"(?U)^\s+|\s+$")


def normalize_block(c: Column) -> Column:
    """Line ends to \\n, odd spaces to one space, no space around line ends, at most one blank line; null: empty."""
    c = sub(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = sub(F.translate(c, "﻿", ""), "[ 　 -‏    ]", " ")
    c = sub(sub(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return strip(sub(c, r"\n{3,}", "\n\n"))


def normalize_space(c: Column) -> Column:
    c = F.translate(F.translate(c, "\r", ""), " ", " ")
    return strip(sub(sub(c, r"[ \t\f\x0b]+", " "), r" *\n *", "\n"))


def compact_len(c: Column) -> Column:
    return F.length(sub(c, r"(?U)\s+"))


def drop_meta_lines(c: Column, words: tuple[str, ...]) -> Column:
    """Without those of the first three lines that hold one of the words."""
    found = "|".join(words)
    lines = F.filter(F.split(c, "\n"), lambda x, i: ~((i <= 2) & x.rlike(found)))
    return F.array_join(lines, "\n")


def shorten(c: Column, n: int, marker: str = "...") -> Column:
    if n <= 0:
        return c
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(marker))).otherwise(c)


def mask_email(c: Column) -> Column:
    """The first two characters of the name stay."""
    return sub(c, r"(?U)(?<![\w.%-])([A-Za-z0-9._%+-]{2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![\w.%-])", "$1***@$2")


def case_key(c: Column, lenticular: bool = False, trim: bool = False) -> Column:
    """Brackets of a case number as []; lenticular brackets too, and white space stripped, on request."""
    c = F.translate(c, "〔〕【】" if lenticular else "〔〕", "[][]" if lenticular else "[]")
    return strip(c) if trim else c


def case_number(c: Column) -> Column:
    """Inverse of case_key, for output."""
    return F.translate(c, "[]", "〔〕")


def url_prefix(c: Column) -> Column:
    """scheme://host, lower case; http where there is no scheme; null without a host."""
    m = F.lower(F.regexp_extract(strip(c), r"(?i)^(?:([a-z][a-z0-9+.-]*):)?//([^/?#]+)", 0))
    full = F.when(m.startswith("//"), F.concat(F.lit("http:"), m)).otherwise(m)
    return F.when(m != "", full)


def merge_key(case: Column, url: Column) -> Column:
    """Case number and address, joined by a control character; either alone where the other is missing."""
    k, u = F.coalesce(case_key(case, lenticular=True), F.lit("")), F.coalesce(url_prefix(url), F.lit(""))
    return F.when(k == "", u).otherwise(F.concat(k, F.lit("\x1e"), u))


def html_to_text(c: Column) -> Column:
    """Scripts and styles go, breaks become line ends, tags go, common entities are resolved."""
    c = sub(c, r"(?is)<script\b.*?</script>")
    c = sub(c, r"(?is)<style\b.*?</style>")
    c = sub(sub(c, r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:p|div)>", "\n")
    c = sub(c, r"(?s)<[^>]+>")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return normalize_space(c)


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[、，,;；]"), strip), lambda x: x != "")


def or_blank(c: Column, mark: str = "（空）") -> Column:
    """A report's name for a missing value."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(mark))


def file_name(c: Column) -> Column:
    return sub(F.translate(c, "〔〕", "[]"), r'[<>:"/\\|?*]', "_")
