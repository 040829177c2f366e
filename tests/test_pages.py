"""Fetched pages: content, dates, entries of lists, further list pages."""

from pyspark.sql import functions as F

from millrace.functions import pages as P


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("x")).first().x


def test_page_text(spark):
    html = "<p>a&nbsp;&amp;&eacute;&#8217;</p >b<br/>c<script x>d</script><style>e</style><!-- f --> \r\n g"
    assert one(spark, html, P.page_text(F.col("html"))) == "a &é\u2019\nb\nc\ng"
    assert one(spark, None, P.page_text(F.col("html"))) is None and one(spark, "", P.page_text(F.col("html"))) == ""


def test_content(spark):
    long, longer, short = "x" * 120, "y" * 400, "z" * 20
    nested = f'<div class="content big"><div>{long}</div><div>tail</div></div>after'
    cases = [
        (nested, f"{long}\ntail"),
        (f'<div id="zoom">{short}</div><p class="my article">{long}</p>', long),  # the better place is too short
        (f'<div class="content">{long}<p class="article">{long}1</p>', f"{long}1"),  # never closed
        (f"<body><div>{short}</div><DIV a>{longer}</DIV><div>{longer}</div></body><div>{longer}{longer}</div>", longer),
        (f"<div>{long}</div>", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {r.i: r.x for r in df.select("i", P.content(F.col("html")).alias("x")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    assert df.where("false").select(P.content(F.col("html"))).collect() == []


def test_long_page(spark):
    html = "<div>" * 50_000 + '<div class="content">' + "w " * 200_000 + "</div>"
    assert one(spark, html, P.content(F.col("html"))) == ("w " * 200_000).strip()


def test_publication_date(spark):
    date = P.publication_date(F.col("html"))
    assert one(spark, '<META data-x name="PubDate" content=" 2024-01-02 ">', date) == "2024-01-02"
    assert one(spark, "<meta name='other' content='2024'>", date) is None and one(spark, None, date) is None


def test_entries(spark):
    html = """<a href="202401/t20240102_1.html" title="x"><b>First &amp;\n one</b></a><a href='../b/info/12/34.htm'>Second</a>
        <a href="202401/t20240102_1.html">again</a><a href="http://other.example/info/1/2.htm">far</a><a href="about.html">no</a>
        <a href="http://h.example/info/9/9.html">""" + "t" * 200 + "</a><a href='http://[bad/info/1/2.htm'>bad</a>"
    rows = [(html, "http://h.example/a/index.html"), (None, "http://h.example/"), (html, None), ("", "http://h.example/"), (html, "http://[bad")]
    df = spark.createDataFrame(rows, "html string, url string").coalesce(1)
    got = [r.x for r in df.select(P.entries(F.col("html"), F.col("url")).alias("x")).collect()]
    assert [tuple(e) for e in got[0]] == [("http://h.example/a/202401/t20240102_1.html", "First &\none"),
                                          ("http://h.example/b/info/12/34.htm", "Second"), ("http://h.example/info/9/9.html", "t" * 120)]
    assert got[1:] == [None, None, [], []]


def test_list_pages(spark):
    rows = [("http://h.example/a/index.shtml", "var countPage = 3;", 7), ("http://h.example/b/", "var countPage=2", 8), (None, "var countPage = 2", 9),
            ("http://h.example/c/list.htm", "_simple_list_gotopage_fun(3, 'x')", 7)]
    df = spark.createDataFrame(rows, "address string, html string, site int")
    got = {(r.page, r.list_url) for r in P.list_pages(df).where("site = 7 or site = 8").collect()}
    assert got == {(1, rows[0][0]), (2, "http://h.example/a/index_1.shtml"), (3, "http://h.example/a/index_2.shtml"), (1, rows[1][0]),
                   (2, "http://h.example/b/index_1.shtml"), (1, rows[3][0])}
    got = [r.list_url for r in P.list_pages(df, "number").where("address like '%list.htm'").orderBy("page").collect()]
    assert got == [rows[3][0], "http://h.example/c/list/1.htm", "http://h.example/c/list/2.htm"]
    assert P.list_pages(df, most=2).count() == 5
