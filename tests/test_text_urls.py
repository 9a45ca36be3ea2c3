import unicodedata
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions import urls as U


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_fold_table_covers_all_letters():
    assert len(T.LETTERS) == 67 and len(set(T.LETTERS)) == 67
    assert all(unicodedata.is_normalized("NFC", c) and len(c) == 1 for c in T.MARKED)


@pytest.mark.parametrize(
    ("text", "how", "tokens"),
    [
        ("quy chế đào tạo", "collapse", ["quy", "cha", "aao", "tao"]),
        ("Học bổng", "collapse", ["hac", "bang"]),
        ("điều kiện", "collapse", ["aiau", "kian"]),
        ("quy chế ĐÀO tạo", "base", ["quy", "che", "dao", "tao"]),
        ("a_b-c 12.5 日本", "base", ["a_b", "c", "12", "5", "日本"]),
        ("", "base", []),
        (None, "base", []),
    ],
)
def test_tokens(spark, text, how, tokens):
    assert one(spark, T.tokenize(F.col("t"), fold_marks=how), t=text) == tokens


def python_normal(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("​", "").replace("­", "")
    out = []
    for line in (x.rstrip() for x in text.splitlines()):
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out).strip()


@pytest.mark.parametrize("text", ["a\r\nb\rc", "  a  \n\n\n \n b \t\n", "x​y­z", "a\u000bb\u000cc\u0085d e", "", " \n ", " a \n b"])
def test_normalize(spark, text):
    assert one(spark, T.normalize_text(F.col("t")), t=text) == python_normal(text)


class Texts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript")
        self.apart = True

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript")
        self.apart = True

    def handle_comment(self, data):
        self.apart = True

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        """Data that nothing stands between is one text node."""
        if not self.skip:
            self.out[-1:] = [data] if not self.out else [self.out[-1], data] if self.apart else [self.out[-1] + data]
            self.apart = False


@pytest.mark.parametrize(
    "html",
    [
        "<title>T &amp; U</title><p>a<b>b</b> c</p><script>var x='</p>';</script><!-- no --><style>p{}</style>d",
        "<noscript>x</noscript><p> \n </p>y<br>z",
        "plain",
        "",
        '<p title="a>b">hi</p><p>x < y</p>',
        "<p data-x='</p><b>'>in</p> 3 <4 and a<5 > 2",
        "<!-- <p>no</p> --><p>yes</p><!-- a > b --->c<!doctype html><?pi x?>d",
        "<script>if (a<b && '<p>') x='<!--';</script>seen<style>p>q{}</style>",
        "<SCRIPT src='a>b'>no</SCRIPT ><noscript><p>no</p></noscript>yes",
        '<a href=x title=">">t</a><img alt="<b>"/>u',
        "a<br/>b<br>c</unknown>d",
    ],
)
def test_html_to_text(spark, html):
    parser = Texts()
    parser.feed(html)
    want = "\n".join(x for x in (line.strip() for line in "\n".join(parser.out).splitlines()) if x)
    assert one(spark, T.html_to_text(F.col("h")), h=html) == want


def test_all_pages_read_as_a_parser_reads_them(spark):
    """Texts and links of every given page, against html.parser."""
    class Links(Texts):
        found: list

        def handle_starttag(self, tag, attrs):
            super().handle_starttag(tag, attrs)
            if tag == "a" and dict(attrs).get("href"):
                self.found.append(dict(attrs)["href"])

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.url: r.t for r in pages.select("url", T.html_to_text(F.col("html")).alias("t")).collect()}
    links: dict = {}
    for r in U.extract_links(pages).orderBy("src_url", "pos").collect():
        links.setdefault(r.src_url, []).append(r.href)
    for r in pages.collect():
        parser = Links()
        parser.found = []
        parser.feed(r.html)
        assert texts[r.url] == "\n".join(x for x in (line.strip() for line in "\n".join(parser.out).splitlines()) if x)
        assert links.get(r.url, []) == [h for h in parser.found if not h.startswith(("#", "mailto:", "javascript:", "tel:"))]


def test_what_is_no_link(spark):
    html = """<!-- <a href="/commented">c</a> --><script>x = '<a href="/inscript">';</script><p title='<a href="/value">'>t</p><a title="a > b" href="/one">1</a>
    <style>/* <a href="/style"> */</style><abbr href="/abbr">x</abbr><a data-x='href="/no"' href=/two>2</a><noscript><a href="/noscript"></a></noscript>"""
    page = spark.createDataFrame([("http://h/p", html)], "url string, html string")
    assert [r.dst_url for r in U.extract_links(page).orderBy("pos").collect()] == ["http://h/one", "http://h/two", "http://h/noscript"]


@pytest.mark.parametrize(
    ("html", "title"),
    [("<title> A &amp; B </title><h1>C</h1>", "A & B"), ("<title> </title><h1>C</h1>", ""), ("<h1>C <i>d</i></h1>", "C d"), ("<title></title><h1>C</h1>", "C"), ("<p>x", ""), ("<!-- <title>no</title> --><title>a < b</title>", "a < b"), ("<title>a<b>c</b></title><h1 class='x>y'>D</h1>", "D")],
)
def test_title(spark, html, title):
    assert one(spark, T.html_title(F.col("h")), h=html) == title


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("/a/b?q=1#f", "http://h:8080/a/b?q=1"),
        ("https://o.example/x#y", "https://o.example/x"),
        ("b.html", "http://h:8080/dir/b.html"),
        ("../c", "http://h:8080/c"),
        ("/x/../y", "http://h:8080/y"),
        ("?page=2", "http://h:8080/dir/page?page=2"),
        ("//o.example/z", "http://o.example/z"),
        ("  /t  ", "http://h:8080/t"),
        ("mailto:a@b", None),
        ("javascript:x", None),
        ("tel:1", None),
        ("#top", None),
        ("", None),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.col("u"), F.col("b")), u=url, b="http://h:8080/dir/page") == want


@pytest.mark.parametrize(
    ("url", "slug"),
    [("http://h/", "index"), ("http://h", "index"), ("http://h/a/b%20c?q", "a_b20c"), ("http://h/Đào tạo/x.html", "Đào_tạo.html".replace(".html", "_x.html")), ("http://h/!!!", "doc"), ("http://h/" + "a" * 200, "a" * 120)],
)
def test_slug(spark, url, slug):
    assert one(spark, U.slugify(F.col("u")), u=url) == slug


def test_links_and_kinds(spark):
    html = '<a href="/a">1</a><p><a class="x" href="b.PDF?x">2</a><a name="n">3</a><a href="/a#z">4</a><a href="mailto:m">5</a><a href="http://H:80/q">6</a>'
    page = spark.createDataFrame([("http://h/p/", html)], "url string, html string")
    links = U.extract_links(page)
    rows = links.select("dst_url", U.is_doc_link(F.col("dst_url")).alias("doc"), U.is_internal(F.col("dst_url"), F.lit("h")).alias("own"), U.file_name(F.col("dst_url")).alias("name")).collect()
    assert [tuple(r) for r in rows] == [
        ("http://h/a", False, True, "a.bin"),
        ("http://h/p/b.PDF?x", True, True, "b.PDF"),
        ("http://h/a", False, True, "a.bin"),
        ("http://H:80/q", False, False, "q.bin"),
    ]


def test_links_in_any_quotation(spark):
    html = """<a href='/one'>1</a><a class=x href=/two>2</a><A HREF = "/three">3</A><a href='/a"b.pdf'>4</a><a title="t"href=/five/>5</a><a
    href='/x?a=1&amp;b=2&copy=3&#38;c=4&eacute;'>6</a><area href=/no><a data-href="/no">7</a><a title="a href=/no" data-x='href="/no"' href="/seven">8</a>"""
    page = spark.createDataFrame([("http://h.example/p", html)], "url string, html string")
    rows = U.extract_links(page).orderBy("pos").collect()
    assert [r.href for r in rows] == ["/one", "/two", "/three", '/a"b.pdf', "/five/", "/x?a=1&b=2&copy=3&c=4é", "/seven"]
    assert [r.pos for r in rows] == list(range(7)) and rows[0].dst_url == "http://h.example/one"


def test_all_character_references(spark):
    html = "<title>Caf&eacute; &#8217;</title><p>&Agrave; &#x1F600; &amp;eacute; a &lt; b &hellip; &unknown; AT&T</p>"
    assert one(spark, T.html_to_text(F.col("h")), h=html) == "Café ’\nÀ 😀 &eacute; a < b … &unknown; AT&T"
    assert one(spark, T.html_title(F.col("h")), h=html) == "Café ’"
