import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions.html_tokens import read_page

PAGE = """<?xml version="1.0"?>
<html>
  <head><meta charset="utf-8"/>{title}<base href="/pages/"/></head>
  <body class="two-column">{section}"""
TITLE = "<title>A Voyage</title>"
SECTION = '<div><section lang="de" title="Die Abfahrt" class="first">'


def extract(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    found = H.extract_page(rows, "html", "text", "title", "section").orderBy("i").collect()
    return [(r.text, r.title, r.section) for r in found]


def test_footnotes(apply):
    cases = {
        'The ship<sup id="n7">7</sup> sails': "The ship sails",
        'A<sup>12</sup>B<sup class="ref" id="q">345</sup>C<sup>6</sup>': "ABC",
        'E=mc<sup>2a</sup>, 1<sup class="o">st</sup>': 'E=mc<sup>2a</sup>, 1<sup class="o">st</sup>',
        "": "",
        "harbour;<sup>\t8\n </sup> then": "harbour; then",
        "x<sup><a>1</a></sup>": "x<sup><a>1</a></sup>",
        "x<SUP>1</SUP>": "x<SUP>1</SUP>",
    }
    assert apply(H.filter_footnotes, list(cases)) == list(cases.values())


def test_footnotes_equal_plain_pattern(apply):
    rng = random.Random(5)
    parts = ["<sup", "<sup>", ">", " ", "1", "23", "\n", "</sup>", "x", "<", '<sup class="c">', "\u00a0"]
    pages = ["".join(rng.choices(parts, k=10)) for _ in range(4000)]
    plain = re.compile(r"<sup[^>]*>[\s]*[0-9]+\s*</sup>")
    assert apply(H.filter_footnotes, pages) == [plain.sub("", page) for page in pages]


def test_titles(spark):
    pages = [
        PAGE.format(title=TITLE, section=SECTION),
        PAGE.format(title=TITLE, section=""),
        PAGE.format(title="", section=SECTION),
        "",
        "<body><section><section title='later'>",
        '<body><section alt="a title=no" title=yes>x',
        "<title>a</title><title>b &amp; c</title><body>x",
        "<title>&Aacute;</title><body><section title='&Ouml;'>x",
    ]
    found = [(title, section) for _, title, section in extract(spark, pages)]
    assert found == [
        ("A Voyage", "Die Abfahrt"), ("A Voyage", ""), ("", "Die Abfahrt"), ("", ""), ("", ""),
        ("", "yes"), ("ab & c", ""), ("Á", "Ö"),
    ]


# (page, body text): what a browser's text content of the body would be
PAGES = [
    ("<body><p>a</p><p>b</p>", "ab"),
    ("<body>a<!-- b -->c<!--> d <!-- e --!>f", "ac d f"),
    ("<body><script>if (a<b) x</script>t<style>p{}</style>", "if (a<b) xtp{}"),
    ("<html><head></head><body>x</body>\n</html>\n", "x\n\n"),
    ("no body tag", "no body tag"),
    ("<p>implied", "implied"),
    ("<title/><body>swallowed", ""),
    ('<body a="x>y">1 < 2 <3 &lt;4 </ gone>', "1 < 2 <3 <4 "),
    ("<body>&amp;lt; &#38;lt; &#8217;&#x2014;&#160;&nbsp;", "&lt; &lt; ’—  "),
    ("<body>&copy &notit; &Aacute; &#150; &unknown;", "© ¬it; Á – &unknown;"),
    ("<body>a\r\nb\rc&#13;d", "a\nb\nc\rd"),
    ("<body><pre>\n\nx</pre><textarea>\n<b>y</b></textarea>", "\nx<b>y</b>"),
    ("<body><p title=a\"b>hi</p><i b='>'>x", "hix"),
    ("<body><svg><title>in</title><![CDATA[c<d]]></svg>x<![CDATA[gone]]>", "inc<dx"),
    ("<body>cut <b", "cut "),
    ("<body><noscript><p>raw</p></noscript>", "<p>raw</p>"),
    ("﻿<?xml version='1.0'?><!DOCTYPE html><html><head> </head> <body> x", " x"),
    ("<head><script>'<body>'</script></head> y", "y"),
    ("<body></body>", ""),
    ("<body>a<table> <tr> <td>b</td> <td>c</td></tr></table>d", "a  b cd"),
    ("<body>a<table>x<tr><td>b</td>y</tr></table>d", "axybd"),
    ("<body>a<table><tr><td>b<table><tr>in<td>c</table>e</td></tr><p>z</p></table>d", "azbinced"),
    ("<table><caption>t</caption><!-- c -->x<tr><th>h</th></tr></table>", "xth"),
    ("<body>&#x1F600; &#55357; &#0;", "😀 � �"),
]


def test_body_text(spark):
    found = [text for text, _, _ in extract(spark, [page for page, _ in PAGES])]
    assert found == [text for _, text in PAGES]


def test_tokenizer_alone_gives_the_same(spark):
    assert [read_page(page)["body_text"] for page, _ in PAGES] == [text for _, text in PAGES]


def test_native_tier_equals_tokenizer_where_it_applies(spark):
    rng = random.Random(11)
    parts = [
        "<p>", "</p>", "<b class='x>y'>", "text ", "&amp;", "&lt;", "&#8217;", "&#x20AC;", "&#38;lt;", "&",
        " & ", "<!-- c -->", "<br/>", "\n", "<", "< ", "</", "<pre>\n", '<a href="?a=1&b=2">', "é😀", "&quot;",
        "<section title='s&amp;t'>", "&#65;", "<table>", "<tr>", "<td>", "</td>", "</table>", "<!x>", "<?y?>", "</body>", ">", "--", "=", '"', "'",
    ]
    pages = ["<head><title>t</title></head><body>" + "".join(rng.choices(parts, k=12)) for _ in range(3000)]
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select(
        "html",
        H.simple_body(F.col("html")).alias("body"),
        H.native_body_text(F.col("html")).alias("text"),
        H.native_title_tag(F.col("html")).alias("title"),
        H.native_section_title(F.col("html")).alias("section"),
        H.is_simple_text(H.strip_markup(H.simple_body(F.col("html")))).alias("simple"),
    ).filter("body <> '' and simple").collect()
    assert len(rows) > 1000
    for row in rows:
        page = read_page(row.html)
        assert (row.text, row.title) == (page["body_text"], page["title_tag"]), row.html
        assert row.section == page["section_title"], row.html


def test_raw_elements_are_read_natively_and_alike(spark):
    rng = random.Random(12)
    parts = [
        "<script>", "</script>", "<script src='a.js'>x = 1;</script>", "<style>p{}</style>", "<STYLE\ttype=a>\n</Style >", "<style>", "</style>",
        "<script>a<b</script>", "<script>a&amp;b</script>", "<script><!-- </script>", "<!-- <script>in</script> -->",
        "<a title='<script>x</script>'>", "<svg>", "</svg>", "<svg><style>b</style></svg>", "<p>", "</p>", "t ", "&amp;", "<script/>", "</script\n>",
        "<table>", "<tr>", "<td>", "</table>", "<script></script>", "\n", "<pre>\n",
    ]
    pages = ["<head><title>t</title></head><body>" + "".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(4000)]
    found = extract(spark, pages)
    for page, (text, title, section) in zip(pages, found):
        wanted = read_page(page)
        assert (text, title, section) == (wanted["body_text"], wanted["title_tag"], wanted["section_title"]), page
    rows = spark.createDataFrame([(p,) for p in pages], "html string")
    native = rows.filter(~H.needs_tokenizer(F.col("html")) & F.contains("html", F.lit("<script"))).count()
    assert native > 400


def test_fewer_pages_reach_the_tokenizer(spark):
    """Of the registered pages only those without a body that is simple; scripts no longer count."""
    pages = spark.createDataFrame([(f"<body><article><script>count({i});</script>a &amp; b</article></body>",) for i in range(9)], "html string")
    assert pages.filter(H.needs_tokenizer(F.col("html"))).count() == 0


@pytest.mark.parametrize("page", ["<sup" * 200_000, "<sup>1" * 100_000, "<sup>" + " " * 300_000 + "1"])
def test_unfinished_footnotes_take_linear_time(apply, page):
    assert apply(H.filter_footnotes, [page]) == [page]


@pytest.mark.parametrize("tail", ["<b " + "x " * 200_000, "<!-- " + "-" * 200_000, "&" * 200_000, "<" * 100_000,
                                  "<svg>" + "<title>" * 50_000, "<script>" * 50_000, "<script>x</script>" * 20_000, "<table>" * 50_000])
def test_hostile_pages_neither_recurse_nor_backtrack(spark, tail):
    [(text, _, _)] = extract(spark, ["<body>" + tail])
    assert text == read_page("<body>" + tail)["body_text"]


def test_references_of_any_length(spark):
    zeros = "0" * 40
    page = f"<body>&#{zeros}65;&#x{zeros}41;&#65;&#X1F600;</body>"
    assert extract(spark, [page])[0][0] == read_page(page)["body_text"] == "AAA\U0001f600"
