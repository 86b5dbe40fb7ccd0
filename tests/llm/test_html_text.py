import html
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from equispan.llm.html_text import Builder, extract, extract_pages, scan
from equispan.llm.queries import op6_html_extraction

CASES = [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<p>a<div>b</div>c", "a\n\nb\nc"),
    ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br/><br>c", "a\nb\n\nc"), ("<b>a</b><i>b</i> <u> c </u>d", "ab c d"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n\n  - c\n- d"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><th>name<th>n<tr><td>x<td>10<tr><td>longer<td>2</table>", "name   | n\nx      | 10\nlonger | 2"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>aa<td>b<td>c</table>", "wide   | z\naa | b | c"),
    ("<p>a<table><caption>cap<tr><td>1<br>2<td>x</table>b", "a\n\ncap\n1 | x\n2 |\n\nb"),
    ("<head><title>t</title><style>.x,#y{display : none} q{visibility:hidden}</style></head><body>a<p class='x'>b</p><i id=y>c</i>"
     "<q>d<b style='visibility:visible'>e</b></q><p hidden>f<p style='DISPLAY: none'>g", "ae"),
    ("<script>var t='</p>';</script>a<!-- x --><noscript>b</noscript><template>c</template>", "a"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<pre>a  b\n c</pre>", "a  b\n c"), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"), ("<blockquote>a<p>b</blockquote>c", "> a\n>\n> b\n\nc"),
    ("<h1>T</h1>x</p>y", "T\n\nx\n\ny"), ("<a href=x>un<b>closed", "unclosed"), ("a</div></b>b", "ab"), ("<head><title>t</title><p>body", "body"),
    ("<td>a<td>b", "a b"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_layout(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("page, text", [
    ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b", "a x=1 b"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style>s{}</style><script>s</script><path/><text>one</text><text>two</text></svg>c", "one two c"),
    ("<svg><defs/><g><text>label</text></g></svg><desc>d</desc>", "label d"), ("<svg/>after", "after"),
    ("<map name=m><a href=x>link</a><area></map>", "link"),
    ("<head><title>T</title>Hello <a>link</a> <b>x</b>", "Hello link x"), ("<head><title>T</title> <meta a=b><a>link</a> y</head>z", "link yz"),
    ("<html><head>\n<script>s</script>\n<style>b{}</style><noscript>n</noscript></head>b", "b"),
])
def test_drawings_and_open_heads(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("page, text", [
    ("a<b", "a<b"), ("x <a href='y", "x <a href='y"), ("a < b <= c <3", "a < b <= c <3"), ("<a b='c>d</a>e", "de"), ("<p title=\"a>b\">c", "c"),
    ("a<!-- b <p>c", "a"), ("a<!-->b<!--->c<!-- > -- >d--!>e", "abce"), ("a</>b</ x>c<?php x?>d<!doctype html>e", "abcde"), ("a</p", "a</p"),
    ("<textarea><b>&lt;</textarea>c", "<b><c"), ("<title><p>x</title>y", "y"), ("<script>a</scripty></SCRIPT >b", "b"), ("<script/>a</script>b", "b"),
    ("<IMG SRC=a/>x<Br>y", "x\ny"), ("&#" + "9" * 5000 + ";&#" + "0" * 5000 + "65;&#" + "0" * 9000 + ";", "\ufffdA\ufffd"), ("AT&ampT &#x41;&nbsp;&notin;", "AT&T A ∉"),
    ("<div>" * 300 + "<script>no</script>a", "a"), ("<p =x y==z/ >a", "a"),
])
def test_broken_markup(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("sheet, text", [
    ("@media print{p{display:none}}", "a\n\nb"), ("@media screen, print { p { color: red; display: none } }", "b"), ("@media ONLY screen{@supports (x:y){p{display:none}}}", "a\n\nb"),
    ("@import 'x'; /* p{ */ i{display:none} p{visibility:hidden !important;}", "b"), ("@media all{p{display:none", "b"), ("/* p{display:none}", "a\n\nb"),
    ("@font-face{a:b}}p,q>p{display:none}", "b"), ("@media screen and (width<9px){p{display:none}} x{}", "a\n\nb"),
])
def test_style_sheets(sheet, text):
    assert extract(f"<style>{sheet}</style><p>a</p>b") == text


@pytest.mark.parametrize("part", ["<a ", "<a b='", '<a b="', "<a b='>", "<!--", "<!", "</", "</a", "<", "&", "&#", "<script>", "<title>", "<svg><b>", "<a>", "<i/>",
                                  "<style>/*", "<style>a{", "<p a=b ", "<td>", "<li>", "<a / ", "= <"])
def test_a_million_signs_of_broken_markup(part):
    began = time.process_time()
    extract(part * (1_000_000 // len(part)))
    extract("<style>" + part * (1_000_000 // len(part)) + "</style>x")
    assert time.process_time() - began < 30


def test_scan_agrees_with_the_standard_tokenizer():
    class Standard(Builder, HTMLParser):
        def __init__(self):
            Builder.__init__(self)
            HTMLParser.__init__(self)

    def tree(node):
        out = []
        for x in node.children:
            if not isinstance(x, str):
                out.append((x.tag, x.attrs, tree(x)))
            elif out and isinstance(out[-1], str):
                out[-1] += x
            else:
                out.append(x)
        return out

    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist() if r["html"]]
    for page in pages + [x for x, _ in CASES if x]:
        want, got = Standard(), Builder()
        want.feed(page)
        want.close()
        scan(page, got)
        assert tree(got.root) == tree(want.root)
        assert got.sheet == want.sheet


def test_long_and_deep_pages():
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000 + "after").split() == ["deep", "after"]
    assert extract("<ul><li>" * 3000 + "deep").endswith("deep")
    assert len(extract("<p>word " * 50000).split()) == 50000
    wide = extract("<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>" + "x" * 100000 + "<td>c</table>")
    assert len(wide) < 130000


def seen(page):
    """The words that show, without any tree: holds for pages without hidden elements or preformatted text."""
    page = re.sub(r"(?is)<!--.*?-->|<head\b.*?</head>|<script\b.*?</script>|<!doctype[^>]*>", " ", page)
    page = re.sub(r"(?i)</?(b|a|i)\b[^>]*>", "", page)
    return re.findall(r"\S+", html.unescape(re.sub(r"<[^>]*>", " ", page)))


def test_query_keeps_all_visible_words(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = op6_html_extraction(spark, d).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert [w for w in r.extracted.split() if w != "-"] == [w for w in seen(pages[r.page_id]) if w != "-"]


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a", None), (1, "<p>a", None), (None, "", "")], "page_id long, html string, extracted string")
    assert sorted(r.extracted for r in extract_pages(df).collect()) == ["", "", "a", "a"]
    assert extract_pages(df.limit(0)).count() == 0
