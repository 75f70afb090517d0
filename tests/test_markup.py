"""Markdown, FB2, page XML, sheets, contents after a split, options."""

from pyspark.sql import functions as F

from quire.operators import transforms as T
from quire.options import Options
from quire.sources import markup as M


def test_markdown(spark):
    text = "# Heading\n\nA **bold** *it* `a<b` [l](u).\nnext\n\n- one\n- two\n\n1. x\n\n> q\n\n---\n```\n<c>\n```\n"
    want = "<h1>Heading</h1>\n<p>A <strong>bold</strong> <em>it</em> <code>a&lt;b</code> <a href=\"u\">l</a>.\nnext</p>\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>\n<ol>\n<li>x</li>\n</ol>\n<blockquote>\n<p>q</p>\n</blockquote>\n<hr />\n<pre><code>&lt;c&gt;\n</code></pre>\n"
    assert M.markdown_html(text) == want and M.markdown_html(None) == ""
    got = M.markdown_books(spark.createDataFrame([(1, text), (2, None)], "book_id int, t string"), "t").collect()
    assert {r["book_id"]: r["html"] for r in got} == {1: want, 2: ""}


def test_fb2(spark):
    book = "<FictionBook><description><title-info><book-title>T</book-title></title-info></description><body><section><title><p>One</p></title><p>a <strong>b</strong> &amp; c</p><section><title><p>Two</p></title><empty-line/><poem><stanza><v>v</v></stanza></poem></section></section></body></FictionBook>"
    title, body = M.fb2_html(book)
    assert title == "T" and body.split("\n") == ["<h1>One</h1>", "<p>a <strong>b</strong> &amp; c</p>", "<h2>Two</h2>", "<br/>", '<div class="poem">', '<div class="stanza">', '<p class="verse">v</p>', "</div>", "</div>"]
    got = {r["book_id"]: r for r in M.fb2_books(spark.createDataFrame([(1, book), (2, "<broken")], "book_id int, t string"), "t").collect()}
    assert got[1]["title"] == "T" and "ParseError" in got[2]["error"]


def test_page_xml(spark):
    xml = '<pdf2xml><page number="1" width="600" height="800"><fontspec id="0"/><text top="10" left="5" width="9" height="8" font="0">a <b>b</b></text></page></pdf2xml>'
    (row,) = M.pdf_texts(spark.createDataFrame([(1, xml)], "book_id int, x string"), "x").collect()
    assert (row["number"], row["top"], row["left"], row["font_id"], row["text"]) == (1, 10.0, 5.0, "0", "a b")


def test_page_xml_marks(spark):
    xml = '<pdf2xml><page number="1"><text top="1" left="1">Hello <b>world <i>it</i></b> x<sup>2</sup><sub>i</sub> <a href="p?a=1&amp;b=2">l</a> <u>u</u></text></page></pdf2xml>'
    (row,) = M.pdf_texts(spark.createDataFrame([(1, xml)], "book_id int, x string"), "x").collect()
    assert row["inner_html"] == 'Hello <b>world <i>it</i></b> x<sup>2</sup><sub>i</sub> <a href="p?a=1&amp;b=2">l</a> u'
    assert row["text"] == "Hello world it x2i l u"


def test_css(spark):
    css = "/* c */ p  {\n color : red;\n margin: 0 auto; }\n a::after { content: \"x ;  } y\" }"
    got = spark.range(1).select(T.minify_css(F.lit(css)).alias("x")).first()["x"]
    assert got == 'p{color :red;margin:0 auto}a::after{content:"x ;  } y"}'


def test_relink(spark):
    toc = spark.createDataFrame([(1, 1, "A", "c.xhtml"), (1, 2, "B", "c.xhtml#x"), (1, 3, "C", "d.xhtml")], "book_id int, play_order int, title string, href string")
    chunks = spark.createDataFrame([(1, "c.xhtml", "A", "c.xhtml", 0), (1, "c.xhtml", "B", "c_ch1.xhtml", 1), (1, "c.xhtml", "B", "c_ch2.xhtml", 2)], "book_id int, from_href string, title string, href string, pos int")
    got = T.relink_toc(toc, chunks).orderBy("play_order").collect()
    assert [r["href"] for r in got] == ["c.xhtml", "c_ch1.xhtml", "d.xhtml"]


def test_options():
    full = Options(verbose=2, max_image_size=(1200, 1600), pdf_engine="image-only", extra_css='p { content: "x" }', jpeg_quality=95)
    assert Options.load(full.dump()) == full
    some = Options.load('verbose = 1\njpeg_quality = 900\npdf_engine = "odd"\nmax_image_size = "bad"\nunknown = 3', full)
    assert (some.verbose, some.jpeg_quality, some.pdf_engine, some.max_image_size, some.extra_css) == (1, 100, "auto", None, full.extra_css)
