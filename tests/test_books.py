"""Transforms, page operators and sinks on small books."""

import base64

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import pdf_pages as P
from quire.operators import sinks as O
from quire.operators import transforms as T
from quire.plans import queries as Q
from quire.sources import readers as R


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_headings(spark):
    html = "<h1>Chapter 1: Introduction</h1><h2>Sécond</h2><h3>Sub <em>section</em> </h3><h1> </h1>"
    got = T.headings(spark.createDataFrame([(1, html)], "id int, text string")).orderBy("byte_offset").collect()
    assert [(r["level"], r["title"]) for r in got] == [(1, "Chapter 1: Introduction"), (2, "Sécond"), (3, "Sub section")]
    assert [r["byte_offset"] for r in got] == [html.encode().index(b"<h1>"), html.encode().index(b"<h2>"), html.encode().index(b"<h3>")]
    got = T.headings(spark.createDataFrame([(1, "<h1>Chapter 1</h1><h1>Preface</h1>")], "id int, text string"), chapter="^Chapter").collect()
    assert [r["title"] for r in got] == ["Chapter 1"]


def test_split(spark):
    def chunks(body):
        html = f"<html><body>{body}</body></html>"
        return one(spark, T.split_document(F.col("t")), t=html)

    long = "<p>" + "word " * 3000 + "</p>"
    assert len(chunks(f"<h1>A</h1>{long}<h1>B</h1>{long}")) == 2
    assert len(chunks(f"<p>before</p><h2>A</h2>{long}")) == 2
    assert chunks(f"<p>none</p>{long}") is None
    assert chunks("<h1>A</h1><h1>B</h1>") is None
    brk = '<div class="mbp_pagebreak"></div>'
    assert len(chunks(f"{long}{brk}{long}{brk}{long}")) == 3
    assert chunks("".join(f"<h1>{i}</h1>x" for i in range(2000))) is None


def test_data_uri(spark):
    code = base64.b64encode(b"\x89PNG").decode()
    docs = spark.createDataFrame([(1, 0, f'<img src="data:image/png;base64,{code}"/>'), (1, 1, '<img src="image.png"/>')], "book_id int, pos int, text string")
    rows, images = T.data_uris(docs)
    got = {r["pos"]: r["text"] for r in rows.collect()}
    assert got == {0: '<img src="data_image_1.png"/>', 1: '<img src="image.png"/>'}
    assert [bytes(r["data"]) for r in images.collect()] == [b"\x89PNG"]


def test_guide_whitelist_and_aliases(spark):
    guide = spark.createDataFrame([(1, 0, "cover", "C", "c"), (1, 1, "custom-nonsense", "X", "x"), (1, 2, "ms-coverimage-standard", "M", "m"), (2, 0, "start", "S", "ch1"), (2, 1, "other.ms-coverimage-standard", "M", "m")], "book_id int, pos int, ref_type string, title string, href string")
    got = sorted((r["book_id"], r["pos"], r["ref_type"], r["href"]) for r in T.clean_guide(guide).collect())
    assert got == [(1, 0, "cover", "c"), (2, 0, "cover", "m"), (2, 1, "text", "ch1")]


def test_margins(spark):
    p = '<p style="margin-left: 2em;">x</p>'
    mixed = "".join(f'<p style="margin-left: {i % 4 + 1}em;">x</p>' for i in range(20))
    got = {r["book_id"]: r["text"] for r in T.fake_margins(spark.createDataFrame([(1, 0, p * 20), (2, 0, mixed), (3, 0, "none")], "book_id int, pos int, text string")).collect()}
    assert got == {1: "<p>x</p>" * 20, 2: mixed, 3: "none"}
    assert "margin" not in one(spark, T.template_margins(F.lit(T.PAGE_TEMPLATES[0]), F.lit("xhtml"), F.lit('<a style="margin: 20px;">')))


def test_text_functions(spark):
    assert one(spark, X.unsmarten(F.lit("“Hello,” she said. ‘World!’ A–B C—D more…"))) == "\"Hello,\" she said. 'World!' A-B C--D more..."
    assert one(spark, X.decode_entities(F.lit("&amp;lt;"))) == "<"
    assert one(spark, X.trim(F.lit("\n a \t"))) == "a"
    assert one(spark, X.book_format(F.lit("x/y.PDF"))) == "pdf" and one(spark, X.book_format(F.lit("x.unknown"))) is None
    assert one(spark, X.paragraph_html(F.lit("Hello <W>\n\nSecond\nline"))) == "<p>Hello &lt;W&gt;</p>\n<p>Second<br/>\nline</p>\n"
    assert one(spark, X.quote_regex(F.lit(r"a\Eb"))) == r"\Qa\E\\E\Qb\E"
    assert one(spark, T.remove_first_image(F.lit('<img src="c"/><p>H</p><img/>'))) == "<p>H</p><img/>"
    table = one(spark, T.linearize_tables(F.lit("<table><thead><th>a</th></thead><tr><td>b</td></tr></table>")))
    assert "<table" not in table and "<tr" not in table and table.count("linearized-header") == 2 and "thead" not in table.replace("</thead>", "")
    assert [tuple(spark.range(1).select(*T.fit_dimensions(F.lit(w), F.lit(h), 1000, 800)).first()) for w, h in ((2000, 1000), (500, 1600), (100, 100))] == [(1000, 500), (250, 800), (800, 800)]


def test_wrap_equals_plain_loop(spark):
    def plain(text):
        lines, line = [], ""
        for w in text.split():
            if line and len(line.encode()) + len(w.encode()) + 1 > 82:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}" if line else w
        return lines + ([line] if line else [])

    got = {}
    for r in Q.pdf_lines(spark, "/root/testdata/sf0.001").collect():
        got.setdefault((r["page_id"], r["paragraph"]), []).append((r["line"], r["text"]))
    assert got
    for lines in got.values():
        texts = [t for _, t in sorted(lines)]
        assert plain(" ".join(texts)) == texts


def test_lines_equal_plain_loop(spark):
    frags = Q._fragments(spark, "/root/testdata/sf0.001").collect()
    got = {(r["book_id"], r["number"], r["seq"]): r["line"] for r in Q.line_group(spark, "/root/testdata/sf0.001").collect()}
    pages = {}
    for r in frags:
        pages.setdefault((r["book_id"], r["number"]), []).append((r["top"], r["left"], r["seq"]))
    for page, items in pages.items():
        line, anchor = -1, None
        for top, _, seq in sorted(items):
            if anchor is None or abs(anchor - top) >= 3:
                line, anchor = line + 1, top
            assert got[(*page, seq)] == line


def test_ranges(spark):
    got = P.contiguous_ranges(spark.createDataFrame([(1, n) for n in (1, 2, 3, 3, 7, 8, 12)], "book_id int, number int")).collect()
    assert sorted((r["first"], r["last"]) for r in got) == [(1, 3), (7, 8), (12, 12)]


def test_mobi_records(spark):
    text = "é" * 5000
    got = one(spark, O.mobi_records(F.lit(text)))
    assert [len(r) for r in got] == [4096, 4096, 1808] and b"".join(map(bytes, got)).decode() == text
    assert one(spark, O.mobi_records(F.lit(""))) == []


def test_epub_round_trip_and_broken_book(spark):
    rows = Q.epub_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50 and not any(r["error"] for r in rows)
    got = R.epub_items(spark.createDataFrame([(1, b"not a zip")], "book_id int, data binary")).collect()
    assert len(got) == 1 and "BadZipFile" in got[0]["error"]


def test_titles(spark):
    for html, want in (("<TITLE> My Book </TITLE>", "My Book"), ("<p>", None), ("<title> </title>", None)):
        assert one(spark, R.html_title(F.lit(html))) == want


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run(spark, name):
    assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
