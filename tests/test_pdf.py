"""Books of extracted PDF pages, HTML with its files, EPUB addresses, contents as trees."""

import io
import zipfile

from pyspark.sql import functions as F

from quire.__main__ import main
from quire.functions import text as X
from quire.operators import binary_books
from quire.operators import pdf_pages as P
from quire.operators import transforms as T
from quire.plans import convert as C
from quire.plans import pdf as D
from quire.sources import books as B
from quire.sources import pdf as S

XML = """<pdf2xml><page number="1" width="600" height="800"><fontspec id="0" size="12" family="Times" color="#000"/>
<text top="100" left="50" width="10" height="14" font="0">one</text><text top="200" left="50" width="10" height="14" font="0">two</text>
<image top="150" left="5.5" width="9" height="9" src="a.png"/></page><page number="2"><fontspec id="1" family="GlyphLessFont"/><text top="1" left="1" height="9" font="1">scan</text><image src="s.jpg"/></page></pdf2xml>"""


def test_parse_keeps_whole_pages_before_an_error():
    got = S.parse('<pdf2xml><page number="1"><text top="x" font="2">a</text></page><page number="2"><text>b')
    assert [p[0] for p in got["pages"]] == [1] and got["error"] is None and got["texts"][0][2] == 0.0
    assert S.parse("<pdf2xml></pdf2xml>")["error"] == "no pages" and S.parse("")["error"]


def test_outline_children():
    both = "<item page='1'>A<item page='2'>B</item></item><outline><item>C</item></outline><item page='9'> D </item>"
    rows = S.parse(f"<pdf2xml><page number='1'/><outline>{both}</outline></pdf2xml>")["outline"]
    title = {r[0]: r[3] for r in rows}
    assert sorted((r[3], title.get(r[1]), r[4]) for r in rows) == [("A", None, 1), ("B", "A", 2), ("C", "A", 1), ("D", None, 9)]


def test_blocks_around_pictures(spark):
    lines = [(1, 1, 0, 100.0, 14.0, "one"), (1, 1, 1, 116.0, 14.0, "two"), (1, 1, 2, 160.0, 14.0, "far"), (1, 1, 3, 400.0, 14.0, "late")]
    images = [(1, 1, 0, 130.0, 7.9, "a.jpg"), (1, 1, 1, 130.0, 1.0, "b.jpg"), (1, 2, 2, 5.0, 5.0, "c.jpg")]
    got = P.page_blocks(spark.createDataFrame(lines, "book_id long, number int, line int, top double, height double, text string"), spark.createDataFrame(images, "book_id long, number int, seq long, top double, left double, href string"))
    rows = [(r["number"], r["kind"], r["text"] or r["alt"]) for r in got.orderBy("number", "block").collect()]
    assert rows == [(1, "paragraph", "one two"), (1, "image", "Image at (7, 130)"), (1, "image", "Image at (1, 130)"), (1, "paragraph", "far"), (1, "paragraph", "late"), (2, "image", "Image at (5, 5)")]


def test_engines_and_parts(spark):
    files = spark.createDataFrame([(1, "d/b.pdf.xml", XML, 0), (1, "d/b.pdf.xml", XML.replace('number="1"', 'number="3"').replace('number="2"', 'number="4"'), 1), (2, "x.xml", None, 0)], "book_id long, path string, data string, part int")
    pictures = spark.createDataFrame([(1, "a.png", b"P"), (1, "s.jpg", b"")], "book_id long, src string, data binary")
    rendered = spark.createDataFrame([(1, k, b"R%d" % k) for k in (1, 2, 3)], "book_id long, number int, data binary")
    info = spark.createDataFrame([(1, b"\xfe\xff\x00T", None, b" ")], "book_id long, title binary, author binary, subject binary")
    b = D.pdf_books(files, pictures, rendered, info)
    assert [(r["book_id"], r["stem"], r["title"], r["error"] is None) for r in b.books.orderBy("book_id").collect()] == [(1, "b", "T", True), (2, "x", "Untitled PDF", False)]
    ids = [r["id"] for r in b.manifest.orderBy("pos").collect()]
    assert ids == ["img_1_1", "img_3_2", "img_scan2", "page1", "page2", "page3", "page4", "stylesheet"]
    text = {r["id"]: r["text"] for r in b.manifest.collect()}
    assert 'src="images/scan_page2.jpg" alt="Page 2"' in text["page2"] and "[Page 4]" in text["page4"]
    # a picture that stands on two pages shows its last file
    assert 'src="images/page3_2.jpg"' in text["page1"] and "<p>one</p>" in text["page1"]
    assert [r["title"] for r in b.toc.orderBy("play_order").collect()] == [f"Page {k}" for k in range(1, 5)]
    flat = D.pdf_books(files, pictures, rendered, info, "image-only")
    text = {r["id"]: r["text"] for r in flat.manifest.collect()}
    assert set(text) == {"img1", "img2", "img3", "page1", "page2", "page3", "page4", "stylesheet"}
    assert "<p>one\ntwo</p>" in text["page1"] and 'alt="Page 1 image"' in text["page1"]
    assert D.pdf_books(files.where("false")).manifest.collect() == []


def test_pdf_info_of_own_and_plain_files(spark):
    assert X and S.info(binary_books.pdf_file("Tïtle", [], [([], ["x"])], [])) == {"title": "﻿Tïtle".encode("utf-16-be")}
    data = b"1 0 obj << /Title (a\\(b\\051 \\\n(n) c) /Author <FEFF0041> >> endobj trailer << /Info 1 0 R >>"
    assert S.info(data) == {"title": b"a(b) (n) c", "author": b"\xfe\xff\x00A"}
    assert S.info(None) == {} and S.info(b"/Info 7 0 R") == {}
    table = spark.createDataFrame([(k, x) for k, x in enumerate([b"\xfe\xff\x00A\x00", b"\xef\xbb\xbf\xc3\xa9", b"plain", "é".encode(), b"\xe9", b"", None])], "k int, b binary")
    assert [r[0] for r in table.orderBy("k").select(X.pdf_string(F.col("b"))).collect()] == ["A", "é", "plain", "é", "é", "", None]


def test_command_line_of_html_and_page_xml(tmp_path, capsys, spark):
    book = tmp_path / "in" / "one"
    (book / "img").mkdir(parents=True)
    (book / "x.html").write_text('<html><head><title>X</title><link rel="stylesheet" href="s.css"/></head><body><img src="img/p.png"/>hi</body></html>')
    (book / "s.css").write_text("p { color : red ; }")
    (book / "img" / "p.png").write_bytes(b"PNG")
    assert main([str(book / "x.html"), str(tmp_path / "z.html")]) == 0
    assert (tmp_path / "img" / "p.png").read_bytes() == b"PNG" and "p{color :red}" in (tmp_path / "z.html").read_text()
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--to", "html"]) == 0
    assert [p.read_bytes() for p in (tmp_path / "out").glob("x-*/img/p.png")] == [b"PNG"]
    (tmp_path / "in" / "bad.epub").write_bytes(b"no zip")
    assert main([str(tmp_path / "in"), str(tmp_path / "out2"), "--to", "epub"]) == 1
    assert "bad: BadZipFile" in capsys.readouterr().err
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "b.xml").write_text(XML)
    (tmp_path / "pdf" / "a.png").write_bytes(b"P")
    (tmp_path / "pdf" / "b-02.jpg").write_bytes(b"R")
    (tmp_path / "pdf" / "b.pdf").write_bytes(binary_books.pdf_file("Own title", [], [], []))
    assert main([str(tmp_path / "pdf" / "b.xml"), str(tmp_path / "b.epub"), "--from", "pdfxml"]) == 0
    z = zipfile.ZipFile(io.BytesIO((tmp_path / "b.epub").read_bytes()))
    assert {"OEBPS/images/page1_1.jpg", "OEBPS/images/scan_page2.jpg"} <= set(z.namelist()) and b"Own title" in z.read("OEBPS/content.opf")


def test_epub_addresses_outside_the_package_folder(spark):
    opf = """<package xmlns:dc="http://purl.org/dc/elements/1.1/"><manifest><item id="c" href="../text/a%20b.xhtml" media-type="application/xhtml+xml"/><item id="j" href="x.json" media-type="application/json"/>
      <item id="n" href="nav/toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n"><itemref idref="c"/></spine></package>"""
    ncx = '<ncx><navMap><navPoint><navLabel><text>T</text></navLabel><content src="../../text/a%20b.xhtml#f"/></navPoint></navMap></ncx>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in {"META-INF/container.xml": '<c><rootfile full-path="OPS/p.opf"/></c>', "OPS/p.opf": opf, "text/a b.xhtml": "<html><body>x</body></html>", "OPS/nav/toc.ncx": ncx, "OPS/x.json": "{}"}.items():
            z.writestr(n, t)
    b = B.tables(B.read_books(spark.createDataFrame([(1, "x.epub", out.getvalue())], "book_id long, path string, data binary")))
    items = {r["id"]: r for r in b.manifest.collect()}
    assert items["c"]["href"] == "../text/a b.xhtml" and items["c"]["text"] and items["j"]["text"] == "{}"
    assert [(r["href"], r["depth"]) for r in b.toc.collect()] == [("../text/a b.xhtml#f", 1)]
    back = zipfile.ZipFile(io.BytesIO(bytes(C.write_epub(b).first()["data"])))
    assert "text/a b.xhtml" in back.namelist()


def test_minify_of_large_and_odd_sheets(spark):
    cases = {
        'a { color : red ; }\n/* c */ b > c , d { margin: 0  1px }': "a{color :red}b > c,d{margin:0 1px}",
        'a{content:"/* keep */"} /* "x" */ b{x:y}': 'a{content:"/* keep */"}b{x:y}',
        "p { content: 'it\\'s  ;  }' }": "p{content:'it\\'s  ;  }'}",
        "a{b:1px/**/2px} div/*x*/.c{d:e}": "a{b:1px 2px}div.c{d:e}",
        'a{content:"open}': 'a{content:"open}',
        "": "",
    }
    long = ["x{y:url(data:a/b;base64," + "A" * 1_000_000 + ')}z{c:"' + "x" * 1_000_000 + '"}', '"' + 'a\\"' * 300_000 + '"', "/*" + "* " * 300_000 + "*/"]
    table = spark.createDataFrame([(k, c) for k, c in enumerate([*cases, *long])], "k int, c string")
    got = [r[0] for r in table.select("k", T.minify_css(F.col("c")).alias("m")).orderBy("k").select("m").collect()]
    assert got == [*cases.values(), *long[:2], ""]


def test_headings_rows_carry_no_text(spark):
    table = spark.createDataFrame([(1, "<h2>Title é</h2><p>text</p>" * 20_000, "mine"), (2, None, "x"), (3, "", "y")], "i int, text string, title2 string")
    rows = T.headings(table)
    assert rows.columns == ["i", "title2", "level", "byte_offset", "title"] and rows.count() == 20_000
    assert rows.agg(F.max("byte_offset")).first()[0] == 19_999 * len("<h2>Title é</h2><p>text</p>".encode())
