"""Readers of whole files, the chain of transforms, writers, the command line, the stream."""

import base64
import io
import zipfile

import numpy as np
import pytest

from quire.__main__ import main
from quire.functions import png
from quire.operators import binary_books as BB
from quire.options import Options
from quire.plans import convert as C
from quire.sources import books as R
from quire.sources import mobi, office
from quire.streaming import driver

PIXELS = np.arange(40 * 30 * 3, dtype=np.uint8).reshape(40, 30, 3)


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://r" xmlns:a="http://a"'
DOCX = zipped(
    docProps__core_dot_xml='<c xmlns:dc="d"><dc:title>T</dc:title><dc:creator>Me</dc:creator><keywords>a, b</keywords></c>',
    word__styles_dot_xml=f'<w:styles {W}><w:style w:styleId="A"><w:name w:val="heading 2"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/></w:style><w:style w:styleId="C"><w:basedOn w:val="D"/></w:style><w:style w:styleId="D"><w:basedOn w:val="C"/></w:style></w:styles>',
    word__numbering_dot_xml=f'<w:numbering {W}><w:abstractNum w:abstractNumId="1"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum></w:numbering>',
    word___rels__document_dot_xml_dot_rels='<R><Relationship Id="r1" Target="media/p.png"/><Relationship Id="r2" Target="http://x"/></R>',
    word__media__p_dot_png=png.encode(PIXELS),
    word__document_dot_xml=f"""<w:document {W}><w:body>
      <w:p><w:pPr><w:pStyle w:val="B"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
      <w:p><w:pPr><w:pStyle w:val="C"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b w:val="false"/><w:i/></w:rPr><w:t>x &lt; y</w:t></w:r><w:hyperlink r:id="r2"><w:r><w:t>l</w:t></w:r></w:hyperlink></w:p>
      <w:p><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>
      <w:p><w:pPr><w:numPr><w:numId w:val="9"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>
      <w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t><w:tab/></w:r></w:p></w:tc></w:tr></w:tbl>
      <w:p/><w:p><w:r><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r></w:p></w:body></w:document>""",
)


def body(book):
    doc = next(i for i in book["items"] if i[0] == "content")[3]
    return doc.split("<body>\n")[1].split("\n</body>")[0]


def test_docx():
    book = office.read_docx(DOCX, "stem")
    assert body(book) == (
        '<h2>Head</h2>\n<p class="docx-center"><b><i>x &lt; y</i></b><a href="http://x">l</a></p>\n<ol>\n<li>one</li>\n</ol>\n<ul>\n<li>two</li>\n</ul>\n'
        '<table>\n<tr><td><p>c&#160;&#160;&#160;&#160;</p>\n</td></tr>\n</table>\n<p><img src="media/p.png" alt=""/></p>\n'
    )
    assert book["metadata"] == [("title", "T"), ("creator", "Me"), ("subject", "a"), ("subject", "b")]
    assert book["items"][0][1:3] == ("media/p.png", "image/png") and book["toc"] == [("Head", "content.xhtml")]
    with pytest.raises(ValueError):
        office.read_docx(zipped(x="y"), "s")


def test_odt():
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="t" xmlns:style="s" xmlns:draw="d" xmlns:xlink="x" xmlns:table="b"'
    content = f'<o {ns}><style:style style:name="P1" style:parent-style-name="Heading_20_3"/><office:body><office:text><text:h text:outline-level="1">A</text:h><text:p text:style-name="P1">h</text:p><text:p>a<text:s text:c="2"/>b<text:span text:style-name="Bold_Italic">c</text:span><text:line-break/>&amp;<draw:image xlink:href="Pictures/p.gif"/></text:p><text:list><text:list-item><text:p>i</text:p><text:list><text:list-item><text:p>j</text:p></text:list-item></text:list></text:list-item></text:list><table:table><table:table-row><table:table-cell><text:p>c</text:p></table:table-cell></table:table-row></table:table></office:text></office:body></o>'
    book = office.read_odt(zipped(content_dot_xml=content, Pictures__p_dot_gif="GIF8"), "stem")
    assert body(book) == '<h1>A</h1>\n<h1>h</h1>\n<p>a  b<strong><em>c</em></strong><br/>&amp;<img src="images/p.gif" alt=""/></p>\n<ul>\n<li><p>i</p>\n<p>j</p>\n</li>\n</ul>\n<table>\n<tr><td><p>c</p>\n</td></tr>\n</table>\n'
    assert book["items"][0][1:3] == ("images/p.gif", "image/gif") and book["metadata"][0] == ("title", "stem")


def test_rtf():
    html = office.rtf_html("{\\rtf1\\ansi{\\fonttbl{\\f0 Times;}}{\\*\\x y}\\qc Hello {\\b bold {\\i both}} \\u233?x\\'e9 \\{<\\}\\par\\pard\n\\u-10179?\\u-8704?\\par}")
    assert html == '<p class="center">Hello <strong>bold </strong><em><strong>both</strong></em> éxé {&lt;}</p>\n<p>\U0001f600</p>\n'
    assert office.rtf_html("") == "" and office.rtf_html("{\\rtf1 }}}") == ""
    with pytest.raises(ValueError):
        office.read_rtf(b"plain", "s")


def test_mobi():
    picture = png.encode(PIXELS)
    text = '<html><body><p>é</p><img recindex="1"/><img recindex="7"/><mbp:pagebreak/><a filepos=12>x</a></body></html>'
    data = BB.mobi_file("Títle" * 10, [("title", "Títle"), ("creator", "A; B & C"), ("language", "fr")], text + " " * 9000, [picture])
    book = mobi.read_mobi(data, "s")
    assert body(book).strip() == '<p>é</p><img src="images/image_0001.png"/><img recindex="7"/><div class="mbp_pagebreak"></div><a>x</a>'
    assert [v for t, v in book["metadata"] if t == "creator"] == ["A", "B", "C"] and book["items"][0][4] == picture
    assert data[60:68] == b"BOOKMOBI" and data[31] == 0 and int.from_bytes(data[76:78], "big") == 1 + 3 + 1 + 3
    assert mobi.unpack_palmdoc(b"abc\x80\x18\x02\x01\x02\xe1") == b"abcabc\x01\x02 a"


def test_png():
    assert (png.decode(png.encode(PIXELS)) == PIXELS).all()
    flat = np.full((50, 80, 4), 77, np.uint8)
    data, what = png.shrink(png.encode(flat), "image/png", (20, 20))
    assert what == "resized" and png.size(data) == (20, 13) and (png.decode(data) == 77).all()
    assert png.shrink(b"broken", "image/png", (1, 1)) == (b"broken", "kept") and png.shrink(data, "image/png", (20, 20))[1] == "fits"


def test_pdf():
    data = BB.pdf_file("T (x)", ["A"], [([(1, "Head")], ["word " * 4000])], [png.encode(PIXELS), b"\xff\xd8broken"])
    assert data.startswith(b"%PDF-1.4") and data.count(b"/Type /Page ") > 3 and data.count(b"/Subtype /Image") == 1
    at = int(data.split(b"startxref\n")[1].split()[0])
    assert data[at : at + 4] == b"xref"
    assert BB.wrap("a " * 100)[0] == ("a " * 41).strip() and BB.wrap("x" * 100) == ["x" * 100] and BB.wrap(" ") == []


LONG = "<p>" + "word " * 3000 + "</p>"
URI = "data:image/png;base64," + base64.b64encode(png.encode(PIXELS)).decode()
PAGE = f'<html><head><title>My Page</title></head><body><h1>One</h1>{LONG}<img src="{URI}"/><h1>Two</h1>{LONG}</body></html>'


def books(spark):
    rows = [(1, "d/a.html", PAGE.encode()), (2, "d/my_notes.txt", b"a & b\n\nc"), (3, "d/x.docx", DOCX), (4, "d/bad.epub", b"zip?"), (5, "d/y.zzz", b""), (6, "d/n.txt", None)]
    return R.tables(R.read_books(spark.createDataFrame(rows, "book_id long, path string, data binary")))


def test_chain(spark):
    raw = books(spark)
    errors = {r["book_id"]: r["error"] for r in raw.books.collect()}
    assert [k for k, e in errors.items() if e is None] == [1, 2, 3] and "no reader" in errors[5] and "no data" in errors[6]
    done = C.apply(raw, C.standard_stages(Options(insert_metadata=True, max_image_size=(10, 10), extra_css="p { x : y }")))
    items = {(r["book_id"], r["id"]): r for r in done.manifest.collect()}
    assert [i for b, i in sorted(items) if b == 1] == ["content", "content_ch4", "css3", "dataimg1", "jacket2"]
    assert png.size(bytes(items[1, "dataimg1"]["data"])) == (8, 10)
    assert "data_image_1.png" in items[1, "content"]["text"] and "<h1>Two</h1>" in items[1, "content_ch4"]["text"]
    spine = [r["idref"] for r in done.spine.where("book_id = 1").orderBy("pos").collect()]
    assert spine == ["jacket2", "content", "content_ch4"]
    toc = [(r["title"], r["href"]) for r in done.toc.where("book_id = 1").orderBy("play_order").collect()]
    assert toc == [("My Page", "content.xhtml")]
    assert "/* Extra" not in items[2, "style"]["text"] and items[2, "style"]["text"].endswith("p{x :y}")


def test_writers(spark):
    split = [(n, st) for n, st in C.standard_stages(Options()) if n in ("merge_metadata", "split_chapters")]
    done = C.apply(books(spark), split)
    for target in C.WRITERS:
        got = {r["book_id"]: r for r in C.convert(done, target, stages=[]).collect()}
        assert sorted(got) == [1, 2, 3, 4, 5, 6] and got[4]["data"] is None and got[4]["error"]
        assert all(got[k]["data"] for k in (1, 2, 3))
        if target == "txt":
            assert bytes(got[2]["data"]).decode() == "my_notes\n========\n\na & b\n\nc"
        if target == "epub":
            back = R.read_epub(bytes(got[1]["data"]), "s")
            assert [i for i, _ in back["spine"]] == ["content", "content_ch1"]
        if target == "mobi":
            assert "One" in body(mobi.read_mobi(bytes(got[1]["data"]), "s"))
    with pytest.raises(ValueError):
        C.convert(done, "docx")


def test_empty(spark):
    none = R.tables(R.read_books(spark.createDataFrame([], "book_id long, path string, data binary")))
    assert C.convert(none, "epub", stages=[]).collect() == [] and C.convert(none, "txt", stages=[("split_chapters", C.split_chapters)]).collect() == []


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text(PAGE)
    (tmp_path / "in" / "b.md").write_text("# Hi\n\nyou")
    assert main(["--dump-config", "--jpeg-quality", "900", "--max-image-size", "bad"]) == 0
    assert "jpeg_quality = 100" in capsys.readouterr().out
    assert main([str(tmp_path / "in" / "b.md"), str(tmp_path / "b.txt")]) == 0
    assert (tmp_path / "b.txt").read_text() == "b\n=\n\nHi\n\nyou"
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--to", "epub"]) == 0
    assert len(list((tmp_path / "out").glob("*.epub"))) == 2
    C.dump(books(spark), str(tmp_path / "dump"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "dump" / "manifest")).count() == 6
    assert main([str(tmp_path / "in"), str(tmp_path / "x.docx")]) == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("one")
    run = lambda: driver.convert_stream(spark, str(src), str(tmp_path / "t"), "txt", str(tmp_path / "c"), stages=[], once=True).awaitTermination(120)
    assert run()
    (src / "b.txt").write_text("two")
    assert run()
    got = {r["stem"]: bytes(r["data"]).decode() for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {"a": "a\n=\n\none", "b": "b\n=\n\ntwo"}


def test_package_terms_series_and_bookid(spark):
    opf = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title>
      <dc:identifier>isbn</dc:identifier><dc:identifier id="bookid">own</dc:identifier><dc:description>a &lt; b</dc:description><dc:publisher>P</dc:publisher><dc:date>2001</dc:date><series>S</series><series_index>2</series_index></metadata>
      <manifest><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>"""
    data = zipped(**{"META-INF/container.xml": '<c><rootfile full-path="content.opf"/></c>', "content.opf": opf, "c.xhtml": "<html><body><p>x</p></body></html>"})
    b = R.tables(R.read_books(spark.createDataFrame([(1, "x.epub", data)], "book_id long, path string, data binary")))
    assert [r["uid"] for r in b.books.collect()] == ["own"]
    back = zipfile.ZipFile(io.BytesIO(bytes(C.write_epub(b).first()["data"]))).read("OEBPS/content.opf").decode()
    assert '<dc:identifier id="bookid">own</dc:identifier>' in back
    assert "<dc:description>a &lt; b</dc:description>\n<dc:publisher>P</dc:publisher>\n<dc:date>2001</dc:date>\n</metadata>" in back
    page = C.jacket(True, False)(b).manifest.where("href = 'jacket.xhtml'").first()["text"]
    assert '<p class="series">S #2</p>' in page
