"""Further registered queries: formats as archives, contents as trees, PDF pages, HTML with its files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import collection as K
from ..operators import pdf_pages as P
from ..operators import sinks as O
from ..operators import transforms as T
from ..sources import books as B
from ..sources import pdf as S
from . import convert as C
from . import pdf as D
from .queries import _CLEAN, _DOC, _ESC, _GRID, ORACLES, _content, _files, _pages, _read, query


def _id() -> Column:
    return F.col("book_id").cast("string")



def _archives(df: DataFrame) -> DataFrame:
    """df: book_id and ``parts``, structs of name and text. ``book_id`` and ``data``, a ZIP of them."""
    kind = df.schema["book_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for parts in batch.column(1).to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for p in parts:
                        z.writestr(zipfile.ZipInfo(p["name"], (1980, 1, 1, 0, 0, 0)), p["text"])
                data.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["book_id", "data"])

    return df.select("book_id", "parts").mapInArrow(run, f"book_id {kind}, data binary")


def _parts(**texts: Column) -> Column:
    """Names with a double underscore for a slash, and ``_`` at the end for none."""
    return F.array(*[F.struct(F.lit(n.replace("__", "/").replace("_dot_", ".")).alias("name"), t.alias("text")) for n, t in texts.items()])


def _clean_docs(spark, sf_dir) -> DataFrame:
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7E\\n]", "")
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), t.alias("t"))


@query("""SELECT page_id, 'a{content :"  ' || url || ' ; /* x */  ";margin :0,1px}b > c{color :red}' AS css,
                 '/* never ' || url AS torn FROM pages""")
def css_minify(spark, sf_dir):
    """A sheet with a comment, a string that looks like one, and white space; and a torn one."""
    p = _read(spark, sf_dir, "pages")
    sheet = F.concat(F.lit("/* "), "url", F.lit(' */ a { content : "  '), "url", F.lit(' ; /* x */  " ; margin : 0 ,  1px }\n\n  b  >  c { color : red ; }'))
    return p.select("page_id", T.minify_css(sheet).alias("css"), T.minify_css(F.concat(F.lit("/* never "), "url")).alias("torn"))


@query("""SELECT page_id AS book_id, 'ch ' || page_id || ' é.xhtml' AS href, md5(html) AS text_md5, 'ch ' || page_id || ' é.xhtml#a b' AS toc_href,
                 CAST(1 AS INTEGER) AS toc_depth, 'ch ' || page_id || ' é.xhtml' AS guide_href, CAST(NULL AS VARCHAR) AS error FROM pages""")
def epub_escaped(spark, sf_dir):
    """Pages as EPUBs whose addresses are percent-encoded in package, contents and guide."""
    pages = _pages(spark, sf_dir).withColumn("href", F.concat(F.lit("ch "), _id(), F.lit(" é.xhtml"))).withColumn("data", F.lit(None).cast("binary"))
    coded = F.concat(F.lit("ch%20"), _id(), F.lit("%20%C3%A9.xhtml"))
    guide = F.array(F.struct(F.lit("text").alias("ref_type"), F.lit("T").alias("title"), F.concat(F.lit("OEBPS/"), coded).alias("href")))
    toc = F.array(F.struct(F.lit("T").alias("title"), F.concat(coded, F.lit("#a%20b")).alias("href")))
    books = pages.select(
        "book_id",
        O.opf(_id(), _id(), F.lit("en"), F.array().cast("array<string>"), F.array(F.struct("id", coded.alias("href"), "media_type")), F.array(F.struct(F.col("id").alias("idref"), F.lit(True).alias("linear"))), guide).alias("opf"),
        O.ncx(_id(), _id(), toc).alias("ncx"),
    )
    got = B.read_books(_files(O.epub_files(books, pages), "x.epub", F.col("data")))
    item = F.filter("items", lambda i: i["id"] == "content")[0]
    return got.select("book_id", item["href"].alias("href"), F.md5(item["text"]).alias("text_md5"), F.col("toc")[0]["href"].alias("toc_href"), F.col("toc")[0]["depth"].alias("toc_depth"), F.col("guide")[0]["href"].alias("guide_href"), "error")


@query("""SELECT page_id AS book_id, CAST(n AS INTEGER) AS play_order, title || page_id AS title, 'x.xhtml#' || n AS href, CAST(d AS INTEGER) AS depth, CAST(u AS INTEGER) AS parent
          FROM pages, (VALUES (1, 'A', 1, NULL), (2, 'B', 2, 1), (3, 'C', 3, 2), (4, 'D', 2, 1), (5, 'E', 1, NULL), (6, 'F', 2, 5)) t(n, title, d, u)""")
def toc_nested(spark, sf_dir):
    """Contents of three levels, read from a navigation file; the tree by depth and by parent."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"))
    point = lambda t, n, inner=(): F.concat(F.lit(f"<navPoint><navLabel><text>{t}"), _id(), F.lit(f'</text></navLabel><content src="x.xhtml#{n}"/>'), *inner, F.lit("</navPoint>"))
    ncx = F.concat(F.lit("<ncx><navMap>"), point("A", 1, [point("B", 2, [point("C", 3)]), point("D", 4)]), point("E", 5, [point("F", 6)]), F.lit("</navMap></ncx>"))
    opf = F.lit('<package><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n"/></package>')
    parts = _parts(**{"META-INF__container_dot_xml": F.lit('<c><rootfile full-path="p.opf"/></c>'), "p_dot_opf": opf, "toc_dot_ncx": ncx})
    books = B.tables(B.read_books(_files(_archives(pages.select("book_id", parts.alias("parts"))), "x.epub", F.col("data"))))
    return T.toc_tree(books.toc).select("book_id", "play_order", "title", "href", "depth", "parent")


@query("""WITH RECURSIVE n AS (SELECT page_id // 10 AS book_id, page_id AS node_id, CASE WHEN page_id % 10 < 2 THEN NULL ELSE page_id // 10 * 10 + (page_id % 10 - 2) // 2 END AS parent_id, (page_id * 7 + 3) % 11 AS pos FROM pages),
          t AS (SELECT book_id, node_id, [pos, node_id] AS path, 1 AS depth FROM n WHERE parent_id IS NULL
                UNION ALL SELECT n.book_id, n.node_id, list_concat(t.path, [n.pos, n.node_id]), t.depth + 1 FROM n JOIN t ON n.book_id = t.book_id AND n.parent_id = t.node_id)
          SELECT book_id, node_id, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY book_id ORDER BY path) AS INTEGER) AS play_order FROM t""")
def depth_first(spark, sf_dir):
    """Forests of ten pages, numbered depth first."""
    i = F.col("page_id")
    book = F.floor(i / 10).cast("long")
    nodes = _read(spark, sf_dir, "pages").select(book.alias("book_id"), i.alias("node_id"), F.when(i % 10 >= 2, book * 10 + F.floor((i % 10 - 2) / 2)).cast("long").alias("parent_id"), ((i * 7 + 3) % 11).alias("pos"))
    return T.depth_first(nodes).select("book_id", "node_id", "depth", "play_order")


@query("SELECT page_id, md5(replace(html, '<article>', '<article><p>x</p><img src=\"b.png\"/>')) AS html_md5 FROM pages")
def first_image(spark, sf_dir):
    """Two pictures are written into each page, and the first is taken out again."""
    p = _read(spark, sf_dir, "pages")
    two = F.replace("html", F.lit("<article>"), F.lit('<article><img class="c" src="a.png"><p>x</p><img src="b.png"/>'))
    return p.select("page_id", F.md5(T.remove_first_image(two)).alias("html_md5"))


@query(r"""WITH s AS (SELECT page_id, html || '<p style="margin: 20px;color: red;">' AS t FROM pages)
           SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN regexp_replace(t, 'margin\s*:\s*[^;]+;?', '', 'g') ELSE t END) AS html_md5 FROM s""")
def template_margin(spark, sf_dir):
    """Margins go from page templates, and stay elsewhere."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit('<p style="margin: 20px;color: red;">')).alias("t"))
    media = F.when(F.col("page_id") % 2 == 0, T.PAGE_TEMPLATES[0]).otherwise(T.XHTML[0])
    return p.select("page_id", F.md5(T.template_margins(media, F.lit("xhtml"), F.col("t"))).alias("html_md5"))


_LINES = "list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')"


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(t, '[^A-Za-z0-9 ]', '', 'g') AS t FROM (SELECT doc_id, {_CLEAN} AS t FROM documents))
           SELECT doc_id AS book_id, md5({_DOC.format(title="'x'", body="'<h1>T' || doc_id || '</h1>' || chr(10) || CASE WHEN trim(t) = '' THEN '' ELSE '<p>' || trim(t) || '</p>' || chr(10) END || '<ul>' || chr(10) || '<li>a</li>' || chr(10) || '<li><strong>b</strong></li>' || chr(10) || '</ul>' || chr(10)")}) AS doc_md5, CAST(1 AS INTEGER) AS n_toc, CAST(NULL AS VARCHAR) AS error FROM d""")
def markdown_read(spark, sf_dir):
    """Documents (letters, digits and blanks) as a Markdown paragraph below a heading, with a list."""
    d = _clean_docs(spark, sf_dir)
    text = F.concat(F.lit("# T"), _id(), F.lit("\n\n"), F.regexp_replace("t", "[^A-Za-z0-9 ]", ""), F.lit("\n\n* a\n* **b**\n"))
    return _content(B.read_books(_files(d.withColumn("m", text), "x.md", F.col("m"))))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split({_CLEAN}, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)
           SELECT doc_id AS book_id, array_to_string(list_transform(ls, lambda x: '<p><b>' || {_ESC.format('x')} || '</b></p>'), '') AS html, CAST(NULL AS VARCHAR) AS error FROM d""")
def docx_read(spark, sf_dir):
    """Documents as DOCX, a bold paragraph for each line, and read."""
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">'), X.escape_text(x), F.lit("</w:t></w:r></w:p>"))), "")
    xml = F.concat(F.lit(f"<w:document {_W}><w:body>"), body, F.lit("</w:body></w:document>"))
    books = B.read_books(_files(_archives(_clean_docs(spark, sf_dir).select("book_id", _parts(**{"word__document_dot_xml": xml}).alias("parts"))), "x.docx", F.col("data")))
    return _paragraphs(books)


_O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split({_CLEAN}, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)
           SELECT doc_id AS book_id, '<h2>T' || doc_id || '</h2>' || array_to_string(list_transform(ls, lambda x: '<p>' || {_ESC.format('x')} || '</p>'), '') AS html, CAST(NULL AS VARCHAR) AS error FROM d""")
def odt_read(spark, sf_dir):
    """Documents as ODT, a paragraph for each line below a heading, and read."""
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<text:p>"), X.escape_text(x), F.lit("</text:p>"))), "")
    xml = F.concat(F.lit(f'<office:document-content {_O}><office:body><office:text><text:h text:outline-level="2">T'), _id(), F.lit("</text:h>"), body, F.lit("</office:text></office:body></office:document-content>"))
    books = B.read_books(_files(_archives(_clean_docs(spark, sf_dir).select("book_id", _parts(**{"content_dot_xml": xml}).alias("parts"))), "x.odt", F.col("data")))
    return _paragraphs(books)


def _paragraphs(books: DataFrame) -> DataFrame:
    """The headings and paragraphs of each book's document, without what stands between them."""
    text = F.try_element_at(F.filter("items", lambda i: i["id"] == "content"), F.lit(1))["text"]
    found = F.regexp_extract_all(X.body_or_all(text), F.lit(r"(?s)<(?:p|h\d)[ >].*?</(?:p|h\d)>"), F.lit(0))
    return books.select("book_id", F.array_join(found, "").alias("html"), "error")


def _pdf_source(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Page XML made of each web page's address: a page of text around a picture, an empty one, one
    with a picture only; an outline of as many entries as the id leaves modulo 5. And the pictures,
    of which some are missing."""
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), F.regexp_replace("url", "[^A-Za-z0-9/]", "").alias("u"))
    line = lambda top, left, inner: F.concat(F.lit(f'<text top="{top}" left="{left}" width="9" height="14" font="0">'), *inner, F.lit("</text>"))
    first = [line(100, 80, [F.lit("<b>"), "u", F.lit("</b>")]), line(101.5, 10, [F.lit("w"), _id()]), line(116, 5, [F.lit("x &amp; y")]), line(160, 5, [F.lit("far")]), line(176, 5, [F.lit("near")]), line(190, 5, [F.lit(" ")])]
    item = lambda i: F.when(F.col("book_id") % 5 >= i, F.concat(F.lit(f'<item page="{i}">T{i} '), "u", F.lit("</item>" + ("<outline><item page=\"3\">sub</item></outline>" if i == 1 else "")))).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<pdf2xml><page number="1" width="600" height="800"><fontspec id="0" size="12" family="Times" color="#000"/>'), *first,
        F.lit('<image top="170" left="7" width="9" height="9" src="a.png"/></page><page number="2"/><page number="3"><image top="1" left="2" width="3" height="4" src="b.jpg"/></page><outline>'),
        *[item(i) for i in range(1, 5)], F.lit("</outline></pdf2xml>"),
    )
    pictures = p.where("book_id % 2 = 0").select("book_id", F.lit("a.png").alias("src"), F.lit("PNG").cast("binary").alias("data"))
    pictures = pictures.unionByName(p.where("book_id % 3 = 0").select("book_id", F.lit("b.jpg").alias("src"), F.lit("JPEG").cast("binary").alias("data")))
    return p.select("book_id", F.lit("x.pdf.xml").alias("path"), xml.alias("data")), pictures


_PDF_PAGE = _DOC.format(title="'Page ' || {n}", body="'  <div class=\"page\">' || chr(10) || {body} || '  </div>'")
_U = "regexp_replace(url, '[^A-Za-z0-9/]', '', 'g')"
_PIC = "'    <div class=\"page-image\"><img src=\"' || {} || '\" alt=\"' || {} || '\"/></div>' || chr(10)"
_P = "'    <p>' || {} || '</p>' || chr(10)"
_PDF_ONE = (
    _P.format("'w' || page_id || ' <b>' || u || '</b> x & y'") + " || CASE WHEN a THEN " + _P.format("'far'") + " || " + _PIC.format("'images/page1_1.jpg'", "'Image at (7, 170)'") + " || " + _P.format("'near'") + " ELSE " + _P.format("'far near'") + " END"
)
_PDF_THREE = "CASE WHEN b THEN " + _PIC.format("CASE WHEN a THEN 'images/page3_2.jpg' ELSE 'images/page3_1.jpg' END", "'Page 3 image'") + " ELSE '    <p class=\"empty-page\">[Page 3]</p>' || chr(10) END"


@query(f"""WITH s AS (SELECT page_id, {_U} AS u, page_id % 2 = 0 AS a, page_id % 3 = 0 AS b FROM pages),
           i AS (SELECT page_id, 1 AS k, 'img_1_1' AS id, 'images/page1_1.jpg' AS href, 'image/png' AS media_type, CAST(NULL AS VARCHAR) AS text_md5, CAST(3 AS INTEGER) AS n_bytes FROM s WHERE a
                 UNION ALL SELECT page_id, 2, CASE WHEN a THEN 'img_3_2' ELSE 'img_3_1' END, CASE WHEN a THEN 'images/page3_2.jpg' ELSE 'images/page3_1.jpg' END, 'image/jpeg', NULL, 4 FROM s WHERE b
                 UNION ALL SELECT page_id, 3, 'page1', 'page1.xhtml', 'application/xhtml+xml', md5({_PDF_PAGE.format(n=1, body=_PDF_ONE)}), NULL FROM s
                 UNION ALL SELECT page_id, 4, 'page2', 'page2.xhtml', 'application/xhtml+xml', md5({_PDF_PAGE.format(n=2, body="'    <p class=" + chr(34) + "empty-page" + chr(34) + ">[Page 2]</p>' || chr(10)")}), NULL FROM s
                 UNION ALL SELECT page_id, 5, 'page3', 'page3.xhtml', 'application/xhtml+xml', md5({_PDF_PAGE.format(n=3, body=_PDF_THREE)}), NULL FROM s
                 UNION ALL SELECT page_id, 6, 'stylesheet', 'style.css', 'text/css', md5('{D.STYLE}'), NULL FROM s)
           SELECT page_id AS book_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos, id, href, media_type, text_md5, n_bytes FROM i""")
def pdf_book(spark, sf_dir):
    """The items of books made of page XML and its pictures."""
    files, pictures = _pdf_source(spark, sf_dir)
    m = D.pdf_books(files, pictures, engine="text-only").manifest
    return m.select("book_id", "pos", "id", "href", "media_type", F.md5("text").alias("text_md5"), F.octet_length("data").alias("n_bytes"))


@query(f"""WITH s AS (SELECT page_id, {_U} AS u, page_id % 5 AS n FROM pages)
           SELECT page_id AS book_id, CAST(CASE WHEN i > 1 THEN i + 1 ELSE 1 END AS INTEGER) AS play_order, 'T' || i || ' ' || u AS title, 'page' || i || '.xhtml' AS href, CAST(1 AS INTEGER) AS depth FROM s, generate_series(1, 4) g(i) WHERE n >= 3 AND i <= n
           UNION ALL SELECT page_id, 2, 'sub', 'page3.xhtml', 2 FROM s WHERE n >= 3
           UNION ALL SELECT page_id, i, 'Page ' || i, 'page' || i || '.xhtml', 1 FROM s, generate_series(1, 3) g(i) WHERE n < 3""")
def pdf_outline(spark, sf_dir):
    """Contents of the same books: the outline where it is rich enough, else the pages."""
    files, _ = _pdf_source(spark, sf_dir)
    t = D.tables(S.pdf_parts(files, "data"))
    return P.outline_toc(t["outline"], t["pages"])


@query("SELECT page_id AS book_id, CAST(1 AS BIGINT) AS n_text, CAST(0 AS BIGINT) AS n_scanned, CAST(1 AS BIGINT) AS n_image_only, CAST(1 AS BIGINT) AS n_blank, CAST(3 AS BIGINT) AS n_pages FROM pages")
def pdf_counts(spark, sf_dir):
    """How many pages of the same books are of each class."""
    files, _ = _pdf_source(spark, sf_dir)
    t = D.tables(S.pdf_parts(files, "data"))
    texts = t["texts"].select("book_id", "number", "font_id", X.inner_text(F.col("inner_html")).alias("text"))
    return P.page_counts(P.classify_pages(t["pages"], texts, t["fonts"], t["images"]))


@query("SELECT doc_id, md5(coalesce(text, '')) AS wide_md5, md5(coalesce(text, '')) AS marked_md5, md5(coalesce(text, '')) AS plain_md5 FROM documents WHERE text IS NULL OR text NOT LIKE chr(65279) || '%'")
def pdf_strings(spark, sf_dir):
    """Documents as UTF-16 and as UTF-8 with and without a mark, decoded as PDF strings."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).where(~F.startswith("t", F.lit("\ufeff")))
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode("t", "UTF-16BE"))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("t", "UTF-8"))
    return d.select("doc_id", *[F.md5(X.pdf_string(c)).alias(n) for n, c in (("wide_md5", wide), ("marked_md5", marked), ("plain_md5", F.encode("t", "UTF-8")))])


def _html_files(spark, sf_dir) -> DataFrame:
    """Each web page in a folder of its own, with a sheet beside some and a picture beside all."""
    p = _read(spark, sf_dir, "pages")
    folder = F.concat(F.lit("/b/"), F.col("page_id").cast("string"), F.lit("/"))
    page = F.concat(F.lit('<html><head><link rel="stylesheet" href="s.css"/></head><body><img src="i/../p.png"/><img src="http://x/y.png"/><img src="none.gif"/><img src="i/../p.png"/>'), "url", F.lit("</body></html>"))
    one = lambda rows, name, data, salt: rows.select((F.col("page_id") * 10 + salt).alias("book_id"), F.concat(folder, F.lit(name)).alias("path"), data.cast("binary").alias("data"))
    return one(p, "x.html", page, 0).unionByName(one(p.where("page_id % 2 = 0"), "s.css", F.concat(F.lit("/* "), "url", F.lit(" */")), 1)).unionByName(one(p, "p.png", F.col("url"), 2))


@query("""WITH s AS (SELECT page_id * 10 AS book_id, url, page_id % 2 = 0 AS css FROM pages)
          SELECT book_id, CAST(0 AS INTEGER) AS pos, 'css1' AS id, 's.css' AS href, 'text/css' AS media_type, md5('/* ' || url || ' */') AS md5 FROM s WHERE css
          UNION ALL SELECT book_id, CASE WHEN css THEN 1 ELSE 0 END, CASE WHEN css THEN 'img2' ELSE 'img1' END, 'i/../p.png', 'image/png', md5(url) FROM s
          UNION ALL SELECT book_id, CASE WHEN css THEN 2 ELSE 1 END, 'content', 'content.xhtml', 'application/xhtml+xml', md5('<html><head><link rel="stylesheet" href="s.css"/></head><body><img src="i/../p.png"/><img src="http://x/y.png"/><img src="none.gif"/><img src="i/../p.png"/>' || url || '</body></html>') FROM s""")
def html_assets(spark, sf_dir):
    """Web pages read with the sheets and pictures beside them."""
    files = _html_files(spark, sf_dir)
    b = B.with_assets(B.tables(B.read_books(files.where(F.endswith("path", F.lit(".html"))))), files)
    return b.manifest.select("book_id", "pos", "id", "href", "media_type", F.md5(F.coalesce(F.col("text").cast("binary"), "data")).alias("md5"))


@query("SELECT page_id * 10 AS book_id, 'i/../p.png' AS href, url AS payload FROM pages")
def html_pictures(spark, sf_dir):
    """The pictures that the same books leave beside their HTML output."""
    files = _html_files(spark, sf_dir)
    b = B.with_assets(B.tables(B.read_books(files.where(F.endswith("path", F.lit(".html"))))), files)
    return C.write_html(b).select("book_id", F.explode("files").alias("f")).select("book_id", "f.href", F.col("f.data").cast("string").alias("payload"))


@query(f"""WITH p AS (SELECT page_id AS book_id, {_ESC.format('url')} AS u FROM pages)
           SELECT book_id, CAST(n AS INTEGER) AS play_order, CASE WHEN n = 1 THEN replace(replace(replace(u, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') ELSE 'a & b' END AS title, 'content.xhtml#' || n AS href, CAST(1 AS INTEGER) AS depth FROM p, generate_series(1, 2) g(n)""")
def ncx_round_trip(spark, sf_dir):
    """Contents of two entries written as a navigation file and read again."""
    pages = _pages(spark, sf_dir).withColumn("data", F.lit(None).cast("binary")).join(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), "url"), "book_id")
    entry = lambda t, n: F.struct(t.alias("title"), F.lit(f"content.xhtml#{n}").alias("href"))
    none = F.array().cast("array<struct<ref_type:string,title:string,href:string>>")
    books = pages.select(
        "book_id",
        O.opf(_id(), _id(), F.lit("en"), F.array().cast("array<string>"), F.array(F.struct("id", "href", "media_type")), F.array(F.struct(F.col("id").alias("idref"), F.lit(True).alias("linear"))), none).alias("opf"),
        O.ncx(_id(), _id(), F.array(entry(F.col("url"), 1), entry(F.lit("a & b"), 2))).alias("ncx"),
    )
    got = B.tables(B.read_books(_files(O.epub_files(books, pages), "x.epub", F.col("data"))))
    return got.toc.select("book_id", "play_order", "title", "href", "depth")


@query("""WITH m AS (SELECT page_id // 7 AS book_id, html AS t, CASE WHEN page_id % 3 = 0 THEN 'image/svg+xml' ELSE 'text/html' END AS media_type FROM pages)
          SELECT book_id, count(*) AS n_items, CAST(sum(CASE WHEN media_type LIKE 'image/%' THEN 1 ELSE 0 END) AS BIGINT) AS n_images, CAST(sum(strlen(t)) AS BIGINT) AS item_bytes,
                 CAST(sum(CASE WHEN media_type LIKE 'image/%' THEN strlen(t) ELSE 0 END) AS BIGINT) AS image_bytes FROM m GROUP BY book_id""")
def manifest_totals(spark, sf_dir):
    """Counts and bytes of the items of books of seven pages."""
    p = _read(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "image/svg+xml").otherwise("text/html")
    m = p.select(F.floor(F.col("page_id") / 7).cast("long").alias("book_id"), F.col("html").alias("text"), F.lit(None).cast("binary").alias("data"), kind.alias("media_type"))
    return K.totals(m)


@query("""WITH s AS (SELECT page_id // 10 AS book_id, page_id % 10 AS pos, 'p' || page_id AS idref, page_id % 4 > 0 AS linear FROM pages)
          SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1 AS INTEGER) AS pos, idref FROM s WHERE linear""")
def spine_linear(spark, sf_dir):
    """The spines of books of ten pages without their non-linear items."""
    i = F.col("page_id")
    s = _read(spark, sf_dir, "pages").select(F.floor(i / 10).cast("long").alias("book_id"), (i % 10).cast("int").alias("pos"), F.concat(F.lit("p"), i.cast("string")).alias("idref"), (i % 4 > 0).alias("linear"))
    gone = s.join(K.linear_items(s), s.columns, "left_anti")
    return K.without_items(s, gone).select("book_id", "pos", "idref")


@query("""SELECT page_id AS book_id, CAST(n AS INTEGER) AS pos, t AS ref_type, CASE WHEN t = 'cover' THEN 'New' ELSE 'Old' END AS title, CASE WHEN t = 'cover' THEN url ELSE 'old.xhtml' END AS href
          FROM pages, (VALUES (0, 'toc'), (1, 'text'), (2, 'cover')) g(n, t)""")
def guide_put(spark, sf_dir):
    """A cover reference takes the place of the one that was there."""
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), "url")
    old = F.transform(F.array(*map(F.lit, ("toc", "cover", "text"))), lambda t: F.struct(t.alias("ref_type"), F.lit("Old").alias("title"), F.lit("old.xhtml").alias("href")))
    guide = p.select("book_id", F.posexplode(old).alias("pos", "r")).select("book_id", "pos", "r.*")
    return K.put_references(guide, p.select("book_id", F.lit("cover").alias("ref_type"), F.lit("New").alias("title"), F.col("url").alias("href")))


@query("SELECT doc_id, md5(coalesce(text, '')) AS utf8_md5, md5(coalesce(text, '')) AS marked_md5, md5(coalesce(text, '')) AS wide_md5 FROM documents WHERE text IS NULL OR text NOT LIKE chr(65279) || '%'")
def decode_text(spark, sf_dir):
    """Documents as UTF-8 with and without a mark and as UTF-16, decoded."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).where(~F.startswith("t", F.lit("\ufeff")))
    raw = F.encode("t", "UTF-8")
    return d.select("doc_id", F.md5(K.decoded(raw)).alias("utf8_md5"), F.md5(K.decoded(F.concat(F.unhex(F.lit("EFBBBF")), raw))).alias("marked_md5"), F.md5(K.decoded(F.concat(F.unhex(F.lit("FFFE")), F.encode("t", "UTF-16LE")))).alias("wide_md5"))


ORACLES["line_group"] = f"""
        WITH RECURSIVE x AS (SELECT page_id AS book_id, CAST(k % 4 AS INTEGER) AS number, CAST(k AS BIGINT) AS seq, floor({_GRID} % 97) * 1.0 AS top, {_GRID} % 13 * 1.0 AS lft FROM pages, generate_series(1, 24) s(k)),
        o AS (SELECT *, row_number() OVER (PARTITION BY book_id, number ORDER BY top, lft, seq) AS i FROM x),
        r AS (SELECT book_id, number, seq, i, top AS anchor, 0 AS line FROM o WHERE i = 1
              UNION ALL SELECT o.book_id, o.number, o.seq, o.i, CASE WHEN o.top - r.anchor < 3 THEN r.anchor ELSE o.top END, CASE WHEN o.top - r.anchor < 3 THEN r.line ELSE r.line + 1 END
              FROM o JOIN r ON o.book_id = r.book_id AND o.number = r.number AND o.i = r.i + 1)
        SELECT book_id, number, seq, CAST(line AS INTEGER) AS line FROM r"""

_P_TEXT = "regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '[\\s\\x{A0}]+', ' ', 'g')"

ORACLES["pdf_lines"] = f"""
        WITH RECURSIVE b AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) ELSE html END AS t FROM pages),
        p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(t, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: trim({_P_TEXT})), lambda y: y <> '') AS ps FROM b),
        w AS (SELECT page_id, k - 1 AS paragraph, string_split(ps[k], ' ') AS ws FROM (SELECT page_id, ps, unnest(generate_series(1, len(ps))) AS k FROM p WHERE len(ps) > 0)),
        r AS (SELECT page_id, paragraph, ws, 1 AS i, 0 AS line, strlen(ws[1]) AS n FROM w
              UNION ALL SELECT page_id, paragraph, ws, i + 1, CASE WHEN n + 1 + strlen(ws[i + 1]) > 82 THEN line + 1 ELSE line END, CASE WHEN n + 1 + strlen(ws[i + 1]) > 82 THEN strlen(ws[i + 1]) ELSE n + 1 + strlen(ws[i + 1]) END
              FROM r WHERE i < len(ws))
        SELECT page_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(line AS INTEGER) AS line, string_agg(ws[i], ' ' ORDER BY i) AS text FROM r GROUP BY page_id, paragraph, line"""

