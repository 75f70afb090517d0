"""Output formats as columns and tables: text, HTML, package files, EPUB, MOBI records, PDF text."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

NO_UID = "urn:uuid:00000000-0000-0000-0000-000000000000"
_XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
#: Media that is stored, not compressed again.
PRECOMPRESSED = ("image/jpeg", "image/png", "image/gif", "image/webp", "font/woff", "font/woff2", "audio/mpeg", "audio/mp4", "video/mp4")


def ordered(order: list[str], *cols: str) -> Column:
    """Aggregate: the rows of a group as structs of ``cols``, by ``order``."""
    return F.array_sort(F.collect_list(F.struct(*order, *cols)))


def joined(rows: Column, one, by: str = "") -> Column:
    return F.array_join(F.transform(rows, one), by)


def text_book(title: Column, authors: Column, bodies: Column) -> Column:
    """A book as plain text: underlined title (by bytes), authors, and the documents' texts."""
    head = F.when(title.isNotNull(), F.concat(title, F.lit("\n"), F.repeat(F.lit("="), F.octet_length(title)), F.lit("\n\n"))).otherwise(F.lit(""))
    by = F.when(F.size(authors) > 0, F.concat(joined(authors, lambda a: F.concat(F.lit("By "), a, F.lit("\n"))), F.lit("\n"))).otherwise(F.lit(""))
    texts = F.filter(F.transform(bodies, X.plain_text), lambda t: t != "")
    return F.regexp_replace(F.concat(head, by, F.array_join(texts, "\n\n")), r"(?U)\s+$", "")


def html_book(title: Column, sheets: Column, bodies: Column) -> Column:
    """A book as one HTML document: sheets inlined, bodies in order."""
    css = joined(sheets, lambda s: F.concat(F.lit("<style>\n"), s, F.lit("\n</style>\n")))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="UTF-8">\n<title>'), X.escape_text(F.coalesce(title, F.lit("Untitled"))), F.lit("</title>\n"))
    return F.concat(head, css, F.lit("</head>\n<body>\n"), joined(bodies, lambda b: F.concat(b, F.lit("\n"))), F.lit("</body>\n</html>\n"))


def ncx(uid: Column, title: Column, toc: Column) -> Column:
    """The flat navigation file, of fixed form; ``toc``: structs with title and href, in order."""
    def point(e: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.concat(F.lit('<navPoint id="navPoint-'), n, F.lit('" playOrder="'), n, F.lit('"><navLabel><text>'), X.escape_text(e["title"]), F.lit('</text></navLabel><content src="'), X.escape_attr(e["href"]), F.lit('"/></navPoint>\n'))

    doctype = '<!DOCTYPE ncx PUBLIC "-//NISO//DTD ncx 2005-1//EN" "http://www.daisy.org/z3986/2005/ncx-2005-1.dtd">\n'
    meta = "".join(f'<meta name="dtb:{k}" content="{v}"/>' for k, v in (("depth", 1), ("totalPageCount", 0), ("maxPageNumber", 0)))
    return F.concat(
        F.lit(_XML + doctype + '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n<head><meta name="dtb:uid" content="'),
        X.escape_attr(F.coalesce(uid, F.lit(NO_UID))),
        F.lit(f'"/>{meta}</head>\n<docTitle><text>'),
        X.escape_text(F.coalesce(title, F.lit("Untitled"))),
        F.lit("</text></docTitle>\n<navMap>\n"),
        F.array_join(F.transform(toc, point), ""),
        F.lit("</navMap>\n</ncx>\n"),
    )


def opf(uid: Column, title: Column, language: Column, authors: Column, manifest: Column, spine: Column, guide: Column, description: Column | None = None, publisher: Column | None = None, date: Column | None = None) -> Column:
    """The package file, of fixed form. manifest: structs (id, href, media_type); spine: (idref, linear);
    guide: (ref_type, title, href)."""
    attr = X.escape_attr
    item = lambda m: F.concat(F.lit('<item id="'), attr(m["id"]), F.lit('" href="'), attr(m["href"]), F.lit('" media-type="'), attr(m["media_type"]), F.lit('"/>\n'))
    term = lambda t, v: F.lit("") if v is None else F.coalesce(F.concat(F.lit(f"<dc:{t}>"), X.escape_text(v), F.lit(f"</dc:{t}>\n")), F.lit(""))
    ref = lambda s: F.concat(F.lit('<itemref idref="'), attr(s["idref"]), F.when(s["linear"], '"/>\n').otherwise('" linear="no"/>\n'))
    mark = lambda g: F.concat(F.lit('<reference type="'), attr(g["ref_type"]), F.lit('" title="'), attr(g["title"]), F.lit('" href="'), attr(g["href"]), F.lit('"/>\n'))
    return F.concat(
        F.lit(_XML + '<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="bookid" version="2.0">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">\n<dc:title>'),
        X.escape_text(F.coalesce(title, F.lit("Untitled"))),
        F.lit("</dc:title>\n<dc:language>"),
        X.escape_text(F.coalesce(language, F.lit("en"))),
        F.lit('</dc:language>\n<dc:identifier id="bookid">'),
        X.escape_text(F.coalesce(uid, F.lit(NO_UID))),
        F.lit("</dc:identifier>\n"),
        joined(authors, lambda a: F.concat(F.lit('<dc:creator opf:role="aut">'), X.escape_text(a), F.lit("</dc:creator>\n"))),
        term("description", description),
        term("publisher", publisher),
        term("date", date),
        F.lit('</metadata>\n<manifest>\n<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>\n'),
        joined(manifest, item),
        F.lit('</manifest>\n<spine toc="ncx">\n'),
        joined(spine, ref),
        F.lit("</spine>\n"),
        F.when(F.size(guide) > 0, F.concat(F.lit("<guide>\n"), joined(guide, mark), F.lit("</guide>\n"))).otherwise(F.lit("")),
        F.lit("</package>\n"),
    )


#: Fixed value: names the package file.
CONTAINER = _XML + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def epub_files(books: DataFrame, manifest: DataFrame) -> DataFrame:
    """``book_id`` and ``data``, the EPUB bytes. books: book_id, opf, ncx; manifest: book_id,
    pos, href, media_type, text, data. One group is one book, which a writer needs whole."""
    head = books.select("book_id", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("media_type"), F.to_json(F.struct("opf", "ncx")).alias("text"), F.lit(None).cast("binary").alias("data"))
    rows = manifest.select("book_id", F.col("pos").cast("int").alias("pos"), "href", "media_type", "text", "data").unionByName(head)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            def put(name, data, stored=False):
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                z.writestr(info, data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)

            put("mimetype", "application/epub+zip", True)
            put("META-INF/container.xml", CONTAINER)
            for r in rows[rows["pos"] >= 0].sort_values("pos").itertuples():
                data = r.text.encode() if isinstance(r.text, str) else r.data
                if data is not None:
                    put(posixpath.normpath("OEBPS/" + r.href), bytes(data), r.media_type in PRECOMPRESSED)
            for r in rows[rows["pos"] < 0].itertuples():
                package = json.loads(r.text)
                put("OEBPS/content.opf", package["opf"])
                put("OEBPS/toc.ncx", package["ncx"])
        return pd.DataFrame({"book_id": rows["book_id"].iloc[:1], "data": [out.getvalue()]})

    kind = books.schema["book_id"].dataType.simpleString()
    return rows.groupBy("book_id").applyInPandas(build, f"book_id {kind}, data binary")


def mobi_html(xhtml: Column) -> Column:
    """A body without the tags of a document's frame, by their beginnings."""
    return F.regexp_replace(X.body_or_all(xhtml), r"(?i)</?(!DOCTYPE|html|head|meta|link|title|xml)[^>]*>", "")


def mobi_records(text: Column, size: int = 4096) -> Column:
    """Byte records of a text, cut at ``size`` wherever that falls."""
    raw = F.encode(text, "UTF-8")
    n = F.ceil(F.octet_length(raw) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def pdf_paragraphs(xhtml: Column) -> Column:
    """The paragraphs a PDF page shows: tags go, entities are decoded, white space is one blank."""
    found = F.regexp_extract_all(X.body_or_all(xhtml), F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    clean = lambda p: X.collapse(X.decode_entities(X.strip_tags(p, " ")))
    return F.filter(F.transform(found, clean), lambda p: p != "")
