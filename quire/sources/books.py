"""Files of any format to the tables of a collection of books."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import book as B
from . import markup, mobi, office, readers

TERM = "array<struct<term:string,value:string>>"
ITEM = "array<struct<id:string,href:string,media_type:string,text:string,data:binary>>"
SCHEMA = f"metadata {TERM}, items {ITEM}, spine array<struct<idref:string,linear:boolean>>, toc array<struct<title:string,href:string,depth:int>>, guide array<struct<ref_type:string,title:string,href:string>>, error string"


def _text(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


def read_html(data: bytes, stem: str) -> dict:
    page = _text(data)
    found = re.search(r"(?is)<title>(.*?)</title>", page)
    title = (found[1].strip() if found else "") or stem
    doc = page if "<html" in page else B.document(title, page)
    return {"metadata": [("title", title), ("language", "en")], "items": [("content", "content.xhtml", B.XHTML, doc, None)], "spine": [("content", True)], "toc": [(title, "content.xhtml")], "guide": []}


def read_text(data: bytes, stem: str) -> dict:
    parts = [p.strip() for p in _text(data).split("\n\n")]
    body = "".join("<p>" + B.text(p).replace("\n", "<br/>\n") + "</p>\n" for p in parts if p)
    out = B.single(stem, [("title", stem), ("language", "en")], body)
    return out | {"toc": [(stem, "content.xhtml")]}


def read_markdown(data: bytes, stem: str) -> dict:
    out = B.single(stem, [("title", stem), ("language", "en")], markup.markdown_html(_text(data)))
    return out | {"toc": [(stem, "content.xhtml")]}


def read_epub(data: bytes, stem: str) -> dict:
    """An EPUB. Payloads are texts where their type is textual; terms that can stand once keep
    their last value; addresses are as ``readers.read_epub`` gives them."""
    raw = readers.read_epub(data)
    terms = B.Terms()
    for term, value in raw["metadata"]:
        (terms.add if term not in ("title", "language", "description", "publisher", "date", "rights") else terms.put)(term, value)
    if raw["uid"]:
        terms.put("uid", raw["uid"])
    items = []
    for i, href, media, payload in raw["manifest"]:
        textual = readers.is_text(media)
        items.append((i, href, media, _text(payload) if textual and payload is not None else None, None if textual else payload))
    return {"metadata": terms.rows, "items": items, "spine": [(i, True) for i in raw["spine"]], "toc": raw["toc"], "guide": raw["guide"]}


#: Format -> parser of (bytes, file stem).
PARSERS: dict[str, Callable[[bytes, str], dict]] = {
    "html": read_html, "xhtml": read_html, "txt": read_text, "markdown": read_markdown, "epub": read_epub, "fb2": markup.read_fb2, "docx": office.read_docx,
    "odt": office.read_odt, "rtf": office.read_rtf, "mobi": mobi.read_mobi, "azw": mobi.read_mobi,
}

_ROW = pa.struct([("term", pa.string()), ("value", pa.string())])
_TYPES = {
    "metadata": pa.list_(_ROW),
    "items": pa.list_(pa.struct([("id", pa.string()), ("href", pa.string()), ("media_type", pa.string()), ("text", pa.string()), ("data", pa.binary())])),
    "spine": pa.list_(pa.struct([("idref", pa.string()), ("linear", pa.bool_())])),
    "toc": pa.list_(pa.struct([("title", pa.string()), ("href", pa.string()), ("depth", pa.int32())])),
    "guide": pa.list_(pa.struct([("ref_type", pa.string()), ("title", pa.string()), ("href", pa.string())])),
}


def _structs(rows: list[tuple], kind: pa.ListType) -> list[dict]:
    names = [kind.value_type.field(k).name for k in range(kind.value_type.num_fields)]
    # an entry of the contents without a depth is of the first
    return [dict(zip(names, r)) | ({"depth": 1} if names[-1] == "depth" and len(r) < len(names) else {}) for r in rows]


def read_books(files: DataFrame, source_format: str | None = None) -> DataFrame:
    """files: book_id, path, data. One row for each file: ``book_id``, ``path``, ``stem``, the
    five lists of a book, ``error``. A file that cannot be read, has no known format or is null
    gives a row with ``error`` and null lists. Repeated rows are read again."""
    kind = files.schema["book_id"].dataType.simpleString()
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    fmt = F.lit(source_format) if source_format else X.book_format(F.col("path"))
    rows = files.select("book_id", "path", F.coalesce(stem, F.lit("Untitled")).alias("stem"), fmt.alias("format"), F.col("data").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.select(["book_id", "path", "stem"])
            for k in range(batch.num_rows):
                stem, fmt, data = (batch.column(c)[k].as_py() for c in ("stem", "format", "data"))
                try:
                    if fmt not in PARSERS:
                        raise ValueError(f"no reader for format {fmt}")
                    if data is None:
                        raise ValueError("no data")
                    book, error = PARSERS[fmt](data, stem), None
                except Exception as e:  # noqa: BLE001  a broken book does not end the job
                    book, error = None, f"{type(e).__name__}: {e}"
                lists = [pa.array([_structs(book[c], t) if book else None], t) for c, t in _TYPES.items()]
                one = head.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, *lists, pa.array([error], pa.string())], names=[*head.schema.names, *_TYPES, "error"])

    return rows.mapInArrow(run, f"book_id {kind}, path string, stem string, {SCHEMA}")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``book_id`` (a hash of the path), ``path``, ``data`` of the files at a path or pattern."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return got.select(F.xxhash64("path").alias("book_id"), "path", F.col("content").alias("data"))


@dataclass(frozen=True)
class Books:
    """The tables of a collection.

    books: book_id, path, stem, metadata, title, language, uid, next_id, error; manifest: book_id, pos,
    id, href, media_type, text, data; spine: book_id, pos, idref, linear; toc: book_id,
    play_order, title, href, depth; guide: book_id, pos, ref_type, title, href. Contents are in
    depth-first order, so that order and depth are the tree. ``next_id`` numbers the items that
    transforms add; it is above every number at the end of an id that the book has."""

    books: DataFrame
    manifest: DataFrame
    spine: DataFrame
    toc: DataFrame
    guide: DataFrame

    def having(self, **tables: DataFrame) -> Books:
        return replace(self, **tables)


def tables(raw: DataFrame) -> Books:
    """The tables of what ``read_books`` returned. Write ``raw`` first where parsing is costly:
    each table reads it once, with only the columns that it needs."""
    value = lambda t: F.try_element_at(F.filter("metadata", lambda m: m["term"] == t), F.lit(1))["value"]
    numbers = F.transform("items", lambda i: F.coalesce(F.try_to_number(F.regexp_extract(i["id"], r"(\d{1,8})$", 1), F.lit("99999999")).cast("int"), F.lit(0)))
    next_id = F.coalesce(F.array_max(numbers), F.lit(0)) + 1
    books = raw.select("book_id", "path", "stem", "metadata", F.coalesce(value("title"), F.translate("stem", "_-", "  ")).alias("title"), value("language").alias("language"), F.coalesce(value("uid"), value("identifier")).alias("uid"), next_id.alias("next_id"), "error")
    rows = lambda c, pos="pos": raw.select("book_id", F.posexplode(c).alias(pos, "r")).select("book_id", pos, "r.*")
    toc = rows("toc", "play_order").withColumn("play_order", F.col("play_order") + 1)
    return Books(books, rows("items"), rows("spine"), toc, rows("guide"))


def with_assets(b: Books, files: DataFrame) -> Books:
    """Books read from HTML pages with the sheets and pictures beside them that they name, before
    the page. files: path, data, of the same folders. Remote and embedded pictures are not
    looked for; a file that is not there is left out; one named twice is one item. Addresses meet
    paths by an equality join; only files that a page names go on."""
    pages = b.books.where(F.coalesce(X.book_format(F.col("path")).isin("html", "xhtml"), F.lit(False)) & F.col("error").isNull()).select("book_id", "path", "next_id")
    text = b.manifest.where("id = 'content'").join(pages, "book_id")
    named = lambda pattern, g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
    sheets = F.transform(named(r"""(?i)<link[^>]+href\s*=\s*["']([^"']+\.css)["']""", 1), lambda h: F.struct(F.lit(0).alias("kind"), h.alias("href")))
    shown = F.filter(named(r"""(?i)<img[^>]+src\s*=\s*["']([^"']+)["']""", 1), lambda h: ~F.startswith(h, F.lit("data:")) & ~F.startswith(h, F.lit("http")))
    refs = text.select("book_id", "path", "next_id", F.posexplode(F.concat(sheets, F.transform(shown, lambda h: F.struct(F.lit(1).alias("kind"), h.alias("href"))))).alias("k", "r")).select("book_id", "path", "next_id", "k", "r.*")
    refs = refs.groupBy("book_id", "path", "next_id", "kind", "href").agg(F.min("k").alias("k"))
    whole = F.concat(F.regexp_replace("path", "[^/]*$", ""), "href")
    for pattern in (r"/(?:\./)+", *[r"/(?!\.\./)[^/]+/\.\./"] * 6):
        whole = F.regexp_replace(whole, pattern, "/")
    found = refs.withColumn("file", whole).join(files.select(F.col("path").alias("file"), F.col("data").cast("binary").alias("bytes")), "file")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("kind", "k", "file"))
    found = found.withColumn("n", n)
    is_css = F.col("kind") == 0
    new = found.select(
        "book_id",
        (F.col("n") - 1).cast("int").alias("pos"),
        F.concat(F.when(is_css, "css").otherwise("img"), (F.col("next_id") + F.col("n") - 1).cast("string")).alias("id"),
        "href",
        F.when(is_css, "text/css").otherwise(X.mime_type(F.col("href"))).alias("media_type"),
        F.when(is_css, F.decode("bytes", "UTF-8")).alias("text"),
        F.when(~is_css, F.col("bytes")).alias("data"),
    )
    counts = found.groupBy("book_id").agg(F.count("*").cast("int").alias("n"))
    moved = lambda c: (F.col(c) + F.coalesce("n", F.lit(0))).cast("int")
    manifest = b.manifest.join(counts, "book_id", "left").withColumn("pos", moved("pos")).select(*b.manifest.columns)
    books = b.books.join(counts, "book_id", "left").withColumn("next_id", moved("next_id")).select(*b.books.columns)
    return b.having(books=books, manifest=manifest.unionByName(new))
