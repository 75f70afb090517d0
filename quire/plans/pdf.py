"""Books of extracted PDF pages: page XML, its pictures and rendered pages come from outside tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pdf_pages as P
from ..sources import pdf as S
from ..sources.books import Books
from ..store import cut

#: The sheet of books made of PDF pages.
STYLE = """body { font-family: serif; line-height: 1.5; }
.page-image { text-align: center; }
.page-image img { display: inline-block; max-width: 100%; }
.empty-page { text-align: center; color: gray; }
"""
ENGINES = ("auto", "text-only", "image-only")


def tables(parts: DataFrame) -> dict[str, DataFrame]:
    """The tables of parsed parts: pages, texts, images, fonts, outline. Of a page that two parts hold
    and of a font's id the first counts."""
    each = lambda c: parts.select("book_id", F.explode(c).alias("r")).select("book_id", "r.*")
    out = {c: each(c) for c in ("pages", "texts", "images", "fonts", "outline")}
    out["pages"] = out["pages"].groupBy("book_id", "number").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    out["fonts"] = out["fonts"].groupBy("book_id", "id").agg(F.min_by(F.struct("seq", "size", "family", "color"), "seq").alias("f")).select("book_id", "id", "f.*")
    return out


def placed_images(images: DataFrame, pictures: DataFrame) -> DataFrame:
    """Page pictures whose file there is: ``images`` with ``id``, ``href``, ``media_type`` and ``data``,
    numbered over the book in the order of its pages. pictures: book_id, src, data."""
    files = pictures.where("octet_length(data) > 0").groupBy("book_id", "src").agg(F.min("data").alias("data"))
    rows = images.join(files, ["book_id", "src"])
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("number", "seq"))
    name = F.concat_ws("_", F.col("number").cast("string"), F.col("n").cast("string"))
    kind = F.when(F.endswith("src", F.lit(".png")), "image/png").otherwise("image/jpeg")
    return rows.withColumn("n", n).select("*", F.concat(F.lit("img_"), name).alias("id"), F.concat(F.lit("images/page"), name, F.lit(".jpg")).alias("href"), kind.alias("media_type"))


def page_documents(t: dict[str, DataFrame], classes: DataFrame, images: DataFrame, scans: DataFrame) -> DataFrame:
    """``book_id``, ``number`` and ``text``, the XHTML of each page. images: as ``placed_images``;
    scans: book_id, number, href. A picture that stands on pages twice shows its last file."""
    last = images.groupBy("book_id", "src").agg(F.max_by("href", "n").alias("href"))
    shown = t["images"].join(last, ["book_id", "src"])
    of = lambda kind: classes.where(F.col("page_type") == kind).select("book_id", "number")
    on_text = lambda df: df.join(of("text"), ["book_id", "number"], "left_semi")
    blocks = P.page_blocks(P.text_lines(on_text(t["texts"])), on_text(shown))
    listed = blocks.groupBy("book_id", "number").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text", "href", "alt"))).alias("blocks"))
    plain = shown.join(of("image_only"), ["book_id", "number"], "left_semi")
    plain = plain.groupBy("book_id", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "href"))), lambda r: r["href"]).alias("hrefs"))
    rows = classes.join(listed, ["book_id", "number"], "left").join(plain, ["book_id", "number"], "left").join(scans.select("book_id", "number", F.col("href").alias("scan")), ["book_id", "number"], "left")
    number, kind = F.col("number"), F.col("page_type")
    none = "array<struct<block:int,kind:string,text:string,href:string,alt:string>>"
    text = (
        F.when(kind == "text", P.text_page(number, F.coalesce("blocks", F.array().cast(none))))
        .when(kind == "scanned", P.scanned_page(number, F.col("scan")))
        .when(kind == "image_only", P.image_page(number, F.lit(""), F.coalesce("hrefs", F.array().cast("array<string>"))))
        .otherwise(P.blank_page(number))
    )
    return rows.select("book_id", "number", text.alias("text"))


def _terms(ids: DataFrame, info: DataFrame | None) -> DataFrame:
    """``book_id`` and ``metadata`` of the information dictionaries, with defaults."""
    if info is None:
        rows = ids.select("book_id", *[F.lit(None).cast("binary").alias(c) for c in ("title", "author", "subject")])
    else:
        rows = ids.join(info, "book_id", "left")
    value = lambda c: F.nullif(X.trim(X.pdf_string(F.col(c))), F.lit(""))
    term = lambda name, v: F.struct(F.lit(name).alias("term"), v.alias("value"))
    found = F.array(term("title", F.coalesce(value("title"), F.lit("Untitled PDF"))), term("creator", value("author")), term("description", value("subject")), term("language", F.lit("en")))
    return rows.select("book_id", F.filter(found, lambda r: r["value"].isNotNull()).alias("metadata"))


def pdf_books(files: DataFrame, pictures: DataFrame | None = None, rendered: DataFrame | None = None, info: DataFrame | None = None, engine: str = "auto") -> Books:
    """The tables of books of extracted pages.

    files: book_id, path, data (page XML), and ``part`` where a book comes in several page ranges;
    pictures: book_id, src, data; rendered: book_id, number, data (page images, JPEG); info:
    book_id, title, author, subject (raw strings). Engine image-only, and auto for a book without a
    text page, shows the rendered pages with their plain text; the others show text pages as text
    and scanned ones as rendered. A page without its picture is a blank one.

    Defined cases: XML without a page gives a row with ``error``; a null outline, pictures that are
    missing or empty, and pages without elements are as if they were not there; an empty table
    gives empty tables."""
    if engine not in ENGINES:
        raise ValueError(f"no engine {engine}")
    spark = files.sparkSession
    kind = files.schema["book_id"].dataType.simpleString()
    none = lambda more: spark.createDataFrame([], f"book_id {kind}, {more}")
    pictures = none("src string, data binary") if pictures is None else pictures
    rendered = none("number int, data binary") if rendered is None else rendered
    rendered = rendered.where("octet_length(data) > 0").groupBy("book_id", "number").agg(F.min("data").alias("data"))
    parts = cut(S.pdf_parts(files, "data", "part" if "part" in files.columns else None), "parts")
    t = tables(parts)
    classes = P.classify_pages(t["pages"], t["texts"].select("book_id", "number", "font_id", X.inner_text(F.col("inner_html")).alias("text")), t["fonts"], t["images"])
    counts = P.page_counts(classes)
    by_image = counts.where(F.lit(engine == "image-only") | (F.lit(engine == "auto") & (F.col("n_text") == 0))).select("book_id")
    classes = cut(classes.join(by_image.withColumn("by_image", F.lit(True)), "book_id", "left"), "classes")
    mixed, flat = classes.where("by_image is null"), classes.where("by_image")
    keyed = lambda df: df.join(mixed.select("book_id").distinct(), "book_id", "left_semi")
    own = {c: keyed(x) for c, x in t.items()}
    images = cut(placed_images(own["images"], pictures), "images")
    scan = mixed.where("page_type = 'scanned'").join(rendered, ["book_id", "number"])
    shots = flat.select("book_id", "number").join(rendered, ["book_id", "number"], "left")
    page = F.col("number").cast("string")
    scans = scan.select("book_id", "number", F.concat(F.lit("img_scan"), page).alias("id"), F.concat(F.lit("images/scan_page"), page, F.lit(".jpg")).alias("href"), "data")
    docs = page_documents(own, mixed, images, scans)
    # image-only: the rendered page and the text that its lines hold
    lines = P.text_lines(t["texts"].join(flat.select("book_id", "number"), ["book_id", "number"], "left_semi"))
    plain = lines.groupBy("book_id", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: X.inner_text(r["text"])), "\n").alias("plain"))
    href = F.concat(F.lit("images/page"), page, F.lit(".jpg"))
    hrefs = F.when(F.col("data").isNotNull(), F.array(href)).otherwise(F.array().cast("array<string>"))
    shown = shots.join(plain, ["book_id", "number"], "left").select("book_id", "number", P.image_page(F.col("number"), F.coalesce("plain", F.lit("")), hrefs).alias("text"))
    item = lambda df, rank, at, i, h, m, text, data: df.select("book_id", F.struct(F.lit(rank).alias("rank"), *[c.cast("bigint").alias(f"k{j}") for j, c in enumerate(at)]).alias("at"), i.alias("id"), h.alias("href"), m.alias("media_type"), text.alias("text"), data.alias("data"))
    no_text, no_data, xhtml, jpeg = F.lit(None).cast("string"), F.lit(None).cast("binary"), F.lit("application/xhtml+xml"), F.lit("image/jpeg")
    zero = F.lit(0)
    ids = t["pages"].select("book_id").distinct()
    items = item(images, 0, (F.col("n"), zero), F.col("id"), F.col("href"), F.col("media_type"), no_text, F.col("data"))
    items = items.unionByName(item(scans, 1, (F.col("number"), zero), F.col("id"), F.col("href"), jpeg, no_text, F.col("data")))
    items = items.unionByName(item(shots.where("data is not null"), 2, (F.col("number"), zero), F.concat(F.lit("img"), page), href, jpeg, no_text, F.col("data")))
    items = items.unionByName(item(docs.unionByName(shown), 2, (F.col("number"), F.lit(1)), F.concat(F.lit("page"), page), F.concat(F.lit("page"), page, F.lit(".xhtml")), xhtml, F.col("text"), no_data))
    items = items.unionByName(item(ids, 3, (zero, zero), F.lit("stylesheet"), F.lit("style.css"), F.lit("text/css"), F.lit(STYLE), no_data))
    pos = F.row_number().over(Window.partitionBy("book_id").orderBy("at")) - 1
    manifest = items.select("book_id", pos.alias("pos"), "id", "href", "media_type", "text", "data")
    spine_pos = F.row_number().over(Window.partitionBy("book_id").orderBy("number")) - 1
    spine = t["pages"].select("book_id", spine_pos.alias("pos"), F.concat(F.lit("page"), page).alias("idref"), F.lit(True).alias("linear"))
    toc = P.outline_toc(own["outline"], t["pages"])
    guide = none("pos int, ref_type string, title string, href string")
    return Books(_head(files, parts, t, info), manifest, spine, toc, guide)


def _head(files: DataFrame, parts: DataFrame, t: dict[str, DataFrame], info: DataFrame | None) -> DataFrame:
    """The books' own table; numbers that transforms give begin above the pages."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.coalesce(F.regexp_replace(name, r"(\.pdf)?\.[^.]*$", ""), F.lit("Untitled"))
    named = files.groupBy("book_id").agg(F.min("path").alias("path")).select("book_id", "path", stem.alias("stem"))
    most = t["pages"].groupBy("book_id").agg((F.max("number") + 1).alias("next_id"))
    failed = parts.groupBy("book_id").agg(F.min("error").alias("error"))
    rows = named.join(most, "book_id", "left").join(failed, "book_id", "left").join(_terms(named.select("book_id"), info), "book_id", "left")
    value = lambda term: _first(F.col("metadata"), term)
    error = F.when(F.col("next_id").isNull(), F.coalesce("error", F.lit("no pages")))
    return rows.select("book_id", "path", "stem", "metadata", value("title").alias("title"), value("language").alias("language"), F.lit(None).cast("string").alias("uid"), F.coalesce("next_id", F.lit(1)).alias("next_id"), error.alias("error"))


def _first(metadata: Column, term: str) -> Column:
    return F.try_element_at(F.filter(metadata, lambda m: m["term"] == term), F.lit(1))["value"]
