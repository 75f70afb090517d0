"""Relational operators over extracted PDF pages: classes, ranges, lines, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .transforms import depth_first

#: Fonts of recognised text laid under a scan.
OCR_FONTS = ("glyphlessfont", "invisible")
LINE_TOLERANCE, GAP_FACTOR, DEFAULT_GAP, LEAST_OUTLINE = 3.0, 1.5, 10.0, 3


def classify_pages(pages: DataFrame, texts: DataFrame, fonts: DataFrame, images: DataFrame) -> DataFrame:
    """``book_id``, ``number``, ``page_type``: text, scanned, image_only or blank."""
    family = fonts.groupBy("book_id", F.col("id").alias("font_id")).agg(F.min_by("family", "seq").alias("family"))
    seen = texts.where(F.trim("text") != "").join(family, ["book_id", "font_id"], "left")
    real = ~F.coalesce(F.lower("family").isin(*OCR_FONTS), F.lit(False))
    by_page = seen.groupBy("book_id", "number").agg(F.max(real).alias("real"))
    shown = images.groupBy("book_id", "number").agg(F.lit(True).alias("image"))
    joined = pages.join(by_page, ["book_id", "number"], "left").join(shown, ["book_id", "number"], "left")
    image = F.coalesce("image", F.lit(False))
    kind = F.when(F.col("real").isNull(), F.when(image, "image_only").otherwise("blank")).when(F.col("real"), "text").when(image, "scanned").otherwise("blank")
    return joined.select("book_id", "number", kind.alias("page_type"))


def contiguous_ranges(pages: DataFrame) -> DataFrame:
    """``book_id``, ``first``, ``last`` of the runs of consecutive page numbers."""
    one = pages.select("book_id", "number").distinct()
    island = F.col("number") - F.row_number().over(Window.partitionBy("book_id").orderBy("number"))
    return one.withColumn("i", island).groupBy("book_id", "i").agg(F.min("number").alias("first"), F.max("number").alias("last")).drop("i")


def group_lines(texts: DataFrame) -> DataFrame:
    """``texts`` (book_id, number, seq, top, left, ...) with ``line`` from 0: a fragment joins
    the line whose first fragment is less than 3 above it. A page's fragments are one fold."""
    item = F.struct("top", "left", "seq")
    pages = texts.groupBy("book_id", "number").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out_type = "array<struct<seq:bigint,line:int>>"
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("anchor"), F.array().cast(out_type).alias("out"))

    def step(acc, x):
        same = (acc["line"] >= 0) & (F.abs(acc["anchor"] - x["top"]) < LINE_TOLERANCE)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        entry = F.struct(x["seq"].cast("bigint").alias("seq"), line.alias("line"))
        return F.struct(line.alias("line"), F.when(same, acc["anchor"]).otherwise(x["top"].cast("double")).alias("anchor"), F.array_append(acc["out"], entry).cast(out_type).alias("out"))

    lines = pages.select("book_id", "number", F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("e"))
    return texts.join(lines.select("book_id", "number", "e.seq", "e.line"), ["book_id", "number", "seq"])


def group_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines (book_id, number, line, top, height, text) to ``paragraph`` (from 0) and its text:
    a gap over 1.5 times the page's mean of positive gaps begins a new one."""
    page = Window.partitionBy("book_id", "number")
    order = page.orderBy("line")
    rows = lines.withColumn("gap", F.col("top") - F.lag(F.col("top") + F.col("height")).over(order))
    mean = F.coalesce(F.avg(F.when(F.col("gap") > 0, F.col("gap"))).over(page), F.lit(DEFAULT_GAP))
    rows = rows.withColumn("mean", mean)
    new = F.coalesce((F.col("gap") > GAP_FACTOR * F.col("mean")).cast("int"), F.lit(0))
    rows = rows.withColumn("paragraph", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return rows.groupBy("book_id", "number", "paragraph").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def page_counts(classes: DataFrame) -> DataFrame:
    """``book_id`` and how many of its pages are of each class: ``n_text``, ``n_scanned``,
    ``n_image_only``, ``n_blank``, ``n_pages``."""
    one = lambda t: F.count_if(F.col("page_type") == t).alias(f"n_{t}")
    return classes.groupBy("book_id").agg(*map(one, ("text", "scanned", "image_only", "blank")), F.count("*").alias("n_pages"))


def text_lines(texts: DataFrame) -> DataFrame:
    """Fragments (book_id, number, seq, top, left, height, inner_html) to lines: ``line``, ``top`` and
    ``height`` of its first fragment, ``text``: the fragments from left to right. Blank ones go."""
    shown = texts.where(X.trim(X.inner_text(F.col("inner_html"))) != "")
    lines = group_lines(shown).groupBy("book_id", "number", "line").agg(
        F.min_by(F.struct("top", "height"), F.struct("top", "left", "seq")).alias("first"),
        F.array_sort(F.collect_list(F.struct("left", "top", "seq", "inner_html"))).alias("parts"),
    )
    return lines.select("book_id", "number", "line", "first.top", "first.height", F.array_join(F.transform("parts", lambda p: p["inner_html"]), " ").alias("text"))


def page_blocks(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Lines and placed pictures (book_id, number, seq, top, left, href) of pages to blocks from top to
    bottom: ``block`` from 0, ``kind`` (paragraph or image), ``text`` (of a paragraph), ``href``, ``alt``.
    A picture ends the paragraph before it; else a gap over 1.5 times the page's mean of
    positive gaps does. At one height lines come before pictures."""
    page = Window.partitionBy("book_id", "number")
    order = page.orderBy("top", "line")
    rows = lines.withColumn("gap", F.col("top") - F.lag(F.col("top") + F.col("height")).over(order))
    mean = F.coalesce(F.avg(F.when(F.col("gap") > 0, F.col("gap"))).over(page), F.lit(DEFAULT_GAP))
    rows = rows.select("book_id", "number", "top", F.lit(0).alias("image"), F.col("line").cast("long").alias("at"), (F.col("gap") > GAP_FACTOR * mean).alias("far"), "text", F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("alt"))
    whole = lambda c: F.greatest(F.lit(0), F.floor(c)).cast("string")
    alt = F.concat(F.lit("Image at ("), whole("left"), F.lit(", "), whole("top"), F.lit(")"))
    shown = images.select("book_id", "number", "top", F.lit(1).alias("image"), F.col("seq").cast("long").alias("at"), F.lit(True).alias("far"), F.lit(None).cast("string").alias("text"), "href", alt.alias("alt"))
    down = page.orderBy("top", "image", "at")
    items = rows.unionByName(shown).withColumn("after", F.coalesce(F.lag("image").over(down), F.lit(0)) == 1)
    new = F.when(F.coalesce("far", F.lit(False)) | F.col("after"), 1).otherwise(0)
    items = items.withColumn("n", F.sum(new).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("top", "at", "text")))
    blocks = items.groupBy("book_id", "number", "n").agg(F.max("image").alias("image"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.max("href").alias("href"), F.max("alt").alias("alt"))
    kind = F.when(F.col("image") == 1, "image").otherwise("paragraph")
    return blocks.select("book_id", "number", (F.row_number().over(page.orderBy("n")) - 1).alias("block"), kind.alias("kind"), F.when(F.col("image") == 0, F.col("text")).alias("text"), "href", "alt")


def _page(number: Column, inside: Column) -> Column:
    """The XHTML of a page."""
    body = F.concat(F.lit('  <div class="page">\n'), inside, F.lit("  </div>"))
    return X.xhtml_document(F.concat(F.lit("Page "), number.cast("string")), body, css="style.css")


def _picture(href: Column, alt: Column) -> Column:
    return F.concat(F.lit('    <div class="page-image"><img src="'), X.escape_attr(href), F.lit('" alt="'), X.escape_attr(alt), F.lit('"/></div>\n'))


def blank_page(number: Column) -> Column:
    return _page(number, F.concat(F.lit('    <p class="empty-page">[Page '), number.cast("string"), F.lit("]</p>\n")))


def text_page(number: Column, blocks: Column) -> Column:
    """``blocks``: structs (kind, text, href, alt) in order; texts carry their marks already."""
    one = lambda b: F.when(b["kind"] == "image", _picture(b["href"], b["alt"])).otherwise(F.concat(F.lit("    <p>"), b["text"], F.lit("</p>\n")))
    return F.when(F.size(blocks) > 0, _page(number, F.array_join(F.transform(blocks, one), ""))).otherwise(blank_page(number))


def scanned_page(number: Column, href: Column) -> Column:
    alt = F.concat(F.lit("Page "), number.cast("string"))
    return F.when(href.isNull(), blank_page(number)).otherwise(_page(number, _picture(href, alt)))


def image_page(number: Column, text: Column, hrefs: Column) -> Column:
    """Plain text in paragraphs, then pictures; a page with neither is blank."""
    alt = F.concat(F.lit("Page "), number.cast("string"), F.lit(" image"))
    one = lambda p: F.concat(F.lit("    <p>"), X.escape_text(p), F.lit("</p>\n"))
    inside = F.concat(F.array_join(F.transform(X.paragraphs(text), one), ""), F.array_join(F.transform(hrefs, lambda h: _picture(h, alt)), ""))
    return F.when(inside == "", blank_page(number)).otherwise(_page(number, inside))


def outline_toc(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Contents (book_id, play_order, title, href, depth): a book's outline (node_id, parent_id, pos,
    title, page) where it has three entries at the top, else an entry for each page."""
    name = lambda n: F.concat(F.lit("page"), F.col(n).cast("string"), F.lit(".xhtml"))
    rich = outline.where("parent_id is null").groupBy("book_id").count().where(F.col("count") >= LEAST_OUTLINE).select("book_id")
    tree = depth_first(outline.join(rich, "book_id", "left_semi"))
    entries = tree.select("book_id", "play_order", "title", name("page").alias("href"), "depth")
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("number"))
    plain = pages.join(rich, "book_id", "left_anti").select("book_id", order.alias("play_order"), F.concat(F.lit("Page "), F.col("number").cast("string")).alias("title"), name("number").alias("href"), F.lit(1).alias("depth"))
    return entries.unionByName(plain)
