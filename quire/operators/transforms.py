"""Book transforms as plans over the tables of a collection.

Every table is keyed by ``book_id``; order is a column (``pos``). Work on one document stays a
projection; only renumbering, counting and trimming shuffle, on narrow columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..store import cut

#: Fixed values.
XHTML = ("application/xhtml+xml", "text/html")
PAGE_TEMPLATES = ("application/vnd.adobe-page-template+xml", "application/adobe-page-template+xml")
GUIDE_TYPES = (
    "cover", "title-page", "toc", "index", "glossary", "acknowledgements", "bibliography", "colophon", "copyright-page",
    "dedication", "epigraph", "foreword", "loi", "lot", "notes", "preface", "text",
)
COVER_ALIASES = ("ms-coverimage-standard", "ms-titleimage-standard", "other.ms-coverimage-standard", "other.ms-titleimage-standard")
SPLIT_BYTES, SMALL_BYTES, SMALL_CHUNKS = 10_000, 500, 5


def headings(docs: DataFrame, text: str = "text", chapter: str | None = None) -> DataFrame:
    """``docs`` without the text, and a row for each heading: ``level``, ``byte_offset``, ``title``.
    Levels are matched one by one, so nested headings are all found; blank titles are dropped.
    Offsets are summed up before the rows part, so a heading's row carries no text but its own."""
    pattern = lambda n: rf"(?id)<h{n}[^>]*>(.*?)</h{n}>"
    own, levels = [c for c in docs.columns if c != text], range(1, 7)
    mine = F.col("__row.t")
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(F.col(text).alias("t"), F.struct(*own).alias("own")).alias("__row"))
    found = rows.select("__row", *[F.when(mine.rlike(f"(?i)<h{n}"), F.regexp_extract_all(mine, F.lit(pattern(n)), F.lit(0))).otherwise(none).alias(f"f{n}") for n in levels])

    def sizes(n: int) -> Column:
        f = F.col(f"f{n}")
        both = F.zip_with(F.slice(F.split(mine, pattern(n), -1), F.lit(1), F.size(f)), f, lambda p, m: (F.octet_length(p) + F.octet_length(m)).cast("bigint"))
        return F.when(F.size(f) > 0, both).otherwise(F.array().cast("array<bigint>")).alias(f"n{n}")

    sized = found.select(F.col("__row.own").alias("own"), *[f"f{n}" for n in levels], *[sizes(n) for n in levels])
    ends = sized.select("own", *[f"f{n}" for n in levels], *[X.running(F.col(f"n{n}"), lambda x, y: x + y, 0).alias(f"e{n}") for n in levels])

    def heads(n: int) -> Column:
        title = lambda m: X.trim(X.strip_tags(F.regexp_extract(m, rf"(?is)^<h{n}[^>]*>(.*)</h{n}>$", 1)))
        return F.zip_with(f"e{n}", f"f{n}", lambda e, m: F.struct(F.lit(n).alias("level"), (e - F.octet_length(m)).alias("byte_offset"), title(m).alias("title")))

    out = ends.select("own", F.explode(F.concat(*map(heads, levels))).alias("h")).select("own.*", "h.*").where("title <> ''")
    return out if chapter is None else out.where(F.col("title").rlike(chapter))


def detect_toc(manifest: DataFrame, chapter: str | None = None) -> DataFrame:
    """The table of contents of books from their headings: ``play_order`` from 1, ``title``,
    ``href`` (with an anchor below level 2), ``depth`` (always 1) and ``klass``."""
    docs = manifest.where(F.col("media_type").isin(*XHTML)).select("book_id", "pos", "href", "text")
    found = headings(docs, chapter=chapter)
    order = Window.partitionBy("book_id").orderBy("pos", "byte_offset", "level")
    anchor = F.concat("href", F.lit("#heading-"), F.octet_length("title"))
    return found.select(
        "book_id",
        F.row_number().over(order).alias("play_order"),
        "title",
        F.when(F.col("level") <= 2, F.col("href")).otherwise(anchor).alias("href"),
        F.lit(1).alias("depth"),
        F.concat(F.lit("h"), "level").alias("klass"),
    )


def toc_tree(toc: DataFrame, deepest: int = 16) -> DataFrame:
    """Contents (book_id, play_order, depth, ...) in depth-first order, with ``parent``, the play order
    of the entry above (null: none). Entries below ``deepest`` hang on the last one above it that
    is not."""
    before = Window.partitionBy("book_id").orderBy("play_order").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("depth") == d, F.col("play_order"))).over(before) for d in range(1, deepest + 1)]
    # of the depths above the entry's own the entry that stands last
    above = [F.when(F.col("depth") > d, at) for d, at in enumerate(last, 1)]
    return toc.withColumn("parent", F.greatest(*above))


def depth_first(nodes: DataFrame) -> DataFrame:
    """A forest (book_id, node_id, parent_id, pos, ...) with ``depth`` from 1 and ``play_order`` from 1,
    each node before its children, siblings by ``pos``. A level is a join; nodes that no root
    reaches (a lost parent, a ring) go."""
    tree = cut(nodes, "nodes")
    level = tree.where("parent_id is null").select("book_id", "node_id", F.array("pos").alias("path"))
    done = []
    while not level.isEmpty():
        level = cut(level, "level")
        done.append(level)
        below = tree.select("book_id", F.col("node_id").alias("child"), F.col("parent_id").alias("node_id"), "pos")
        level = below.join(level, ["book_id", "node_id"]).select("book_id", F.col("child").alias("node_id"), F.concat("path", F.array("pos")).alias("path"))
    paths = reduce(DataFrame.unionByName, done) if done else level
    order = Window.partitionBy("book_id").orderBy("path", "node_id")
    placed = paths.select("book_id", "node_id", F.size("path").alias("depth"), F.row_number().over(order).alias("play_order"))
    return tree.join(placed, ["book_id", "node_id"])


def split_document(html: Column) -> Column:
    """The chunks of a document, or null where it stays whole: a split before each h1 or h2 and
    after each page break; blank chunks go; many small chunks mean no split."""
    mark = "\u0001"
    has = html.rlike(r"(?is)<body[^>]*>.*</body>") & (F.octet_length(html) >= SPLIT_BYTES)
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    cut = F.regexp_replace(body, r"(?i)(<h[12][^>]*>)", mark + "$1")
    cut = F.regexp_replace(cut, r"""(?i)(<div[^>]*class\s*=\s*["']mbp_pagebreak["'][^>]*>\s*</div>)""", "$1" + mark)
    pieces = F.transform(F.split(cut, mark), X.trim)
    chunks = F.filter(pieces, lambda c, i: (c != "") & ~((i == 0) & (c == "<br/>")))
    small = (F.size(chunks) > SMALL_CHUNKS) & (F.floor(F.octet_length(body) / F.size(chunks)) < SMALL_BYTES)
    return F.when(has & (F.size(chunks) > 1) & ~small, chunks)


def chunk_title(chunk: Column) -> Column:
    return X.trim(X.strip_tags(F.regexp_extract(chunk, r"(?is)<h[12][^>]*>(.*?)</h[12]>", 1)))


def split_chapters(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and a row for each chapter: ``chunk`` (from 0), ``title``, ``body``. Whole
    documents are one chunk with their text."""
    rows = docs.withColumn("__chunks", split_document(F.col("text")))
    rows = rows.select(*keep, F.col("__chunks").isNotNull().alias("was_split"), F.posexplode(F.coalesce("__chunks", F.array("text"))).alias("chunk", "body"))
    return rows.withColumn("title", chunk_title(F.col("body")))


def data_uris(docs: DataFrame, only: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (book_id, pos, text, more) with embedded images set apart: the rewritten
    documents, and the images (book_id, n from 1 over the book, media_type, href, data).
    ``only``: which documents are searched."""
    pattern = r"""src\s*=\s*["'](data:([^;]+);base64,([^"']+))["']"""
    got = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
    rows = docs.where(F.contains("text", F.lit("data:")))
    rows = rows if only is None else rows.where(only)
    refs = rows.select("book_id", "pos", F.posexplode(F.arrays_zip(got(1).alias("uri"), got(2).alias("mime"), got(3).alias("code"))).alias("k", "r"))
    data = F.try_to_binary(F.regexp_replace("r.code", r"\s", ""), F.lit("base64"))
    refs = refs.select("book_id", "pos", "k", "r.uri", F.col("r.mime").alias("media_type"), data.alias("data")).where("data is not null")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("pos", "k"))
    refs = refs.withColumn("n", n).withColumn("href", F.concat(F.lit("data_image_"), "n", F.lit("."), X.lookup(F.col("media_type"), X.DATA_EXT, "bin")))
    by_doc = refs.groupBy("book_id", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "uri", "href"))).alias("refs"))
    joined = docs.join(by_doc, ["book_id", "pos"], "left")
    text = F.aggregate(F.coalesce("refs", F.array().cast("array<struct<k:int,uri:string,href:string>>")), F.col("text"), lambda t, r: F.replace(t, r["uri"], r["href"]))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns]), refs.select("book_id", "n", "media_type", "href", "data")


def clean_guide(guide: DataFrame) -> DataFrame:
    """Guides (book_id, pos, ref_type, title, href) with a cover and a text entry made of the
    aliases where they lack one, and without types outside the known ones; renumbered."""
    per = Window.partitionBy("book_id")
    has = lambda t: F.max(F.col("ref_type") == t).over(per)
    rank = F.array_position(F.array(*map(F.lit, COVER_ALIASES)), F.col("ref_type"))
    rows = guide.withColumn("__cover", has("cover")).withColumn("__text", has("text"))
    alias = rows.where(~F.col("__cover") & (rank > 0)).groupBy("book_id").agg(F.min_by("href", F.struct(rank, "pos")).alias("href"))
    cover = alias.select("book_id", F.lit(1 << 30).alias("pos"), F.lit("cover").alias("ref_type"), F.lit("Cover").alias("title"), "href")
    start = rows.where(~F.col("__text") & (F.col("ref_type") == "start")).groupBy("book_id").agg(F.min_by(F.struct("title", "href"), "pos").alias("s"))
    text = start.select("book_id", F.lit((1 << 30) + 1).alias("pos"), F.lit("text").alias("ref_type"), "s.title", "s.href")
    kept = guide.where(F.col("ref_type").isin(*GUIDE_TYPES)).select("book_id", "pos", "ref_type", "title", "href")
    out = kept.unionByName(cover).unionByName(text)
    return out.withColumn("pos", F.row_number().over(per.orderBy("pos")) - 1)


def merge_metadata(books: DataFrame) -> DataFrame:
    """``title``, ``language`` and ``uid`` with their defaults; the uid is made of the book's id."""
    uid = F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.col("book_id").cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    blank = lambda c, d: F.coalesce(F.when(X.trim(F.col(c)) != "", F.col(c)), d)
    return books.withColumns({"title": blank("title", F.lit("Untitled")), "language": blank("language", F.lit("en")), "uid": blank("uid", uid)})


def jacket(title: Column, authors: Column, publisher: Column | None = None, date: Column | None = None, description: Column | None = None, series: Column | None = None, series_index: Column | None = None) -> Column:
    """The XHTML of a jacket page; blank fields are left out."""
    name = F.coalesce(F.when(X.trim(title) != "", title), F.lit("Unknown Title"))
    field = lambda klass, v: F.when(X.trim(v) != "", F.concat(F.lit(f'<p class="{klass}">'), X.escape_text(v), F.lit("</p>")))
    parts = [F.concat(F.lit('<h1 class="title">'), X.escape_text(name), F.lit("</h1>")), field("authors", F.array_join(authors, ", "))]
    if series is not None:
        number = F.lit(None).cast("string") if series_index is None else F.when(X.trim(series_index) != "", series_index)
        parts.append(field("series", F.when(X.trim(series) != "", F.concat_ws(" #", series, number))))
    parts += [field(k, v) for k, v in (("publisher", publisher), ("date", date)) if v is not None]
    if description is not None:
        parts.append(F.when(X.trim(description) != "", F.concat(F.lit('<div class="description">'), description, F.lit("</div>"))))
    return X.xhtml_document(name, F.concat_ws("\n", *parts))


def remove_first_image(html: Column) -> Column:
    first = F.regexp_extract(html, "<img[^>]*>", 0)
    at = F.instr(html, first)
    return F.when(first == "", html).otherwise(F.concat(F.substr(html, F.lit(1), at - 1), F.substr(html, at + F.length(first))))


def linearize_tables(html: Column) -> Column:
    """Tables as nested divs. Cells are replaced before heads of tables, so that a thead counts
    as a header cell."""
    out = html
    for tag, klass in (("table", "table"), ("tr", "row"), ("td", "cell"), ("th", "cell linearized-header"), ("thead", "thead"), ("tbody", "tbody"), ("tfoot", "tfoot"), ("caption", "caption")):
        out = F.regexp_replace(out, f"(?i)<{tag}[^>]*>", f'<div class="linearized-{klass}">')
        out = F.regexp_replace(out, rf"(?iU)</{tag}\s*>", "</div>")
    for pattern in ("(?i)</?colgroup[^>]*>", "(?i)<col[^>]*>"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(F.contains(html, F.lit("<table")) | F.contains(html, F.lit("<TABLE")), out).otherwise(html)


def template_margins(media_type: Column, kind: Column, html: Column) -> Column:
    return F.when(media_type.isin(*PAGE_TEMPLATES) & (kind == "xhtml"), F.regexp_replace(html, r"margin\s*:\s*[^;]+;?", "")).otherwise(html)


def fake_margins(docs: DataFrame, only: Column | None = None) -> DataFrame:
    """Documents (book_id, pos, text, more), of those ``only`` names, without the left or right margin that 95 in 100 of a
    book's styled elements share. Partial counts are merged by book; the winners, one row for
    a book, come back over an equality join."""
    styles = F.regexp_extract_all("text", F.lit(r'<(p|div)\s[^>]*style\s*=\s*"([^"]*)"[^>]*>'), F.lit(2))
    searched = docs if only is None else docs.where(only)
    one = searched.select("book_id", F.explode(styles).alias("style"))
    value = lambda side: X.trim(F.regexp_extract("style", rf"margin-{side}\s*:\s*([^;]+)", 1))
    each = one.select("book_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), value(s).alias("value")) for s in ("left", "right")])).alias("m"))
    counted = each.groupBy("book_id", "m.side", "m.value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("book_id", "side"))
    most = counted.withColumn("total", total).where(~F.col("value").isin("", "0", "0px", "0pt", "0em") & (F.col("n") >= F.floor(F.col("total") * 0.95)))
    best = most.groupBy("book_id", "side").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    sides = best.groupBy("book_id").agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("left", "right")])
    text = F.col("text")
    for s in ("left", "right"):
        pattern = F.concat(F.lit(rf"margin-{s}\s*:\s*"), X.quote_regex(F.col(s)), F.lit(r"\s*;?"))
        text = F.when(F.col(s).isNull(), text).otherwise(F.regexp_replace(text, pattern, F.lit("")))
    gone = F.coalesce("left", "right").isNotNull()
    text = F.when(gone, F.regexp_replace(text, r'\s*style\s*=\s*"\s*"', "")).otherwise(text)
    text = text if only is None else F.when(only, text).otherwise(F.col("text"))
    return docs.join(sides, "book_id", "left").select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def css_links(html: Column, hrefs: list[str] | Column) -> Column:
    """A link to each sheet that the document does not name yet, before the end of its head."""
    hrefs = F.array(*map(F.lit, hrefs)) if isinstance(hrefs, list) else hrefs

    def link(out: Column, h: Column) -> Column:
        at = F.instr(F.lower(out), F.lit("</head>"))
        there = F.contains(out, F.concat(F.lit('href="'), h, F.lit('"'))) | F.contains(out, F.concat(F.lit("href='"), h, F.lit("'")))
        tag = F.concat(F.lit('<link rel="stylesheet" type="text/css" href="'), h, F.lit('"/>\n'))
        return F.when(there | (at == 0), out).otherwise(F.concat(F.substr(out, F.lit(1), at - 1), tag, F.substr(out, at)))

    return F.aggregate(hrefs, html, link)


def references(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``href``: what the documents refer to, each once."""
    refs = F.regexp_extract_all("text", F.lit(r"""(?:src|href)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return docs.select(*keep, F.explode(F.array_distinct(refs)).alias("href"))


def trim_manifest(manifest: DataFrame, spine: DataFrame, toc: DataFrame, guide: DataFrame) -> DataFrame:
    """The items that spine, contents, guide, documents or sheets refer to."""
    xhtml = manifest.where(F.col("media_type").isin(*XHTML))
    css = manifest.where("media_type = 'text/css'")
    urls = F.regexp_extract_all("text", F.lit(r"""url\(\s*["']?([^"')]+)["']?\s*\)"""), F.lit(1))
    hrefs = references(xhtml, ["book_id"]).unionByName(css.select("book_id", F.explode(urls).alias("href")))
    for table in (toc, guide):
        hrefs = hrefs.unionByName(table.select("book_id", X.fragment_strip(F.col("href")).alias("href")))
    named = manifest.join(hrefs.distinct(), ["book_id", "href"], "left_semi").select("book_id", "id")
    used = named.unionByName(spine.select("book_id", F.col("idref").alias("id"))).distinct()
    return manifest.join(used, ["book_id", "id"], "left_semi")


def fit_dimensions(width: Column, height: Column, most_width: int, most_height: int) -> tuple[Column, Column]:
    scale = F.least(F.lit(most_width) / width, F.lit(most_height) / height)
    side = lambda x: F.greatest(F.lit(1), F.round(x * scale)).cast("int")
    return side(width), side(height)


def relink_toc(toc: DataFrame, chunks: DataFrame) -> DataFrame:
    """Contents (book_id, play_order, title, href) after a split; chunks: book_id, from_href,
    title, href, pos. Entries of a split document go to its first chunk of the same title."""
    first = chunks.groupBy("book_id", "from_href", "title").agg(F.min_by("href", "pos").alias("__new"))
    keyed = toc.withColumn("from_href", X.fragment_strip(F.col("href")))
    out = keyed.join(first, ["book_id", "from_href", "title"], "left")
    kept = [c for c in toc.columns if c not in ("book_id", "play_order", "title", "href")]
    return out.select("book_id", "play_order", "title", F.coalesce("__new", "href").alias("href"), *kept)


#: A string or an address without quotes, which stay; and a comment. Possessive, so that the
#: matcher keeps no state for each character.
_KEPT = r"""("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'|(?i:url)\(\s*+[^"'()\s][^"'()]*+\))"""
_COMMENT = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"


def minify_css(css: Column) -> Column:
    """A sheet without comments and white space that means nothing. Strings and addresses are kept as
    they are; a comment between two names leaves a blank. A sheet with a string or comment that
    does not end is kept whole."""
    mark = "\u0001"
    # one pass tells strings from comments, whichever begins first
    bare = F.regexp_replace(F.translate(css, mark, ""), f"{_KEPT}|{_COMMENT}", "$1" + mark)
    bare = F.replace(F.regexp_replace(bare, rf"(?<=[\w%-]){mark}+(?=[\w%-])", " "), F.lit(mark), F.lit(""))

    def shrink(piece: Column) -> Column:
        one = F.regexp_replace(F.regexp_replace(piece, r"\s+", " "), " ?([{};,]) ?", "$1")
        return F.replace(F.replace(one, F.lit(": "), F.lit(":")), F.lit(";}"), F.lit("}"))

    pieces, strings = F.split(bare, _KEPT, -1), F.regexp_extract_all(bare, F.lit(_KEPT), F.lit(1))
    small = F.array_join(F.zip_with(pieces, strings, lambda p, s: F.concat(shrink(p), F.coalesce(s, F.lit("")))), "")
    torn = F.regexp_replace(bare, _KEPT, "").rlike(r"""["']|/\*""")
    return F.when(torn, css).otherwise(F.trim(small))
