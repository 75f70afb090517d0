"""The conversion of a collection: reader tables, an ordered list of transforms, a writer.

A stage maps ``Books`` to ``Books`` by declaring plans. Where the tables that follow would each
repeat a long plan, ``apply`` writes them once (``CUTS``): manifests after the first and before
and after the splitting stage, narrow tables after the stages that make them. Stages that an
option turns off are not in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import png
from ..functions import text as X
from ..operators import binary_books, sinks
from ..operators import transforms as T
from ..options import Options
from ..sources.books import Books
from ..store import cut

Stage = Callable[[Books], Books]


def _is_doc() -> Column:
    return F.col("media_type").isin(*T.XHTML)


def _is_css() -> Column:
    return F.col("media_type") == "text/css"


#: Stage -> the tables that are written once it is declared.
CUTS = {
    "data_url": ("books", "manifest"),
    "detect_structure": ("books", "toc", "guide"),
    "flatten_css": ("books", "manifest", "spine"),
    "page_margin": ("manifest",),
    "split_chapters": ("books", "manifest", "spine", "toc"),
    "trim_manifest": ("manifest",),
}


def _numbered(b: Books, added: DataFrame) -> DataFrame:
    """Books whose ``next_id`` has moved on by the counts in ``added`` (book_id, n)."""
    moved = F.col("next_id") + F.coalesce("n", F.lit(0))
    return b.books.join(added, "book_id", "left").withColumn("next_id", moved.cast("int")).drop("n")


def _append(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (book_id, k, id, href, media_type, text, data) after each book's last item."""
    last = manifest.groupBy("book_id").agg((F.max("pos") + 1).alias("__last"))
    placed = new.join(last, "book_id", "left").withColumn("pos", (F.coalesce("__last", F.lit(0)) + F.col("k")).cast("int"))
    return manifest.unionByName(placed.select(*manifest.columns))


def data_url(b: Books) -> Books:
    docs, images = T.data_uris(b.manifest, _is_doc())
    new = images.join(b.books.select("book_id", "next_id"), "book_id").select(
        "book_id", (F.col("n") - 1).alias("k"), F.concat(F.lit("dataimg"), F.col("next_id") + F.col("n") - 1).alias("id"), "href", "media_type", F.lit(None).cast("string").alias("text"), "data"
    )
    counts = images.groupBy("book_id").agg(F.count("*").alias("n"))
    return b.having(books=_numbered(b, counts), manifest=_append(docs, new))


def clean_guide(b: Books) -> Books:
    return b.having(guide=T.clean_guide(b.guide))


def merge_metadata(b: Books) -> Books:
    return b.having(books=T.merge_metadata(b.books))


def detect_structure(chapter: str | None) -> Stage:
    def run(b: Books) -> Books:
        """Contents of the books without any: from headings, else one entry for a spine item."""
        bare = b.books.join(b.toc.select("book_id").distinct(), "book_id", "left_anti").select("book_id")
        found = T.detect_toc(b.manifest.join(bare, "book_id", "left_semi"), chapter).drop("klass")
        still = bare.join(found.select("book_id").distinct(), "book_id", "left_anti")
        order = F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))
        spine = b.spine.join(still, "book_id", "left_semi").withColumn("play_order", order)
        ids = b.manifest.select("book_id", F.col("id").alias("idref"), "href")
        sections = spine.join(ids, ["book_id", "idref"]).select("book_id", "play_order", F.concat(F.lit("Section "), F.col("play_order").cast("string")).alias("title"), "href", F.lit(1).alias("depth"))
        return b.having(toc=b.toc.unionByName(found).unionByName(sections))

    return run


def jacket(insert: bool, drop_image: bool) -> Stage:
    def run(b: Books) -> Books:
        """The first picture of the first spine document goes; a jacket page comes first."""
        manifest, books, spine = b.manifest, b.books, b.spine
        if drop_image:
            first = b.spine.groupBy("book_id").agg(F.min_by("idref", "pos").alias("id")).withColumn("__first", F.lit(True))
            bare = F.when(F.col("__first") & _is_doc(), T.remove_first_image(F.col("text"))).otherwise(F.col("text"))
            manifest = manifest.join(first, ["book_id", "id"], "left").withColumn("text", bare).select(*b.manifest.columns)
        if insert:
            values = lambda t: F.transform(F.filter("metadata", lambda m: m["term"] == t), lambda m: m["value"])
            one = lambda t: F.try_element_at(values(t), F.lit(1))
            page = T.jacket(F.col("title"), F.coalesce(values("creator"), F.array().cast("array<string>")), one("publisher"), one("date"), one("description"), one("series"), one("series_index"))
            new_id = F.concat(F.lit("jacket"), F.col("next_id").cast("string"))
            readable = books.where("error is null")
            new = readable.select("book_id", F.lit(0).alias("k"), new_id.alias("id"), F.lit("jacket.xhtml").alias("href"), F.lit("application/xhtml+xml").alias("media_type"), page.alias("text"), F.lit(None).cast("binary").alias("data"))
            spine = spine.withColumn("pos", F.col("pos") + 1).unionByName(readable.select("book_id", F.lit(0).alias("pos"), new_id.alias("idref"), F.lit(True).alias("linear")))
            manifest, books = _append(manifest, new), books.withColumn("next_id", F.col("next_id") + 1)
        return b.having(manifest=manifest, books=books, spine=spine)

    return run


def _on_docs(change: Callable[[Column], Column]) -> Stage:
    return lambda b: b.having(manifest=b.manifest.withColumn("text", F.when(_is_doc(), change(F.col("text"))).otherwise(F.col("text"))))


def flatten_css(extra: str | None) -> Stage:
    def run(b: Books) -> Books:
        """Extra rules go to the first sheet or a new one; sheets are minified; documents link
        all sheets of their book."""
        manifest, books = b.manifest, b.books
        if extra:
            first = manifest.where(_is_css()).groupBy("book_id").agg(F.min("pos").alias("pos")).withColumn("__first", F.lit(True))
            more = F.when(F.col("__first"), F.concat("text", F.lit("\n\n/* Extra CSS */\n" + extra))).otherwise(F.col("text"))
            manifest = manifest.join(first, ["book_id", "pos"], "left").withColumn("text", more).select(*b.manifest.columns)
            bare = books.where("error is null").join(first, "book_id", "left_anti")
            new = bare.select("book_id", F.lit(0).alias("k"), F.concat(F.lit("css"), F.col("next_id").cast("string")).alias("id"), F.lit("extra.css").alias("href"), F.lit("text/css").alias("media_type"), F.lit(extra).alias("text"), F.lit(None).cast("binary").alias("data"))
            manifest, books = _append(manifest, new), _numbered(b, bare.select("book_id", F.lit(1).alias("n")))
        sheets = manifest.where(_is_css()).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda s: s["href"]).alias("__sheets"))
        linked = T.css_links(F.col("text"), F.coalesce("__sheets", F.array().cast("array<string>")))
        text = F.when(_is_css(), T.minify_css(F.col("text"))).when(_is_doc(), linked).otherwise(F.col("text"))
        return b.having(books=books, manifest=manifest.join(sheets, "book_id", "left").withColumn("text", text).select(*b.manifest.columns))

    return run


def page_margin(b: Books) -> Books:
    kind = F.when(F.col("text").isNotNull(), "xhtml")
    plain = b.manifest.withColumn("text", T.template_margins(F.col("media_type"), kind, F.col("text")))
    return b.having(manifest=T.fake_margins(plain, _is_doc()))


def rescale_images(most: tuple[int, int]) -> Stage:
    def run(b: Books) -> Books:
        """PNG pictures over the size are resampled; others are kept. Rows stay where they are."""
        names = b.manifest.columns
        schema = b.manifest.schema

        def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = names.index("data")
                kinds = batch.column(names.index("media_type"))
                data = [d.as_py() if not d.is_valid or not (k.as_py() or "").startswith("image/") else png.shrink(d.as_py(), k.as_py(), most)[0] for d, k in zip(batch.column(at), kinds)]
                columns = [pa.array(data, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return b.having(manifest=b.manifest.mapInArrow(shrink, schema))

    return run


def split_chapters(b: Books) -> Books:
    """Long documents become one item a chapter. The first keeps id and address; the others
    are numbered in the order of spine and chapters. Only split documents' rows are renumbered."""
    spine = b.spine.select("book_id", F.col("pos").alias("__at"), F.col("idref").alias("id"), "linear")
    docs = b.manifest.where(_is_doc()).join(spine, ["book_id", "id"])
    long = docs.withColumn("__chunks", T.split_document(F.col("text"))).where("__chunks is not null")
    rows = long.select("book_id", "__at", F.col("pos").alias("__doc"), "id", "href", F.posexplode("__chunks").alias("chunk", "body")).withColumn("title", T.chunk_title(F.col("body")))
    rows = rows.join(b.books.select("book_id", "next_id"), "book_id")
    new = F.when(F.col("chunk") > 0, 1).otherwise(0)
    order = Window.partitionBy("book_id").orderBy("__at", "chunk").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__n", F.col("next_id") + F.sum(new).over(order) - 1)
    base = F.regexp_replace("href", r"\.xhtml$", "")
    rows = rows.select(
        "book_id", "__at", "__doc", "chunk", "title", F.col("id").alias("from_id"), F.col("href").alias("from_href"),
        F.when(F.col("chunk") == 0, F.col("id")).otherwise(F.concat("id", F.lit("_ch"), F.col("__n").cast("string"))).alias("id"),
        F.when(F.col("chunk") == 0, F.col("href")).otherwise(F.concat(base, F.lit("_ch"), F.col("chunk").cast("string"), F.lit(".xhtml"))).alias("href"),
        X.xhtml_document(F.when(F.col("title") == "", "Chapter").otherwise(F.col("title")), F.col("body"), css="style.css").alias("text"),
    )
    rows = cut(rows, "chapters")  # used for items, spine, contents and counts
    whole = b.manifest.join(rows.select("book_id", F.col("__doc").alias("pos")).distinct(), ["book_id", "pos"], "left_anti")
    firsts = rows.where("chunk = 0").select("book_id", F.col("__doc").alias("pos"), "id", "href", F.lit("application/xhtml+xml").alias("media_type"), "text", F.lit(None).cast("binary").alias("data"))
    later = rows.where("chunk > 0").withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("__at", "chunk")) - 1)
    later = later.select("book_id", "k", "id", "href", F.lit("application/xhtml+xml").alias("media_type"), "text", F.lit(None).cast("binary").alias("data"))
    manifest = _append(whole.unionByName(firsts.select(*whole.columns)), later)
    pieces = b.spine.select("book_id", "pos", F.lit(0).alias("chunk"), "idref", "linear").join(rows.select("book_id", F.col("__at").alias("pos")).distinct(), ["book_id", "pos"], "left_anti")
    pieces = pieces.unionByName(rows.select("book_id", F.col("__at").alias("pos"), "chunk", F.col("id").alias("idref"), F.lit(True).alias("linear")))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("pos", "chunk")) - 1
    spine = pieces.withColumn("pos", place).select(*b.spine.columns)
    chunks = rows.select("book_id", "from_href", "title", "href", F.struct("__at", "chunk").alias("pos"))
    counts = rows.where("chunk > 0").groupBy("book_id").agg(F.count("*").alias("n"))
    return b.having(books=_numbered(b, counts), manifest=manifest, spine=spine, toc=T.relink_toc(b.toc, chunks))


def trim_manifest(b: Books) -> Books:
    return b.having(manifest=T.trim_manifest(b.manifest, b.spine, b.toc, b.guide).select(*b.manifest.columns))


def standard_stages(o: Options) -> list[tuple[str, Stage]]:
    """The transforms in their order: structure before splitting, sheets before margins."""
    stages: list[tuple[str, Stage | None]] = [
        ("data_url", data_url),
        ("clean_guide", clean_guide),
        ("merge_metadata", merge_metadata),
        ("detect_structure", detect_structure(o.chapter_regex)),
        ("jacket", jacket(o.insert_metadata, o.remove_first_image) if o.insert_metadata or o.remove_first_image else None),
        ("linearize_tables", _on_docs(T.linearize_tables) if o.linearize_tables else None),
        ("unsmarten_punctuation", _on_docs(X.unsmarten) if o.unsmarten_punctuation else None),
        ("flatten_css", flatten_css(o.extra_css)),
        ("page_margin", page_margin),
        ("rescale_images", rescale_images(o.max_image_size) if o.max_image_size and not o.no_images else None),
        ("split_chapters", split_chapters),
        ("trim_manifest", trim_manifest),
    ]
    return [(n, s) for n, s in stages if s is not None]


def apply(b: Books, stages: list[tuple[str, Stage]], progress: Callable[[float, str], None] | None = None) -> Books:
    """``b`` after all stages. ``progress`` hears of each stage before it is declared."""

    def step(acc: Books, at: tuple[int, tuple[str, Stage]]) -> Books:
        k, (name, stage) = at
        if progress:
            progress(0.34 + 0.56 * k / len(stages), name)
        done = stage(acc)
        return done.having(**{t: cut(getattr(done, t), t) for t in CUTS.get(name, ())})

    return reduce(step, enumerate(stages), b)


def summary(b: Books) -> DataFrame:
    """The debug dump's first file: ``book_id``, ``title``, ``authors``, item and spine counts."""
    count = lambda t, n: t.groupBy("book_id").agg(F.count("*").alias(n))
    authors = F.transform(F.filter("metadata", lambda m: m["term"] == "creator"), lambda m: m["value"])
    books = b.books.select("book_id", "title", authors.alias("authors"))
    joined = books.join(count(b.manifest, "n_items"), "book_id", "left").join(count(b.spine, "n_spine"), "book_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_items", "n_spine")})


def dump(b: Books, folder: str) -> None:
    """The debug dump of one point of the pipeline: a summary and the manifest's list."""
    flat = summary(b).withColumn("authors", F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "; "))
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/metadata")
    b.manifest.select("book_id", "pos", "id", "href", "media_type").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/manifest")


# Writers -----------------------------------------------------------------------------------


def _spine_texts(b: Books, name: str, one: Callable[[Column], Column]) -> DataFrame:
    """``book_id`` and the documents of its spine, in order, each through ``one``."""
    ids = b.manifest.where(_is_doc()).select("book_id", F.col("id").alias("idref"), one(F.col("text")).alias("x"))
    rows = b.spine.select("book_id", "pos", "idref").join(ids, ["book_id", "idref"])
    return rows.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias(name))


def _authors() -> Column:
    found = F.transform(F.filter("metadata", lambda m: m["term"] == "creator"), lambda m: m["value"])
    return F.coalesce(found, F.array().cast("array<string>"))


def _utf8(x: Column) -> Column:
    return F.encode(x, "UTF-8")


def write_txt(b: Books) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = b.books.join(_spine_texts(b, "docs", lambda t: t), "book_id", "left")
    return rows.select("book_id", _utf8(sinks.text_book(F.col("title"), _authors(), F.coalesce("docs", none))).alias("data"))


def write_html(b: Books) -> DataFrame:
    """The book as one page, and as ``files`` (href, data) the pictures that belong beside it."""
    none = F.array().cast("array<string>")
    body = lambda t: F.nullif(F.regexp_extract(t, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit(""))
    sheets = b.manifest.where(_is_css()).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("sheets"))
    shown = b.manifest.where(F.col("media_type").startswith("image/") & F.col("data").isNotNull())
    files = shown.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href", "data"))), lambda r: F.struct(r["href"].alias("href"), r["data"].alias("data"))).alias("files"))
    rows = b.books.join(_spine_texts(b, "docs", body), "book_id", "left").join(sheets, "book_id", "left").join(files, "book_id", "left")
    docs = F.filter(F.coalesce("docs", none), lambda d: d.isNotNull())
    return rows.select("book_id", _utf8(sinks.html_book(F.col("title"), F.coalesce("sheets", none), docs)).alias("data"), "files")


def write_epub(b: Books) -> DataFrame:
    spine = b.spine.groupBy("book_id").agg(sinks.ordered(["pos"], "idref", "linear").alias("spine"))
    items = b.manifest.groupBy("book_id").agg(sinks.ordered(["pos"], "id", "href", "media_type").alias("items"))
    toc = b.toc.groupBy("book_id").agg(sinks.ordered(["play_order"], "title", "href").alias("toc"))
    guide = b.guide.groupBy("book_id").agg(sinks.ordered(["pos"], "ref_type", "title", "href").alias("guide"))
    rows = b.books.where("error is null")
    for t in (spine, items, toc, guide):
        rows = rows.join(t, "book_id", "left")
    empty = {
        "items": "array<struct<pos:int,id:string,href:string,media_type:string>>", "spine": "array<struct<pos:int,idref:string,linear:boolean>>",
        "toc": "array<struct<play_order:int,title:string,href:string>>", "guide": "array<struct<pos:int,ref_type:string,title:string,href:string>>",
    }
    full = {c: F.coalesce(F.col(c).cast(t), F.array().cast(t)) for c, t in empty.items()}
    one = lambda t: F.try_element_at(F.filter("metadata", lambda m: m["term"] == t), F.lit(1))["value"]
    more = (one("description"), one("publisher"), one("date"))
    package = rows.select("book_id", sinks.opf(F.col("uid"), F.col("title"), F.col("language"), _authors(), full["items"], full["spine"], full["guide"], *more).alias("opf"), sinks.ncx(F.col("uid"), F.col("title"), full["toc"]).alias("ncx"))
    return sinks.epub_files(package, b.manifest)


def _pictures(b: Books) -> DataFrame:
    rows = b.manifest.where(F.col("media_type").startswith("image/") & F.col("data").isNotNull())
    return rows.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "data"))), lambda r: r["data"]).alias("pictures"))


def _built(rows: DataFrame, build: Callable[[dict], bytes]) -> DataFrame:
    """``book_id``, ``data``: each row's bytes, and ``error``: why there are none. A book is one row."""
    kind = rows.schema["book_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                try:
                    data, error = build(one.to_pylist()[0]), None
                except ValueError as e:
                    data, error = None, str(e)
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["book_id", "data", "problem"])

    return rows.mapInArrow(run, f"book_id {kind}, data binary, problem string")


def _terms(row: dict) -> list[tuple[str, str]]:
    kept = [(m["term"], m["value"]) for m in row["metadata"] or () if m["term"] not in ("title", "language")]
    return [("title", row["title"]), ("language", row["language"]), *kept]


def write_mobi(b: Books) -> DataFrame:
    texts = _spine_texts(b, "docs", sinks.mobi_html)
    head = F.concat(F.lit("<html><head><title>"), X.escape_text(F.col("title")), F.lit("</title></head><body>\n"))
    docs = F.coalesce("docs", F.array().cast("array<string>"))
    html = F.concat(head, sinks.joined(docs, lambda d: F.concat(d, F.lit("\n"))), F.lit("</body></html>"))
    rows = b.books.where("error is null").join(texts, "book_id", "left").join(_pictures(b), "book_id", "left")
    rows = rows.select("book_id", "title", "language", "metadata", html.alias("html"), "pictures")
    return _built(rows, lambda r: binary_books.mobi_file(r["title"], _terms(r), r["html"], r["pictures"] or []))


def write_pdf(b: Books) -> DataFrame:
    def doc(text: Column) -> Column:
        body = X.body_or_all(text)
        got = lambda g: F.regexp_extract_all(body, F.lit(r"(?i)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(g))
        clean = F.transform(got(2), lambda t: X.trim(X.decode_entities(X.strip_tags(t))))
        heads = F.filter(F.arrays_zip(F.transform(got(1), lambda n: n.cast("int")).alias("level"), clean.alias("text")), lambda h: h["text"] != "")
        return F.struct(heads.alias("heads"), sinks.pdf_paragraphs(text).alias("paragraphs"))

    rows = b.books.where("error is null").join(_spine_texts(b, "docs", doc), "book_id", "left").join(_pictures(b), "book_id", "left")
    rows = rows.select("book_id", "title", _authors().alias("authors"), "docs", "pictures")
    docs = lambda r: [([(h["level"], h["text"]) for h in d["heads"]], d["paragraphs"]) for d in r["docs"] or ()]
    return _built(rows, lambda r: binary_books.pdf_file(r["title"], r["authors"], docs(r), r["pictures"] or []))


#: Format -> writer of ``book_id`` and ``data``. Other formats have none.
WRITERS: dict[str, Callable[[Books], DataFrame]] = {"txt": write_txt, "html": write_html, "epub": write_epub, "mobi": write_mobi, "pdf": write_pdf}


def convert(b: Books, target: str, options: Options | None = None, stages: list[tuple[str, Stage]] | None = None) -> DataFrame:
    """``book_id``, ``stem``, ``data``, ``files`` (pictures that belong beside the book, of HTML only),
    ``error``: one row for each book. A book that was not read or cannot be written has no data
    and says why."""
    if target not in WRITERS:
        raise ValueError(f"no writer for format {target}; there are {', '.join(WRITERS)}")
    done = apply(b, standard_stages(options or Options()) if stages is None else stages)
    readable = done.having(books=done.books.where("error is null"))
    data = WRITERS[target](readable)
    more = {"files": "array<struct<href:string,data:binary>>", "problem": "string"}
    data = data.select("book_id", "data", *[F.col(c) if c in data.columns else F.lit(None).cast(t).alias(c) for c, t in more.items()])
    return b.books.select("book_id", "stem", "error").join(data, "book_id", "left").select("book_id", "stem", "data", "files", F.coalesce("error", "problem").alias("error"))
