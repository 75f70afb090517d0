"""Registered queries: each operator over the whole tables, with the same in SQL.

Raw pages hold no tables, styles, data URIs or curly quotes. Queries on those rewrite the
text in a fixed way first, in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pdf_pages as P
from ..operators import sinks as O
from ..operators import transforms as T
from ..sources import books as B
from ..sources import markup as M
from ..sources import readers as R
from . import convert as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "toc_detect"

#: White space of both regex dialects, at both ends.
_TRIM = r"regexp_replace({}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"
_BODY = r"CASE WHEN regexp_matches({0}, '(?is)<body[^>]*>.*</body>') THEN regexp_extract({0}, '(?is)<body[^>]*>(.*)</body>', 1) ELSE {0} END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str, text=None) -> DataFrame:
    """Pages as the XHTML items of one-document books."""
    p = _read(spark, sf_dir, "pages")
    body = F.col("html") if text is None else text(F.col("html"))
    return p.select(F.col("page_id").alias("book_id"), F.lit(0).alias("pos"), F.lit("content").alias("id"), F.lit("content.xhtml").alias("href"), F.lit("application/xhtml+xml").alias("media_type"), body.alias("text"))


_DEEP = "replace(replace(replace(html, '<p><b>', '<h2>'), '</b>', '</h2>'), '<li>', '<h3>x</h3><li>')"


def _deep(html):
    return F.replace(F.replace(F.replace(html, F.lit("<p><b>"), F.lit("<h2>")), F.lit("</b>"), F.lit("</h2>")), F.lit("<li>"), F.lit("<h3>x</h3><li>"))


def _toc_sql(html: str, more: str = "") -> str:
    one = " UNION ALL ".join(
        f"SELECT page_id, {n} AS level, string_split_regex(h, '(?i)<h{n}[^>]*>(.*?)</h{n}>') AS pc, regexp_extract_all(h, '(?i)<h{n}[^>]*>(.*?)</h{n}>') AS m, regexp_extract_all(h, '(?i)<h{n}[^>]*>(.*?)</h{n}>', 1) AS t FROM src" for n in range(1, 7)
    )
    return f"""
        WITH src AS (SELECT page_id, {html} AS h FROM pages), a AS ({one}),
        b AS (SELECT page_id, level, pc, m, t, unnest(generate_series(1, len(t))) AS k FROM a WHERE len(t) > 0),
        c AS (SELECT page_id, level,
                CAST(list_sum(list_transform(pc[1 : k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: strlen(x))), 0) AS BIGINT) AS byte_offset,
                {_TRIM.format("regexp_replace(t[k], '<[^>]+>', '', 'g')")} AS title FROM b)
        SELECT page_id, CAST(level AS INTEGER) AS level, byte_offset, title FROM c WHERE title <> '' {more}"""


@query(_toc_sql(_DEEP))
def toc_detect(spark, sf_dir):
    """Headings of all pages (h2 and h3 made of bold openings and list items)."""
    p = _read(spark, sf_dir, "pages").select("page_id", _deep(F.col("html")).alias("text"))
    return T.headings(p).select("page_id", "level", "byte_offset", "title")


@query(_toc_sql(_DEEP, "AND regexp_matches(title, '^[A-M]')"))
def toc_chapter_filter(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select("page_id", _deep(F.col("html")).alias("text"))
    return T.headings(p, chapter="^[A-M]").select("page_id", "level", "byte_offset", "title")


@query("WITH t AS (" + _toc_sql(_DEEP) + """)
        SELECT page_id AS book_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY byte_offset, level) AS INTEGER) AS play_order, title,
               CASE WHEN level <= 2 THEN 'content.xhtml' ELSE 'content.xhtml#heading-' || strlen(title) END AS href, 'h' || level AS klass FROM t""")
def play_order(spark, sf_dir):
    return T.detect_toc(_pages(spark, sf_dir, _deep)).drop("depth")


@query(f"SELECT page_id, {_TRIM.format(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?is)<title>(.*?)</title>' + chr(39) + ', 1)' + chr(41))} AS title FROM pages")
def html_title(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", R.html_title(F.col("html")).alias("title"))


@query(rf"""
        WITH b AS (SELECT page_id, html, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) AS body,
                     strlen(html) >= 10000 AND regexp_matches(html, '(?is)<body[^>]*>.*</body>') AS big FROM (SELECT page_id, {_DEEP} AS html FROM pages)),
        c AS (SELECT page_id, html, body, big, list_filter(string_split(regexp_replace(body, '(?i)(<h[12][^>]*>)', chr(1) || '\1', 'g'), chr(1)), lambda x: {_TRIM.format('x')} <> '') AS cs FROM b),
        d AS (SELECT page_id, CASE WHEN big AND len(cs) > 1 AND NOT (len(cs) > 5 AND strlen(body) // len(cs) < 500) THEN cs END AS cs, html FROM c),
        e AS (SELECT page_id, cs IS NOT NULL AS was_split, coalesce(list_transform(cs, lambda x: {_TRIM.format('x')}), [html]) AS cs FROM d),
        f AS (SELECT page_id, was_split, unnest(cs) AS body, unnest(generate_series(0, len(cs) - 1)) AS chunk FROM e)
        SELECT page_id, was_split, CAST(chunk AS INTEGER) AS chunk, md5(body) AS body_md5,
               {_TRIM.format("regexp_replace(regexp_extract(body, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), '<[^>]+>', '', 'g')")} AS title FROM f""")
def split_chapters(spark, sf_dir):
    docs = _pages(spark, sf_dir, _deep).select(F.col("book_id").alias("page_id"), "text")
    return T.split_chapters(docs, ["page_id"]).select("page_id", "was_split", "chunk", F.md5("body").alias("body_md5"), "title")


_REFS = r"""(?:src|href)\s*=\s*["'']([^"'']+)["'']"""


@query(f"SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{_REFS}', 1)) AS href FROM pages")
def refs_scan(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return T.references(p, ["page_id"])


@query(f"""
        WITH refs AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{_REFS}', 1)) AS href FROM pages),
        m AS (SELECT page_id, 'content' AS id, 'content.xhtml' AS href FROM pages UNION ALL SELECT page_id, 'the', '/The' FROM pages UNION ALL SELECT page_id, 'orphan', 'orphan.png' FROM pages)
        SELECT m.page_id AS book_id, m.id, m.href FROM m WHERE m.id = 'content' OR EXISTS (SELECT 1 FROM refs WHERE refs.page_id = m.page_id AND refs.href = m.href)""")
def manifest_trim(spark, sf_dir):
    """Each page's manifest gets an item that some pages link and one that none does."""
    pages = _pages(spark, sf_dir)
    extra = lambda i, h: pages.select("book_id", F.lit(1).alias("pos"), F.lit(i).alias("id"), F.lit(h).alias("href"), F.lit("image/png").alias("media_type"), F.lit(None).cast("string").alias("text"))
    manifest = pages.unionByName(extra("the", "/The")).unionByName(extra("orphan", "orphan.png"))
    spine = pages.select("book_id", F.col("id").alias("idref"))
    none = pages.where("false").select("book_id", "href")
    return T.trim_manifest(manifest, spine, none, none).select("book_id", "id", "href")


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""
        WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS ps FROM documents)
        SELECT doc_id, CAST(len(ps) AS INTEGER) AS n_paragraphs,
               md5(array_to_string(list_transform(ps, lambda x: '<p>' || replace({_ESC.format('x')}, chr(10), '<br/>' || chr(10)) || '</p>' || chr(10)), '')) AS html_md5 FROM p""")
def plaintext_xhtml(spark, sf_dir):
    """Documents as paragraphs (a full stop before a line feed is made to end one)."""
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    d = _read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return d.select("doc_id", F.size(X.paragraphs(F.col("text"))).alias("n_paragraphs"), F.md5(X.paragraph_html(F.col("text"))).alias("html_md5"))


_PLAIN = r"regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '\n{3,}', chr(10) || chr(10), 'g')".replace('\\"', '"')


@query(rf"""
        WITH b AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS t, regexp_replace({_BODY.format('html')}, '(?i)</?(p|div|h[1-6]|br|li|tr|blockquote|pre)[^>]*>', chr(10), 'g') AS b FROM pages)
        SELECT page_id, md5(regexp_replace({_TRIM.format('t')} || chr(10) || repeat('=', strlen({_TRIM.format('t')})) || chr(10) || chr(10) || {_TRIM.format(_PLAIN)}, '\s+$', '')) AS text_md5 FROM b""")
def txt_output(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    none = F.array().cast("array<string>")
    return p.select("page_id", F.md5(O.text_book(R.html_title(F.col("html")), none, F.array("html"))).alias("text_md5"))


@query(f"""
        SELECT conv_id, md5('<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<title>Conversation ' || conv_id || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
                 || string_agg('<p class="' || coalesce(role, '') || '">' || {_ESC.format("coalesce(text, '')")} || '</p>' || chr(10), '' ORDER BY turn, coalesce(role, ''), coalesce(text, '')) || '</body>' || chr(10) || '</html>' || chr(10)) AS html_md5
        FROM conversations GROUP BY conv_id""")
def html_output(spark, sf_dir):
    """Conversations as books whose spine is the order of turns; a null text or role is empty."""
    c = _read(spark, sf_dir, "conversations").withColumns({k: F.coalesce(k, F.lit("")) for k in ("text", "role")})
    body = F.concat(F.lit('<p class="'), "role", F.lit('">'), X.escape_text(F.col("text")), F.lit("</p>"))
    books = c.withColumn("body", body).groupBy("conv_id").agg(O.ordered(["turn", "role", "text"], "body").alias("docs"))
    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    return books.select("conv_id", F.md5(O.html_book(title, F.array().cast("array<string>"), F.transform("docs", lambda d: d["body"]))).alias("html_md5"))


_SMART = "replace(replace(replace(text, ' la ', ' “la” '), ' the ', ' ‘the’ '), '.', '… – —')"


@query(f"SELECT doc_id, md5(replace(replace(translate({_SMART}, '“”„‘’‚–', '\"\"\"''''''-'), '—', '--'), '…', '...')) AS text_md5 FROM documents")
def unsmarten(spark, sf_dir):
    """Documents with curly quotes and dashes written in, and taken out again."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.expr(_SMART).alias("t"))
    return d.select("doc_id", F.md5(X.unsmarten(F.col("t"))).alias("text_md5"))


_TABLES = "replace(replace(replace(replace(html, '<ul>', '<table class=\"x\"><thead><tr>'), '</ul>', '</tr></thead></table >'), '<li>', '<td a=\"1\">'), '</li>', '</td>')"


def _linear_sql() -> str:
    out = _TABLES
    for tag, klass in (("table", "table"), ("tr", "row"), ("td", "cell"), ("th", "cell linearized-header"), ("thead", "thead"), ("tbody", "tbody"), ("tfoot", "tfoot"), ("caption", "caption")):
        out = f"regexp_replace(regexp_replace({out}, '(?i)<{tag}[^>]*>', '<div class=\"linearized-{klass}\">', 'g'), '(?i)</{tag}\\s*>', '</div>', 'g')"
    return f"SELECT page_id, md5(regexp_replace(regexp_replace({out}, '(?i)</?colgroup[^>]*>', '', 'g'), '(?i)<col[^>]*>', '', 'g')) AS html_md5 FROM pages"


@query(_linear_sql())
def linearize_tables(spark, sf_dir):
    """Lists rewritten as tables, and the tables as divs."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.expr(_TABLES).alias("t"))
    return p.select("page_id", F.md5(T.linearize_tables(F.col("t"))).alias("html_md5"))


_STYLED = "replace(html, '<p>', '<p class=\"t\" style=\"margin-left: 2em;\">')"


@query(rf"""SELECT page_id AS book_id, md5(CASE WHEN contains(html, '<p>') THEN regexp_replace(regexp_replace({_STYLED}, 'margin-left\s*:\s*2em\s*;?', '', 'g'), '\s*style\s*=\s*"\s*"', '', 'g') ELSE html END) AS html_md5 FROM pages""")
def fake_margin(spark, sf_dir):
    """Paragraphs are given one left margin, which is then found to be a page's usual one."""
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), F.lit(0).alias("pos"), F.expr(_STYLED).alias("text"))
    return T.fake_margins(p).select("book_id", F.md5("text").alias("html_md5"))


_URI = "replace(html, '<article>', '<img src=\"data:image/png;base64,' || base64(CAST(url AS {})) || '\"/><article>')"


@query("""
        SELECT page_id AS book_id, CAST(1 AS INTEGER) AS n, 'data_image_1.png' AS href, url AS payload,
               md5(replace(html, '<article>', '<img src="data_image_1.png"/><article>')) AS html_md5 FROM pages WHERE contains(html, '<article>')""")
def data_url(spark, sf_dir):
    """Each page's address is embedded as an image and carved out again."""
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), F.lit(0).alias("pos"), F.expr(_URI.format("binary")).alias("text"))
    docs, images = T.data_uris(p)
    return images.join(docs, "book_id").select("book_id", "n", "href", F.col("data").cast("string").alias("payload"), F.md5("text").alias("html_md5"))


@query("""
        SELECT page_id AS book_id, CAST(pos AS INTEGER) AS pos, ref_type, title, href FROM pages, (VALUES
          (0, 'toc', 'T', 'toc.xhtml'), (1, 'cover', 'Cover', 'cover.jpg'), (2, 'text', 'Begin', 'ch1.xhtml')) g(pos, ref_type, title, href)""")
def clean_guide(spark, sf_dir):
    refs = [("ms-coverimage-standard", "C", "cover.jpg"), ("start", "Begin", "ch1.xhtml"), ("toc", "T", "toc.xhtml"), ("custom", "X", "x.xhtml")]
    rows = F.array(*[F.struct(F.lit(t).alias("ref_type"), F.lit(n).alias("title"), F.lit(h).alias("href")) for t, n, h in refs])
    guide = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), F.posexplode(rows).alias("pos", "r")).select("book_id", "pos", "r.*")
    return T.clean_guide(guide)


@query(r"""
        WITH m AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE url END AS title, md5(CAST(page_id AS VARCHAR)) AS h FROM pages)
        SELECT page_id AS book_id, CASE WHEN trim(title) = '' THEN 'Untitled' ELSE title END AS title, 'en' AS language,
               'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uid FROM m""")
def merge_metadata(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    null = F.lit(None).cast("string")
    b = p.select(F.col("page_id").alias("book_id"), F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.col("url")).alias("title"), null.alias("language"), null.alias("uid"))
    return T.merge_metadata(b)


_HEAD = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd">' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en">' || chr(10) || '<head>' || chr(10) || '  <title>'"""


@query(f"""
        WITH e AS (SELECT page_id, {_ESC.format('url')} AS t FROM pages)
        SELECT page_id, md5({_HEAD} || t || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<h1 class="title">' || t || '</h1>' || chr(10) || '<p class="authors">A, B &amp; C</p>' || chr(10) || '</body>' || chr(10) || '</html>') AS html_md5 FROM e""")
def jacket(spark, sf_dir):
    authors = F.array(F.lit("A"), F.lit("B & C"))
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(T.jacket(F.col("url"), authors)).alias("html_md5"))


@query("""
        SELECT page_id, md5(CASE WHEN instr(html, '</head>') = 0 THEN html ELSE
          substr(html, 1, instr(html, '</head>') - 1) || '<link rel="stylesheet" type="text/css" href="a.css"/>' || chr(10) || '<link rel="stylesheet" type="text/css" href="b.css"/>' || chr(10) || substr(html, instr(html, '</head>')) END) AS html_md5 FROM pages""")
def css_links(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(T.css_links(F.col("html"), ["a.css", "b.css"])).alias("html_md5"))


_MIME_SQL = "CASE lower(regexp_extract({0}, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MIME.items()) + " ELSE 'application/octet-stream' END"
_FORMAT_SQL = "CASE lower(regexp_extract({0}, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.FORMATS.items()) + " END"
_NAME = "url || '.' || CASE page_id % 5 WHEN 0 THEN 'EPUB' WHEN 1 THEN 'prc' WHEN 2 THEN 'css' WHEN 3 THEN 'xhtm' ELSE 'zzz' END"


@query(f"SELECT page_id, {_MIME_SQL.format('(' + _NAME + ')')} AS media_type, {_FORMAT_SQL.format('(' + _NAME + ')')} AS format, {_ESC.format('html')} = html AS plain, string_split(url || '#a#b', '#')[1] AS stripped FROM pages")
def format_detect(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").withColumn("n", F.expr(_NAME))
    return p.select("page_id", X.mime_type(F.col("n")).alias("media_type"), X.book_format(F.col("n")).alias("format"), (X.escape_text(F.col("html")) == F.col("html")).alias("plain"), X.fragment_strip(F.concat("url", F.lit("#a#b"))).alias("stripped"))


@query(f"""
        WITH h AS (SELECT page_id, regexp_replace({_BODY.format('html')}, '(?i)</?(!DOCTYPE|html|head|meta|link|title|xml)[^>]*>', '', 'g') AS t FROM pages)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS n_bytes, CAST(ceil(strlen(t) / 4096.0) AS INTEGER) AS n_records, md5(t) AS html_md5 FROM h""")
def mobi_records(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select("page_id", O.mobi_html(F.col("html")).alias("t"))
    size = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x))
    r = p.withColumn("r", O.mobi_records(F.col("t")))
    return r.select("page_id", size(F.col("r")).alias("n_bytes"), F.size("r").alias("n_records"), F.md5("t").alias("html_md5"))


@query()
def pdf_lines(spark, sf_dir):
    """The wrapped lines of each page's paragraphs (tests compare them with a plain loop)."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(O.pdf_paragraphs(F.col("html"))).alias("paragraph", "text"))
    return p.select("page_id", "paragraph", F.posexplode(X.wrap(F.col("text"))).alias("line", "text"))


@query()
def epub_round_trip(spark, sf_dir):
    """Pages written as EPUBs and read again: item, place in the spine, and the text's hash."""
    pages = _pages(spark, sf_dir).withColumn("data", F.lit(None).cast("binary"))
    toc = T.detect_toc(pages).groupBy("book_id").agg(O.ordered(["play_order"], "title", "href").alias("toc"))
    name = F.col("book_id").cast("string")
    books = pages.join(toc, "book_id", "left").select(
        "book_id",
        O.opf(name, name, F.lit("en"), F.array().cast("array<string>"), F.array(F.struct("id", "href", "media_type")), F.array(F.struct(F.col("id").alias("idref"), F.lit(True).alias("linear"))), F.array().cast("array<struct<ref_type:string,title:string,href:string>>")).alias("opf"),
        O.ncx(name, name, F.coalesce("toc", F.array().cast("array<struct<play_order:int,title:string,href:string>>"))).alias("ncx"),
    )
    items = R.epub_items(O.epub_files(books, pages))
    return items.where("id is null or id <> 'ncx'").select("book_id", "id", "href", "spine_pos", F.md5("text").alias("text_md5"), "error")


ORACLES["epub_round_trip"] = "SELECT page_id AS book_id, 'content' AS id, 'content.xhtml' AS href, CAST(0 AS INTEGER) AS spine_pos, md5(html) AS text_md5, CAST(NULL AS VARCHAR) AS error FROM pages"

#: Page elements are made of page ids: each page's words stand on a grid.
_GRID = "(page_id * 7919 + k * 104729) % 1009"


def _fragments(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), F.explode(F.sequence(F.lit(1), F.lit(24))).alias("k"), "page_id")
    g = F.expr(_GRID)
    return p.select("book_id", (F.col("k") % 4).cast("int").alias("number"), F.col("k").cast("long").alias("seq"), (F.floor(g % 97) * 1.0).alias("top"), (g % 13 * 1.0).alias("left"), F.lit(8.0).alias("height"), F.concat(F.lit("w"), F.col("k").cast("string")).alias("text"), (g % 3).cast("string").alias("font_id"))


@query(f"""
        WITH x AS (SELECT page_id AS book_id, CAST(k % 4 AS INTEGER) AS number, {_GRID} % 3 AS font FROM pages, generate_series(1, 24) s(k))
        SELECT book_id, number, CASE WHEN bool_or(font <> 0) THEN 'text' ELSE 'scanned' END AS page_type FROM x WHERE number < 3 GROUP BY ALL
        UNION ALL SELECT page_id, 3, 'image_only' FROM pages UNION ALL SELECT page_id, 4, 'blank' FROM pages""")
def page_classify(spark, sf_dir):
    f = _fragments(spark, sf_dir).where("number < 3")
    books = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"))
    pages = books.select("book_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("number"))
    fonts = books.select("book_id", F.lit("0").alias("id"), F.lit(0).alias("seq"), F.lit("GlyphLessFont").alias("family"))
    images = pages.where("number < 4").select("book_id", "number")
    return P.classify_pages(pages, f, fonts, images)


@query("""
        WITH x AS (SELECT DISTINCT page_id // 7 AS book_id, page_id * page_id % 101 AS number FROM pages),
        i AS (SELECT book_id, number, number - row_number() OVER (PARTITION BY book_id ORDER BY number) AS g FROM x)
        SELECT book_id, min(number) AS first, max(number) AS last FROM i GROUP BY book_id, g""")
def contiguous_ranges(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 7).cast("long").alias("book_id"), (F.col("page_id") * F.col("page_id") % 101).alias("number"))
    return P.contiguous_ranges(p)


@query()
def line_group(spark, sf_dir):
    """Fragments to lines (tests compare the anchors with a plain loop)."""
    return P.group_lines(_fragments(spark, sf_dir)).select("book_id", "number", "seq", "line")


@query(f"""
        WITH x AS (SELECT page_id AS book_id, CAST(k % 4 AS INTEGER) AS number, CAST(k AS INTEGER) AS line, k * 12.0 + CASE WHEN {_GRID} % 5 = 0 THEN 9.0 ELSE 0.0 END AS top, 8.0 AS height, 'w' || k AS text FROM pages, generate_series(1, 24) s(k)),
        g AS (SELECT *, CAST(top - lag(top + height) OVER w AS DOUBLE) AS gap FROM x WINDOW w AS (PARTITION BY book_id, number ORDER BY line)),
        m AS (SELECT *, coalesce(avg(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY book_id, number), 10.0) AS mean FROM g),
        p AS (SELECT *, CAST(sum(CASE WHEN gap > 1.5 * mean THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, number ORDER BY line) AS INTEGER) AS paragraph FROM m)
        SELECT book_id, number, paragraph, string_agg(text, ' ' ORDER BY line) AS text FROM p GROUP BY book_id, number, paragraph""")
def para_group(spark, sf_dir):
    f = _fragments(spark, sf_dir).withColumn("page_id", F.col("book_id")).withColumn("k", F.col("seq"))
    top = (F.col("k") * 12.0 + F.when(F.expr(_GRID) % 5 == 0, 9.0).otherwise(0.0)).cast("double")
    return P.group_paragraphs(f.select("book_id", "number", F.col("k").cast("int").alias("line"), top.alias("top"), "height", "text"))


def _files(df: DataFrame, path: str, data) -> DataFrame:
    return df.select("book_id", F.lit(path).alias("path"), data.cast("binary").alias("data"))


def _content(books: DataFrame) -> DataFrame:
    """The one document of each book that was read, hashed."""
    text = F.try_element_at(F.filter("items", lambda i: i["id"] == "content"), F.lit(1))["text"]
    return books.select("book_id", F.md5(text).alias("doc_md5"), F.size("toc").alias("n_toc"), "error")


_DOC = _HEAD + """ || {title} || '</title>' || chr(10) || '  <link rel="stylesheet" type="text/css" href="style.css"/>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || {body} || chr(10) || '</body>' || chr(10) || '</html>'"""
#: Characters that XML 1.0 cannot hold, and the carriage return, which its readers change.
_NO_XML = r"[^\x{9}\x{A}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
_CLEAN = "regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E\\n]', '', 'g')"


@query(f"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_NO_XML}', '', 'g') AS t FROM documents)
        SELECT doc_id AS book_id, md5({_DOC.format(title="'T' || doc_id", body="'<p>' || " + _ESC.format('t') + " || '</p>'")}) AS doc_md5, CAST(1 AS INTEGER) AS n_toc, CAST(NULL AS VARCHAR) AS error FROM d""")
def fb2_read(spark, sf_dir):
    """Documents, without what XML cannot hold, as FB2 books, and read."""
    t = X.escape_text(F.regexp_replace(F.coalesce("text", F.lit("")), _NO_XML, ""))
    d = _read(spark, sf_dir, "documents").withColumn("book_id", F.col("doc_id"))
    book = F.concat(F.lit("<FictionBook><description><title-info><book-title>T"), F.col("doc_id").cast("string"), F.lit("</book-title></title-info></description><body><section><p>"), t, F.lit("</p></section></body></FictionBook>"))
    return _content(B.read_books(_files(d, "x.fb2", book)))


@query(f"""
        WITH d AS (SELECT doc_id, list_filter(string_split({_CLEAN}, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)
        SELECT doc_id AS book_id, md5({_DOC.format(title="'x'", body="array_to_string(list_transform(ls, lambda x: '<p>' || " + _ESC.format('x') + " || '</p>' || chr(10)), '')")}) AS doc_md5, CAST(1 AS INTEGER) AS n_toc, CAST(NULL AS VARCHAR) AS error FROM d""")
def rtf_read(spark, sf_dir):
    """Documents (printable ASCII) as RTF, a paragraph for each line, and read."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7E\\n]", "")
    t = F.replace(F.regexp_replace(t, r"([\\\\{}])", r"\\\\$1"), F.lit("\n"), F.lit("\\par "))
    d = _read(spark, sf_dir, "documents").withColumn("book_id", F.col("doc_id"))
    return _content(B.read_books(_files(d, "x.rtf", F.concat(F.lit("{\\rtf1\\ansi "), t, F.lit("}")))))


@query(rf"""
        WITH h AS (SELECT page_id, regexp_replace({_BODY.format('html')}, '(?i)</?(!DOCTYPE|html|head|meta|link|title|xml)[^>]*>', '', 'g') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(chr(10) || t || chr(10), '<a\s+[^>]*>\s*</a>', '', 'g') AS t FROM h)
        SELECT page_id AS book_id, md5({_DOC.format(title="'T' || page_id", body="t")}) AS doc_md5, CAST(NULL AS VARCHAR) AS error FROM b""")
def mobi_round_trip(spark, sf_dir):
    """Pages written as MOBI files and read again."""
    p = _pages(spark, sf_dir).withColumn("data", F.lit(None).cast("binary"))
    none = F.array().cast("array<struct<term:string,value:string>>")
    books = p.select("book_id", F.lit("x").alias("stem"), none.alias("metadata"), F.concat(F.lit("T"), F.col("book_id").cast("string")).alias("title"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("error"))
    spine = p.select("book_id", F.lit(0).alias("pos"), F.col("id").alias("idref"))
    files = C.write_mobi(B.Books(books, p, spine, p, p))
    return _content(B.read_books(_files(files, "x.mobi", F.col("data")))).drop("n_toc")


def _shelf(spark, sf_dir) -> B.Books:
    """Ten pages are one book; its contents name each page's first chapter title."""
    p = _read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).cast("long").alias("book_id"), (F.col("page_id") % 10).cast("int").alias("pos"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), _deep(F.col("html")).alias("text"))
    m = p.select("book_id", "pos", "id", F.concat("id", F.lit(".xhtml")).alias("href"), F.lit("application/xhtml+xml").alias("media_type"), "text", F.lit(None).cast("binary").alias("data"))
    title = T.chunk_title(F.col("text"))
    toc = m.select("book_id", (F.col("pos") + 1).alias("play_order"), title.alias("title"), "href")
    books = m.select("book_id").distinct().withColumn("next_id", F.lit(1))
    return B.Books(books, m, m.select("book_id", "pos", F.col("id").alias("idref"), F.lit(True).alias("linear")), toc, toc)


_SHELF_SQL = (
    "WITH s AS (" + ORACLES["split_chapters"] + """),
        n AS (SELECT page_id, page_id // 10 AS book_id, chunk, title,
                CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id, chunk) - 1 AS INTEGER) AS pos,
                sum(CASE WHEN chunk > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id // 10 ORDER BY page_id, chunk) AS k, was_split FROM s)
        """
)


@query(_SHELF_SQL + "SELECT book_id, pos, 'p' || page_id || CASE WHEN chunk > 0 THEN '_ch' || CAST(k AS BIGINT) ELSE '' END AS idref FROM n")
def spine_renumber(spark, sf_dir):
    """The spine of books of ten pages after their long documents are split."""
    return C.split_chapters(_shelf(spark, sf_dir)).spine.select("book_id", "pos", "idref")


@query(_SHELF_SQL + rf""", t AS (SELECT page_id, {_TRIM.format("regexp_replace(regexp_extract(h, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), '<[^>]+>', '', 'g')")} AS title FROM (SELECT page_id, {_DEEP} AS h FROM pages)),
        f AS (SELECT page_id, title, min(chunk) AS chunk FROM n WHERE was_split GROUP BY ALL)
        SELECT t.page_id // 10 AS book_id, CAST(t.page_id % 10 + 1 AS INTEGER) AS play_order, t.title, 'p' || t.page_id || CASE WHEN f.chunk > 0 THEN '_ch' || f.chunk ELSE '' END || '.xhtml' AS href
        FROM t LEFT JOIN f ON f.page_id = t.page_id AND f.title = t.title""")
def toc_relink(spark, sf_dir):
    """Contents of the same books: an entry goes to the first chapter of its title."""
    return C.split_chapters(_shelf(spark, sf_dir)).toc.select("book_id", "play_order", "title", "href")


_XML_LINES = "regexp_replace({}, '[^A-Za-z0-9 ]', '', 'g')"


@query(f"SELECT page_id AS book_id, CAST(1 + k AS INTEGER) AS number, CAST(0 AS BIGINT) AS seq, CAST(10 * k AS DOUBLE) AS top, CAST(5 AS DOUBLE) AS \"left\", 'f' || k AS font_id, 'a ' || {_XML_LINES.format('url')} AS text FROM pages, generate_series(0, 2) s(k)")
def page_xml_read(spark, sf_dir):
    """Three pages of extracted text for each address, and read."""
    word = F.regexp_replace("url", "[^A-Za-z0-9 ]", "")
    one = [F.concat(F.lit(f'<page number="{k + 1}"><text top="{10 * k}" left="5" font="f{k}">a <b>'), word, F.lit("</b></text></page>")) for k in range(3)]
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("book_id"), F.concat(F.lit("<pdf2xml>"), *one, F.lit("</pdf2xml>")).alias("x"))
    return M.pdf_texts(p, "x").select("book_id", "number", "seq", "top", "left", "font_id", "text")
