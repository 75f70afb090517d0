"""Scalar functions on columns. Java's regex dialect is bent here, once, to the dialect of
the data model: a dot stops at a line feed only, white space and case are Unicode's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> media type.
MIME = {
    "xhtml": "application/xhtml+xml", "xhtm": "application/xhtml+xml", "html": "text/html", "htm": "text/html", "css": "text/css",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp",
    "avif": "image/avif", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2", "xml": "application/xml",
    "opf": "application/oebps-package+xml", "ncx": "application/x-dtbncx+xml", "js": "application/javascript", "json": "application/json",
    "txt": "text/plain", "pdf": "application/pdf",
}
#: Extension -> format, with aliases.
FORMATS = {
    "epub": "epub", "pdf": "pdf", "mobi": "mobi", "prc": "mobi", "azw": "azw", "azw3": "azw3", "kf8": "azw3", "kfx": "azw3", "html": "html",
    "htm": "html", "xhtml": "xhtml", "xhtm": "xhtml", "txt": "txt", "md": "markdown", "markdown": "markdown", "docx": "docx", "fb2": "fb2",
    "rtf": "rtf", "odt": "odt",
}
#: Fixed value.
DOCTYPE = '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd">'
#: Image type -> extension of an extracted data URI.
DATA_EXT = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/svg+xml": "svg", "image/webp": "webp", "image/bmp": "bmp"}
#: Entity -> character, decoded in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[key], F.lit(default))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def mime_type(path: Column) -> Column:
    return lookup(extension(path), MIME, "application/octet-stream")


def book_format(path: Column) -> Column:
    return lookup(extension(path), FORMATS)


def strip_tags(text: Column, by: str = "") -> Column:
    return F.regexp_replace(text, "<[^>]+>", by)


def trim(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"(?U)\s+", " "))


def replace_all(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape_text(text: Column) -> Column:
    return replace_all(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def escape_attr(text: Column) -> Column:
    return replace_all(escape_text(text), (('"', "&quot;"),))


def decode_entities(text: Column) -> Column:
    return replace_all(text, ENTITIES)


def fragment_strip(href: Column) -> Column:
    return F.substring_index(href, "#", 1)


def body_or_all(html: Column) -> Column:
    """The inside of the body; the whole text if it has none."""
    found = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.when(html.rlike(r"(?is)<body[^>]*>.*</body>"), found).otherwise(html)


def xhtml_document(title: Column, body: Column, lang: str = "en", css: str | None = None) -> Column:
    link = f'  <link rel="stylesheet" type="text/css" href="{css}"/>\n' if css else ""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n' + DOCTYPE + f'\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{lang}">\n<head>\n  <title>'
    return F.concat(F.lit(head), escape_text(title), F.lit("</title>\n" + link + "</head>\n<body>\n"), body, F.lit("\n</body>\n</html>"))


def paragraphs(text: Column) -> Column:
    """The paragraphs of plain text: blank lines part them, blank ones are dropped."""
    return F.filter(F.transform(F.split(text, "\n\n"), trim), lambda p: p != "")


def paragraph_html(text: Column) -> Column:
    one = lambda p: F.concat(F.lit("<p>"), F.replace(escape_text(p), F.lit("\n"), F.lit("<br/>\n")), F.lit("</p>\n"))
    return F.array_join(F.transform(paragraphs(text), one), "")


def plain_text(xhtml: Column) -> Column:
    """Readable text of an XHTML document: block tags end lines, other tags go, entities are decoded."""
    body = F.regexp_replace(body_or_all(xhtml), r"(?i)</?(p|div|h[1-6]|br|li|tr|blockquote|pre)[^>]*>", "\n")
    return trim(F.regexp_replace(decode_entities(strip_tags(body)), r"\n{3,}", "\n\n"))


def unsmarten(text: Column) -> Column:
    flat = F.translate(text, "“”„‘’‚–", "\"\"\"'''-")
    return replace_all(flat, (("—", "--"), ("…", "...")))


def quote_regex(value: Column) -> Column:
    r"""``value`` as a literal of a pattern; a \E inside is set apart."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def running(values: Column, op: Callable[[Column, Column], Column], neutral: int) -> Column:
    """The running ``op`` over an array of longs, in steps of doubled width: n log n, where a fold
    that appends would copy the array for each element."""
    none = F.lit(neutral).cast("bigint")

    def widen(acc: Column, k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), k)
        return F.zip_with(acc, F.concat(F.array_repeat(none, width), F.slice(acc, F.lit(1), F.size(acc) - width)), op)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, widen))


def inner_text(html: Column) -> Column:
    """Text without tags, character by character: an unclosed tag swallows the rest, a stray closing
    bracket goes."""
    return F.regexp_replace(html, r"<[^>]*(?:>|\z)|>", "")


def pdf_string(raw: Column) -> Column:
    """A PDF's string as text: UTF-16 or UTF-8 by its mark, UTF-8 if it is that, else Latin-1. An
    odd last byte of UTF-16 goes."""
    mark = lambda n: F.hex(F.substring(raw, 1, n))
    rest = lambda at, n: F.substring(raw, F.lit(at), n)
    wide = F.decode(rest(3, F.octet_length(raw) - 2 - F.octet_length(raw) % 2), "UTF-16BE")
    as_utf8 = F.try_validate_utf8(raw.cast("string"))
    return F.when(mark(2) == "FEFF", wide).when(mark(3) == "EFBBBF", rest(4, F.octet_length(raw)).cast("string")).otherwise(F.coalesce(as_utf8, F.decode(raw, "ISO-8859-1")))


def wrap(text: Column, width: int = 82) -> Column:
    """Lines of at most ``width`` bytes, filled greedily; a longer word has its own line."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        full = (acc["line"] != "") & (F.octet_length(acc["line"]) + F.octet_length(word) + 1 > width)
        line = F.when(full | (acc["line"] == ""), word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        return F.struct(F.when(full, F.array_append(acc["done"], acc["line"])).otherwise(acc["done"]).alias("done"), line.alias("line"))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])))
