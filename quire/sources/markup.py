"""Readers of marked-up text that need a parser for each book: Markdown, FB2, PDF page XML."""

from __future__ import annotations

import base64
import binascii
import contextlib
import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import book as B

_INLINE = (
    (re.compile(r"`([^`]+)`"), r"<code>\1</code>"),
    (re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)"), r'<img src="\2" alt="\1" />'),
    (re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>'),
    (re.compile(r"\*\*(.+?)\*\*|__(.+?)__"), lambda m: f"<strong>{m[1] or m[2]}</strong>"),
    (re.compile(r"\*(.+?)\*|\b_(.+?)_\b"), lambda m: f"<em>{m[1] or m[2]}</em>"),
)
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_ITEM = re.compile(r"(?:([-*+])|\d{1,9}[.)])\s+(.*)$")
_RULE = re.compile(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*$")


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, by in _INLINE:
        out = pattern.sub(by, out)
    return out


def markdown_html(text: str | None) -> str:
    """A subset of CommonMark: headings, paragraphs, quotes, flat lists, fenced code, rules,
    emphasis, code, links and images. No tables or footnotes."""
    out: list[str] = []
    para: list[str] = []
    listed: str | None = None
    code: list[str] | None = None

    def flush():
        nonlocal listed
        if para:
            out.append(f"<p>{_inline(chr(10).join(para))}</p>")
            para.clear()
        if listed:
            out.append(f"</{listed}>")
            listed = None

    for line in (text or "").split("\n"):
        if code is not None:
            if line.startswith("```"):
                out.append("<pre><code>" + html.escape("\n".join([*code, ""]), quote=False) + "</code></pre>")
                code = None
            else:
                code.append(line)
            continue
        heading, item = _HEADING.match(line), _ITEM.match(line)
        if line.startswith("```"):
            flush()
            code = []
        elif not line.strip():
            flush()
        elif heading:
            flush()
            n = len(heading[1])
            out.append(f"<h{n}>{_inline(heading[2])}</h{n}>")
        elif _RULE.match(line):
            flush()
            out.append("<hr />")
        elif item:
            kind = "ul" if item[1] else "ol"
            if listed != kind:
                flush()
                out.append(f"<{kind}>")
                listed = kind
            out.append(f"<li>{_inline(item[2])}</li>")
        elif line.startswith(">"):
            flush()
            out.append(f"<blockquote>\n<p>{_inline(line[1:].strip())}</p>\n</blockquote>")
        else:
            para.append(line.strip())
    if code is not None:
        out.append("<pre><code>" + html.escape("\n".join([*code, ""]), quote=False) + "</code></pre>")
    flush()
    return "\n".join(out) + ("\n" if out else "")


#: FB2 element -> HTML element within text; opening and closing tags of blocks.
_FB2_INLINE = {"strong": "strong", "emphasis": "em", "strikethrough": "del", "code": "code", "sub": "sub", "sup": "sup"}
_FB2_BLOCK = {"p": ("<p>", "</p>"), "v": ('<p class="verse">', "</p>"), "subtitle": ("<h3>", "</h3>"), "text-author": ('<p class="text-author">', "</p>")}
_FB2_FRAME = {"poem": ('<div class="poem">', "</div>"), "stanza": ('<div class="stanza">', "</div>"), "cite": ("<blockquote>", "</blockquote>"), "epigraph": ('<div class="epigraph">', "</div>")}


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _href(e: ET.Element) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "href"), "")


def _fb2_inline(e: ET.Element) -> str:
    parts = [B.text(e.text or "")]
    for c in e:
        kind = _name(c)
        if kind == "image":
            parts.append(_fb2_image(c))
        elif kind == "a":
            parts.append(f'<a href="{B.attr(_href(c))}">{_fb2_inline(c)}</a>')
        else:
            tag = _FB2_INLINE.get(kind)
            parts.append(f"<{tag}>{_fb2_inline(c)}</{tag}>" if tag else _fb2_inline(c))
        parts.append(B.text(c.tail or ""))
    return "".join(parts)


def _fb2_image(e: ET.Element) -> str:
    return f'<img src="images/{B.attr(_href(e).lstrip("#"))}" alt=""/>'


def _fb2_body(root: ET.Element) -> str:
    """The bodies as HTML. The depth of sections gives the heading level; a title outside any
    section is plain paragraphs."""
    out: list[str] = []
    # an explicit stack: sections may nest to any depth
    stack: list[tuple[str, ET.Element | None, int]] = [("", b, 0) for b in reversed([e for e in root if _name(e) == "body"])]
    while stack:
        closing, e, depth = stack.pop()
        if e is None:
            out.append(closing)
            continue
        kind = _name(e)
        if kind == "title" and depth:
            words = " ".join("".join(p.itertext()).strip() for p in e if _name(p) == "p").strip()
            if words:
                n = min(depth, 6)
                out.append(f"<h{n}>{B.text(words)}</h{n}>")
        elif kind in _FB2_BLOCK:
            before, after = _FB2_BLOCK[kind]
            out.append(f"{before}{_fb2_inline(e)}{after}")
        elif kind == "empty-line":
            out.append("<br/>")
        elif kind == "image":
            out.append(_fb2_image(e))
        else:
            if kind in _FB2_FRAME:
                before, after = _FB2_FRAME[kind]
                out.append(before)
                stack.append((after, None, depth))
            stack += [("", c, depth + (kind == "section")) for c in reversed(e)]
    return "\n".join(out)


def fb2_html(data: str) -> tuple[str | None, str]:
    """The title and the body's HTML of an FB2 book."""
    root = ET.fromstring(data)
    title = next((e.text.strip() for e in root.iter() if _name(e) == "book-title" and e.text), None)
    return title, _fb2_body(root)


def read_fb2(data: bytes, stem: str) -> dict:
    """An FB2 book: metadata of its three descriptions, text, embedded pictures. Pictures that
    are not base64 are left out."""
    root = ET.fromstring(data)
    terms = B.Terms()
    below = lambda kind: [e for d in root if _name(d) == "description" for i in d if _name(i) == kind for e in i]
    for e in below("title-info"):
        kind = _name(e)
        if kind == "author":
            names = [(c.text or "").strip() for c in e if _name(c) in ("first-name", "middle-name", "last-name", "nickname")]
            terms.add("creator", " ".join(n for n in names if n))
        elif kind == "genre":
            terms.add("subject", e.text)
        elif kind in ("book-title", "lang", "language", "date"):
            terms.put({"book-title": "title", "lang": "language"}.get(kind, kind), e.text)
    for e in below("publish-info"):
        if _name(e) in ("publisher", "isbn"):
            terms.put({"isbn": "identifier"}.get(_name(e), _name(e)), e.text)
    if terms.get("identifier") is None:
        terms.put("identifier", next((e.text for e in below("document-info") if _name(e) == "id"), None))
    pictures = []
    for e in root.iter():
        if _name(e) == "binary" and e.get("id") and e.get("content-type"):
            with contextlib.suppress(binascii.Error):
                pictures.append((e.get("id"), "images/" + e.get("id"), base64.b64decode(re.sub(r"\s", "", e.text or ""), validate=True), e.get("content-type")))
    book = B.single(stem, terms.rows, _fb2_body(root), [p[:3] for p in pictures])
    book["items"] = [(i, h, pictures[k][3] if k < len(pictures) else m, t, d) for k, (i, h, m, t, d) in enumerate(book["items"])]
    return book


#: Marks that stay in the text of a PDF page.
_PAGE_INLINE = ("b", "i", "a", "sup", "sub")


def page_inline(e: ET.Element) -> str:
    """The inside of a text element with its marks; as in the reference, its text is not escaped."""
    parts = [e.text or ""]
    for c in e:
        kind, inner = _name(c), page_inline(c)
        href = f' href="{B.attr(c.get("href"))}"' if kind == "a" and c.get("href") is not None else ""
        parts += [f"<{kind}{href}>{inner}</{kind}>" if kind in _PAGE_INLINE else inner, c.tail or ""]
    return "".join(parts)


def page_rows(data: str) -> list[tuple]:
    """The text elements of extracted PDF pages: (number, seq, top, left, width, height,
    font_id, text, inner_html). The text is without marks, the inner HTML has them."""
    rows = []
    for page in ET.fromstring(data).iter("page"):
        for seq, t in enumerate(page.iter("text")):
            at = [float(t.get(k, 0)) for k in ("top", "left", "width", "height")]
            rows.append((int(page.get("number", 0)), seq, *at, t.get("font"), "".join(t.itertext()), page_inline(t)))
    return rows


def _parsed(df: DataFrame, col: str, schema: str, names: list[str], types: list[pa.DataType], parse: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows that ``parse`` makes of each book; a book that cannot be read gives one with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(book, *r, None) for r in parse(raw or "")]
                except Exception as e:  # noqa: BLE001  a broken book does not end the job
                    rows = [(book, *[None] * len(types), f"{type(e).__name__}: {e}")]
                if rows:
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), [batch.schema.field(0).type, *types, pa.string()])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["book_id", *names, "error"])

    kind = df.schema["book_id"].dataType.simpleString()
    return df.select("book_id", col).mapInArrow(run, f"book_id {kind}, {schema}, error string")


def markdown_books(df: DataFrame, col: str) -> DataFrame:
    """df: book_id and Markdown text. ``book_id``, ``html``, ``error``."""
    return _parsed(df, col, "html string", ["html"], [pa.string()], lambda t: [(markdown_html(t),)])


def fb2_books(df: DataFrame, col: str) -> DataFrame:
    """df: book_id and FB2 XML. ``book_id``, ``title``, ``html``, ``error``."""
    return _parsed(df, col, "title string, html string", ["title", "html"], [pa.string()] * 2, lambda t: [fb2_html(t)])


def pdf_texts(df: DataFrame, col: str) -> DataFrame:
    """df: book_id and page XML. One row for each text element, as ``page_rows``."""
    names = ["number", "seq", "top", "left", "width", "height", "font_id", "text", "inner_html"]
    types = [pa.int32(), pa.int64(), *[pa.float64()] * 4, *[pa.string()] * 3]
    schema = "number int, seq long, top double, left double, width double, height double, font_id string, text string, inner_html string"
    return _parsed(df, col, schema, names, types, page_rows)
