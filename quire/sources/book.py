"""What every reader of one book returns, and the pieces that readers share.

A parsed book is a dict of lists: ``metadata`` (term, value), ``items`` (id, href, media_type,
text, data), ``spine`` (idref, linear), ``toc`` (title, href), ``guide`` (ref_type, title, href).
"""

from __future__ import annotations

import html
import re

from ..functions.text import DOCTYPE

XHTML = "application/xhtml+xml"
#: Extension -> media type of embedded pictures; others count as JPEG.
PICTURES = {"png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "bmp": "image/bmp", "webp": "image/webp"}
#: Fixed value: the sheet of books that are one document.
STYLE = "body { font-family: serif; line-height: 1.6; margin: 1em; }\np { margin: 0.5em 0; }\nimg { max-width: 100%; height: auto; }\n"
_MAGIC = ((b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp"))


def text(value: str) -> str:
    return html.escape(value, quote=False)


def attr(value: str) -> str:
    return text(value).replace('"', "&quot;")


def picture_type(name: str) -> str:
    return PICTURES.get(name.rsplit(".", 1)[-1].lower(), "image/jpeg")


def sniff(data: bytes) -> str:
    """The extension that a picture's first bytes tell; ``jpg`` if none does."""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return next((e for m, e in _MAGIC if data.startswith(m)), "jpg")


def document(title: str, body: str, lang: str = "en") -> str:
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n{DOCTYPE}\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{attr(lang)}">\n<head>\n'
    return f'{head}  <title>{text(title)}</title>\n  <link rel="stylesheet" type="text/css" href="style.css"/>\n</head>\n<body>\n{body}\n</body>\n</html>'


def contents(body: str, title: str, deepest: int = 3) -> list[tuple[str, str]]:
    """Contents of a one-document book: its headings in order; without any, its title."""
    found = []
    for n in range(1, deepest + 1):
        for m in re.finditer(rf"(?i)<h{n}[^>]*>(.*?)</h{n}>", body):
            found.append((m.start(), re.sub("<[^>]+>", "", m[1]).strip()))
    entries = [(html.unescape(t), "content.xhtml") for _, t in sorted(found) if t]
    return entries or [(title, "content.xhtml")]


def single(stem: str, metadata: list[tuple[str, str]], body: str, pictures: list[tuple[str, str, bytes]] = ()) -> dict:
    """A book of one document; ``pictures``: (id, href, data). Its title is the file's stem if
    the metadata have none."""
    known = dict(reversed(metadata))
    title, lang = known.get("title") or stem, known.get("language") or "en"
    if not known.get("title"):
        metadata = [("title", stem), *metadata]
    items = [(i, href, picture_type(href), None, data) for i, href, data in pictures]
    items += [("content", "content.xhtml", XHTML, document(title, body, lang), None), ("style", "style.css", "text/css", STYLE, None)]
    return {"metadata": metadata, "items": items, "spine": [("content", True)], "toc": contents(body, title), "guide": []}


class Terms:
    """Metadata under construction: ``put`` replaces a term, ``add`` appends to it."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []

    def get(self, term: str) -> str | None:
        return next((v for t, v in self.rows if t == term), None)

    def add(self, term: str, value: str | None) -> None:
        if value and value.strip():
            self.rows.append((term, value.strip()))

    def put(self, term: str, value: str | None) -> None:
        if value and value.strip():
            self.rows = [r for r in self.rows if r[0] != term]
            self.add(term, value)
