"""Readers: tables of raw books to the tables of the data model."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def html_title(html: Column) -> Column:
    """The text of the title tag, or null if there is none or it is blank."""
    return F.nullif(X.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), F.lit(""))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _resolved(base: str, href: str) -> str:
    """An address of a document in the folder ``base`` as a name in the archive."""
    return posixpath.normpath(posixpath.join(base, unquote(href))) if href else ""


def _points(root: ET.Element) -> list[tuple[str, str, int]]:
    """The navigation points as (label, address, depth), a parent before its children."""
    out: list[tuple[str, str, int]] = []
    stack = [(e, 1) for e in reversed([m for m in root if _local(m.tag) == "navMap"])]
    while stack:
        e, depth = stack.pop()
        below = depth
        if _local(e.tag) == "navPoint":
            own = [c for c in e if _local(c.tag) in ("navLabel", "content")]
            label = next(("".join(t.itertext()).strip() for c in own for t in c if _local(t.tag) == "text"), "")
            src = next((c.get("src") or "" for c in own if _local(c.tag) == "content"), "")
            out.append((label, src, depth))
            below = depth + 1
        stack += [(c, below) for c in reversed(e) if _local(c.tag) == "navPoint"]
    return out


def read_epub(data: bytes) -> dict:
    """An EPUB's tables: metadata, manifest, spine, toc, guide. Addresses are percent-decoded before
    their files are looked up, and relative to the package file; those of the contents and the
    guide too. Items whose file is missing are kept without data; spine entries without an item go."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    root = next(e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile")
    base = posixpath.dirname(root)
    file_of = {}
    out: dict = {"metadata": [], "manifest": [], "spine": [], "toc": [], "guide": [], "uid": None}
    toc_id = None
    for e in ET.fromstring(z.read(root)).iter():
        kind = _local(e.tag)
        if "purl.org/dc" in e.tag and e.text:
            out["metadata"].append((kind, e.text.strip()))
            if kind == "identifier" and e.get("id") == "bookid":
                out["uid"] = e.text.strip()
        elif kind in ("series", "series_index") and e.text:
            out["metadata"].append((kind, e.text.strip()))
        elif kind == "item":
            href = e.get("href") or ""
            # a name may stand in the archive as it is written, too
            name = next((n for n in (_resolved(base, href), posixpath.join(base, href)) if n in names), None)
            file_of[e.get("id")] = name
            out["manifest"].append((e.get("id"), unquote(href), e.get("media-type"), z.read(name) if name else None))
        elif kind == "spine":
            toc_id = e.get("toc")
        elif kind == "itemref":
            out["spine"].append(e.get("idref"))
        elif kind == "reference" and e.get("type") and e.get("href"):
            href = unquote(e.get("href"))
            out["guide"].append((e.get("type"), e.get("title") or "", href.removeprefix(base + "/") if base else href))
    ids = {m[0] for m in out["manifest"]}
    out["spine"] = [i for i in out["spine"] if i in ids]
    nav = next((m[3] for m in out["manifest"] if m[0] == toc_id and m[3]), None)
    if nav:
        folder = posixpath.dirname(file_of[toc_id])
        for label, src, depth in _points(ET.fromstring(nav)):
            path, mark, fragment = src.partition("#")
            href = posixpath.relpath(_resolved(folder, path), base or ".") if path else ""
            out["toc"].append((label, href + mark + unquote(fragment), depth))
    return out


def is_text(media_type: str | None) -> bool:
    """Types whose payload is a text."""
    kind = (media_type or "").partition(";")[0].strip().lower()
    return kind.startswith("text/") or kind.endswith(("xml", "json", "javascript"))


def epub_items(files: DataFrame) -> DataFrame:
    """files: book_id, data. A row for each manifest item of every book: ``book_id``, ``pos``,
    ``id``, ``href``, ``media_type``, ``text`` (XHTML, sheets, XML), ``data`` (others), and
    ``spine_pos``; a book that cannot be read gives one row with ``error``."""
    kind = files.schema["book_id"].dataType.simpleString()
    schema = f"book_id {kind}, pos int, id string, href string, media_type string, text string, data binary, spine_pos int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                try:
                    tables = read_epub(data.as_py())
                    place = {i: k for k, i in reversed(list(enumerate(tables["spine"])))}
                    for pos, (i, href, media, raw) in enumerate(tables["manifest"]):
                        textual = is_text(media)
                        rows.append((book, pos, i, href, media, raw.decode("utf-8", "replace") if raw is not None and textual else None, None if textual else raw, place.get(i), None))
                except Exception as e:  # noqa: BLE001  a broken book does not end the job
                    rows.append((book, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int32(), *[pa.string()] * 4, pa.binary(), pa.int32(), pa.string()))], names=schema_names)

    schema_names = ["book_id", "pos", "id", "href", "media_type", "text", "data", "spine_pos", "error"]
    return files.select("book_id", "data").mapInArrow(run, schema)
