"""Extracted PDF pages (page XML) and the information dictionary of PDF files."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import page_inline

_BOX = "top:double,left:double,width:double,height:double"
SCHEMA = (
    "pages array<struct<number:int,width:double,height:double>>, "
    f"texts array<struct<number:int,seq:bigint,{_BOX},font_id:string,inner_html:string>>, "
    f"images array<struct<number:int,seq:bigint,{_BOX},src:string>>, "
    "fonts array<struct<id:string,seq:bigint,size:double,family:string,color:string>>, "
    "outline array<struct<node_id:bigint,parent_id:bigint,pos:int,title:string,page:int>>, error string"
)


def _number(e: ET.Element, key: str, default: float = 0.0) -> float:
    try:
        return float(e.get(key, default))
    except ValueError:
        return default


def _whole(e: ET.Element, key: str, default: int) -> int:
    value = e.get(key, "")
    return int(value) if re.fullmatch(r"\d{1,9}", value) else default


def _outline(root: ET.Element, first: int) -> list[tuple]:
    """(node, parent, place among its siblings, title, page): an outline after an item holds the
    item's children, as do items within an item."""
    out: list[tuple] = []
    stack = [(root, None)]
    while stack:
        e, parent = stack.pop()
        here = [c for c in e if c.tag in ("item", "outline")]
        pos, last = 0, parent
        for c in here:
            if c.tag == "outline":
                stack.append((c, last))
                continue
            last = first + len(out)
            own = [c.text or "", *(k.tail or "" for k in c)]
            out.append((last, parent, pos, "".join(own).strip(), _whole(c, "page", 1)))
            pos += 1
            if len(c):
                stack.append((c, last))
    return out


def parse(data: str, part: int = 0) -> dict:
    """The rows of one page XML. What was whole before an XML error is kept. Numbers of elements
    begin anew in each ``part`` of a book, above those of the parts before."""
    base = part << 32
    out: dict = {"pages": [], "texts": [], "images": [], "fonts": [], "outline": [], "error": None}
    parser = ET.XMLPullParser(["start", "end"])
    try:
        parser.feed(data)
        parser.close()
    except ET.ParseError as e:
        out["error"] = str(e)
    depth = 0  # of nested outlines
    try:
        for event, e in parser.read_events():
            if e.tag == "outline":
                depth += 1 if event == "start" else -1
                if event == "end" and depth == 0:
                    out["outline"] += _outline(e, base + len(out["outline"]))
            elif event == "end" and e.tag == "page":
                number = _whole(e, "number", 0)
                out["pages"].append((number, _number(e, "width"), _number(e, "height")))
                box = lambda c: [_number(c, k) for k in ("top", "left", "width", "height")]
                for c in e.iter():
                    if c.tag == "text":
                        out["texts"].append((number, base + len(out["texts"]), *box(c), str(_whole(c, "font", 0)), page_inline(c)))
                    elif c.tag == "image":
                        out["images"].append((number, base + len(out["images"]), *box(c), c.get("src", "")))
                e.clear()
            elif event == "end" and e.tag == "fontspec":
                out["fonts"].append((str(_whole(e, "id", 0)), base + len(out["fonts"]), _number(e, "size"), e.get("family", ""), e.get("color", "#000000")))
    except ET.ParseError as e:
        out["error"] = str(e)
    if out["pages"]:
        out["error"] = None
    elif out["error"] is None:
        out["error"] = "no pages"
    return out


def pdf_parts(df: DataFrame, col: str, part: str | None = None) -> DataFrame:
    """df: book_id and page XML; ``part``: a column that numbers the page ranges of a book, where each
    is a row. A row for each: ``book_id``, the lists of ``SCHEMA``, ``error``. Null XML has no pages."""
    src = df.select("book_id", F.col(col).cast("string").alias("x"), (F.lit(0) if part is None else F.col(part)).cast("int").alias("p"))
    kind = df.schema["book_id"].dataType.simpleString()
    out = f"book_id {kind}, {SCHEMA}"

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(f"book_id {kind}, {SCHEMA}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = parse(batch.column(1)[k].as_py() or "", batch.column(2)[k].as_py() or 0)
                columns = [batch.column(0).slice(k, 1)]
                for f in list(arrow)[1:-1]:
                    names = [x.name for x in f.type.value_type]
                    columns.append(pa.array([[dict(zip(names, r)) for r in got[f.name]]], f.type))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([got["error"]], pa.string())], schema=arrow)

    return src.mapInArrow(run, out)


_PAIR = re.compile(rb"/(Title|Author|Subject)\s*(\(|<(?!<))")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|[\s\S])")


def _literal(raw: bytes, at: int) -> bytes:
    """The string whose opening bracket stands before ``at``; brackets may nest."""
    depth, p = 1, at
    while p < len(raw) and depth:
        c = raw[p]
        depth += (c == 0x28) - (c == 0x29)
        p += 2 if c == 0x5C else 1

    def plain(m: re.Match) -> bytes:
        x = m[1]
        if x[:1] in b"01234567":
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)

    return _ESCAPE.sub(plain, raw[at : p - 1])


def info(data: bytes | None) -> dict[str, bytes]:
    """Title, author and subject as raw strings, from the information dictionary that the last
    trailer names. None of them where that is in a compressed object, or there is none."""
    if not data:
        return {}
    refs = re.findall(rb"/Info\s+(\d{1,10})\s+(\d{1,5})\s+R", data)
    if not refs:
        return {}
    # the last object of that number is the valid one
    begin = [m.end() for m in re.finditer(rb"(?<![0-9])" + refs[-1][0] + rb"\s+" + refs[-1][1] + rb"\s+obj", data)]
    if not begin:
        return {}
    end = data.find(b"endobj", begin[-1])
    raw = data[begin[-1] : end if end >= 0 else len(data)]
    out: dict[str, bytes] = {}
    for m in _PAIR.finditer(raw):
        name = m[1].decode().lower()
        if m[2] == b"(":
            value = _literal(raw, m.end())
        else:
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw[m.end() : raw.find(b">", m.end())])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        out.setdefault(name, value)
    return out


def pdf_info(df: DataFrame, col: str) -> DataFrame:
    """df: book_id and the bytes of PDF files. ``book_id``, ``title``, ``author``, ``subject`` binary."""
    kind = df.schema["book_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = info(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([got.get(n)], pa.binary()) for n in ("title", "author", "subject"))], names=["book_id", "title", "author", "subject"])

    return df.select("book_id", F.col(col).cast("binary")).mapInArrow(run, f"book_id {kind}, title binary, author binary, subject binary")
