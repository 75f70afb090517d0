"""The bytes of MOBI and PDF books, from texts that the plan has prepared."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..functions import png

TEXT_RECORD = 4096
NONE = 0xFFFFFFFF
#: Term -> EXTH record type, after language, title, authors and source.
EXTH = (("publisher", 101), ("identifier", 104), ("description", 103), ("subject", 105), ("date", 106))
SOURCE = b"quire"
#: Fixed values of the two closing information records, big-endian words.
_FLIS = b"FLIS" + struct.pack(">IHHIIHHIII", 8, 65, 0, 0, NONE, 1, 3, 3, 1, NONE)
_EOF = bytes.fromhex("e98e0d0a")


def exth(metadata: list[tuple[str, str]]) -> bytes:
    """The metadata block; record lengths are exact, the block is padded to four bytes."""
    first = dict(reversed(metadata))
    rows = [(524, first.get("language") or "en")]
    rows += [(503, first["title"])] if first.get("title") else []
    rows += [(100, v) for t, v in metadata if t == "creator"]
    rows.append((108, SOURCE))
    rows += [(code, first[term]) for term, code in EXTH if first.get(term)]
    raw = [(code, v if isinstance(v, bytes) else v.encode()) for code, v in rows]
    body = b"".join(struct.pack(">II", code, 8 + len(v)) + v for code, v in raw)
    block = b"EXTH" + struct.pack(">II", 12 + len(body), len(raw)) + body
    return block + bytes(-len(block) % 4)


def _mobi_header(text_bytes: int, n_text: int, n_pictures: int, title: bytes, block: bytes) -> bytes:
    """Record 0. Words are set at their offsets in a header of 232 bytes after the first 16."""
    size = 232
    head = bytearray(16 + size)
    struct.pack_into(">HHIHHHH", head, 0, 1, 0, text_bytes, n_text, TEXT_RECORD, 0, 0)
    head[16:20] = b"MOBI"
    flis = n_text + n_pictures + 1
    words = {20: size, 24: 2, 28: 65001, 36: 6, 80: n_text + 1, 84: 16 + size + len(block), 88: len(title), 92: 9, 104: 6}
    words |= {k: NONE for k in range(40, 80, 4)}
    words |= {108: n_text + 1 if n_pictures else NONE, 128: 0x50 if block else 0, 164: NONE, 196: 1, 200: flis, 204: flis + 1}
    words |= {208: 1, 212: 1, 216: NONE, 224: NONE, 236: NONE}
    for at, value in words.items():
        struct.pack_into(">I", head, at, value)
    struct.pack_into(">HH", head, 192, 0xFFFF, n_text + 1)
    out = bytes(head) + block + title
    return out + bytes(-len(out) % 4)


def mobi_file(title: str, metadata: list[tuple[str, str]], html: str, pictures: list[bytes]) -> bytes:
    """A MOBI 6 book, not compressed: header, text records, pictures, two information records,
    end mark. A text of more records than the format can count raises ValueError."""
    raw = html.encode()
    texts = [raw[k : k + TEXT_RECORD] for k in range(0, len(raw), TEXT_RECORD)]
    if len(texts) + len(pictures) + 4 > 0xFFFF:
        raise ValueError("too many records")
    fcis = b"FCIS" + struct.pack(">8I2HI", 20, 16, 1, 0, len(raw), 0, 32, 8, 1, 1, 0)
    known = any(t in ("title", "creator") for t, _ in metadata)
    name = title.encode()
    head = _mobi_header(len(raw), len(texts), len(pictures), name, exth(metadata) if known else b"")
    records = [head, *texts, *pictures, _FLIS, fcis, _EOF]
    out = bytearray(78)
    short = name[:31]
    out[: len(short)] = short
    out[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", out, 76, len(records))
    at = 78 + 8 * len(records) + 2
    for k, r in enumerate(records):
        out += struct.pack(">II", at, k)
        at += len(r)
    return bytes(out) + bytes(2) + b"".join(records)


#: Fixed values of the page: A4 and margin in millimetres, sizes in points.
PAGE_W, PAGE_H, MARGIN = 210.0, 297.0, 25.0
BODY, HEADS, OTHER_HEAD, LEADING, MM_PER_PT, WIDTH = 11.0, {1: 22.0, 2: 18.0}, 15.0, 1.4, 0.353, 82
_FONTS = {"F1": "Helvetica", "F2": "Helvetica-Bold", "F3": "Helvetica-Oblique"}
PT = 72 / 25.4


def wrap(text: str, width: int = WIDTH) -> list[str]:
    lines, line = [], ""
    for word in text.split():
        if line and len(line.encode()) + len(word.encode()) + 1 > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}" if line else word
    return [*lines, line] if line else lines


class _Pages:
    """Lines and pictures from the top of a page down; a new page where none would fit."""

    def __init__(self) -> None:
        self.pages: list[list[str]] = [[]]
        self.y = PAGE_H - MARGIN

    def room(self, needed: float) -> None:
        if self.y - needed < MARGIN:
            self.pages.append([])
            self.y = PAGE_H - MARGIN

    def line(self, text: str, size: float, font: str) -> None:
        height = size * LEADING * MM_PER_PT
        self.room(height)
        raw = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        self.pages[-1].append(f"BT /{font} {size:g} Tf {MARGIN * PT:.2f} {self.y * PT:.2f} Td ({raw.decode('latin-1')}) Tj ET")
        self.y -= height

    def picture(self, name: str, w: int, h: int) -> None:
        mm = 25.4 / 96
        scale = min((PAGE_W - 2 * MARGIN) / (w * mm), (PAGE_H - 2 * MARGIN) / (h * mm), 1.0)
        wide, high = w * mm * scale, h * mm * scale
        self.room(high)
        self.pages[-1].append(f"q {wide * PT:.2f} 0 0 {high * PT:.2f} {MARGIN * PT:.2f} {(self.y - high) * PT:.2f} cm /{name} Do Q")
        self.y -= high + 5


def _jpeg_frame(data: bytes) -> tuple[int, int, int]:
    """Width, height and components of a JPEG, from its frame header."""
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            raise ValueError("broken JPEG")
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack_from(">HHB", data, at + 5)
            return w, h, n
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    raise ValueError("no frame")


def _image(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and the object of a picture; ValueError where it cannot be placed."""
    if data.startswith(b"\xff\xd8"):
        w, h, n = _jpeg_frame(data)
        space, code, body = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n], "DCTDecode", data
    else:
        pixels = png.decode(data)
        h, w, n = pixels.shape
        if n in (2, 4):  # over white
            alpha = pixels[:, :, -1:].astype(np.uint16)
            pixels = ((pixels[:, :, :-1] * alpha + 255 * (255 - alpha)) // 255).astype(np.uint8)
        space, code, body = "DeviceGray" if pixels.shape[2] == 1 else "DeviceRGB", "FlateDecode", zlib.compress(pixels.tobytes())
    head = f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{space} /BitsPerComponent 8 /Filter /{code} /Length {len(body)} >>\nstream\n"
    return w, h, head.encode() + body + b"\nendstream"


def pdf_file(title: str, authors: list[str], docs: list[tuple[list[tuple[int, str]], list[str]]], pictures: list[bytes]) -> bytes:
    """A PDF: title, authors, then of each document all headings and all paragraphs, pictures
    last. Characters outside Windows-1252 show as question marks; pictures that cannot be
    decoded are left out."""
    p = _Pages()
    p.line(title, HEADS[1], "F2")
    p.y -= 5
    for a in authors:
        p.line(a, BODY, "F3")
    p.y -= 10
    for heads, paragraphs in docs:
        for level, text in heads:
            size = HEADS.get(level, OTHER_HEAD)
            p.y -= size * MM_PER_PT * 0.5
            p.line(text, size, "F2")
            p.y -= 2
        for text in paragraphs:
            for line in wrap(text):
                p.line(line, BODY, "F1")
            p.y -= 2
    images = []
    for data in pictures:
        try:
            w, h, body = _image(data)
        except (ValueError, KeyError, StopIteration, zlib.error, struct.error):
            continue
        images.append(body)
        p.picture(f"I{len(images)}", w, h)
    n_fonts, n_pages = len(_FONTS), len(p.pages)
    first_image, first_page = 3 + n_fonts, 3 + n_fonts + len(images)
    fonts = " ".join(f"/{k} {3 + i} 0 R" for i, k in enumerate(_FONTS))
    xobjects = " ".join(f"/I{i + 1} {first_image + i} 0 R" for i in range(len(images)))
    kids = " ".join(f"{first_page + 2 * i} 0 R" for i in range(n_pages))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n_pages} >>".encode()]
    objects += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{f} /Encoding /WinAnsiEncoding >>".encode() for f in _FONTS.values()]
    objects += images
    box = f"[0 0 {PAGE_W * PT:.2f} {PAGE_H * PT:.2f}]"
    for i, ops in enumerate(p.pages):
        stream = zlib.compress("\n".join(ops).encode("latin-1"))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox {box} /Resources << /Font << {fonts} >> /XObject << {xobjects} >> >> /Contents {first_page + 2 * i + 1} 0 R >>".encode())
        objects.append(f"<< /Filter /FlateDecode /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream")
    objects.append(b"<< /Title <" + b"\xfe\xff".hex().encode() + title.encode("utf-16-be").hex().encode() + b"> >>")
    out = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
    places = []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{x:010} 00000 n \n".encode() for x in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R /Info {len(objects)} 0 R >>\nstartxref\n{at}\n%%EOF\n".encode()
    return bytes(out)


