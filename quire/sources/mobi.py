"""MOBI books: the record file, its text (plain or PalmDOC) and pictures, and their clean-up."""

from __future__ import annotations

import re
import struct

from . import book as B

#: Primary language number of a locale -> code; others count as English.
LANGUAGES = {
    1: "ar", 4: "zh", 5: "cs", 6: "da", 7: "de", 9: "en", 10: "es", 11: "fi", 12: "fr", 16: "it", 17: "ja", 18: "ko", 19: "nl", 20: "no",
    21: "pl", 22: "pt", 25: "ru", 29: "sv", 31: "tr", 57: "hi",
}
#: EXTH record type -> metadata term.
EXTH_TERMS = {101: "publisher", 103: "description", 104: "identifier", 105: "subject", 106: "date", 503: "title"}
_PICTURE = (b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"BM", b"RIFF")
_CLEAN = (
    (r"(?is)<head[^>]*>.*?</head>", ""),
    (r"""\s*filepos\s*=\s*["']?\d+["']?""", ""),
    (r"(?i)<mbp:pagebreak\s*/?>", '<div class="mbp_pagebreak"></div>'),
    (r"(?i)</?mbp:[^>]+>", ""),
    (r"(?is)<guide[^>]*>.*?</guide>", ""),
    (r"<a\s+[^>]*>\s*</a>", ""),
)


def unpack_palmdoc(data: bytes) -> bytes:
    """One record of PalmDOC's LZ77."""
    out = bytearray()
    k = 0
    while k < len(data):
        c = data[k]
        k += 1
        if c == 0 or 9 <= c < 128:
            out.append(c)
        elif c < 9:
            out += data[k : k + c]
            k += c
        elif c >= 192:
            out += bytes((32, c ^ 128))
        else:
            if k >= len(data):
                break
            pair = (c << 8 | data[k]) & 0x3FFF
            k += 1
            back, n = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("a reference before the record's start")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def _strip_trailers(record: bytes, flags: int) -> bytes:
    """A text record without the extra entries that its end holds."""
    for bit in range(15, 0, -1):
        if flags >> bit & 1 and record:
            size = 0
            for k, byte in enumerate(reversed(record[-4:])):
                size |= (byte & 127) << 7 * k
                if byte & 128:
                    break
            record = record[: max(0, len(record) - size)]
    if flags & 1 and record:
        record = record[: len(record) - (record[-1] & 3) - 1]
    return record


def clean_html(html: str) -> str:
    body = re.search(r"(?is)<body[^>]*>(.*)</body>", html)
    out = body[1] if body else re.sub(r"(?i)</?html[^>]*>", "", html)
    for pattern, by in _CLEAN:
        out = re.sub(pattern, by, out)
    return out


def link_pictures(html: str, hrefs: dict[int, str]) -> str:
    """Pictures named by number get their addresses; numbers out of range stay."""
    known = lambda m: f'<img src="{hrefs[int(m[1])]}"/>' if int(m[1]) in hrefs else m[0]
    return re.sub(r"""<img\s[^>]*recindex\s*=\s*["']?(\d+)["']?[^>]*>""", known, html)


def read_mobi(data: bytes, stem: str) -> dict:
    n = struct.unpack_from(">H", data, 76)[0]
    starts = [struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(n)] + [len(data)]
    records = [data[a:b] for a, b in zip(starts, starts[1:])]
    head = records[0]
    packing, _, length, n_text = struct.unpack_from(">HHIH", head, 0)
    locked = struct.unpack_from(">H", head, 12)[0]
    if locked or packing not in (1, 2):
        raise ValueError("encrypted" if locked else f"compression {packing} is not supported")
    terms = B.Terms()
    title, code, flags, first_picture = stem, "cp1252", 0, None
    if head[16:20] == b"MOBI":
        size, _, page = struct.unpack_from(">III", head, 20)
        code = "utf-8" if page == 65001 else "cp1252"
        name_at, name_n, locale = struct.unpack_from(">III", head, 84)
        title = head[name_at : name_at + name_n].decode(code, "replace") or stem
        first_picture = struct.unpack_from(">I", head, 108)[0]
        if size >= 228 and len(head) >= 244:
            flags = struct.unpack_from(">H", head, 242)[0]
        terms.put("language", LANGUAGES.get(locale & 255, "en"))
        at = 16 + size
        if struct.unpack_from(">I", head, 128)[0] & 0x40 and head[at : at + 4] == b"EXTH":
            count, at = struct.unpack_from(">I", head, at + 8)[0], at + 12
            for _ in range(count):
                kind, n_bytes = struct.unpack_from(">II", head, at)
                value = head[at + 8 : at + n_bytes].decode(code, "replace")
                at += max(8, n_bytes)
                if kind == 100:
                    for author in re.split("[;&]", value):
                        terms.add("creator", author)
                elif kind in EXTH_TERMS and terms.get(EXTH_TERMS[kind]) is None:
                    terms.put(EXTH_TERMS[kind], value)
    if terms.get("title") is None:
        terms.put("title", title)
    unpack = unpack_palmdoc if packing == 2 else bytes
    body = b"".join(unpack(_strip_trailers(r, flags)) for r in records[1 : 1 + n_text])[:length].decode(code, "replace")
    pictures, hrefs = [], {}
    start = first_picture if first_picture and first_picture < n else n
    for k, record in enumerate(records[start:], 1):
        if record.startswith(_PICTURE):
            hrefs[k] = f"images/image_{k:04}.{B.sniff(record)}"
            pictures.append((f"img_{k}", hrefs[k], record))
    return B.single(stem, terms.rows, clean_html(link_pictures(body, hrefs)), pictures)
