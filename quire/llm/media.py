"""Media columns (operator 1): signature sniffing.

Method: an Aho-Corasick automaton finds the magic bytes of all formats in one pass. At each
find a format validator walks the structure (chunks, blocks, boxes, frames, checksums) and gives
the end that the object really has, or refuses. What is confirmed at offset 0 corrects the
declared type; what is confirmed further on is carved out as embedded media.

Time: finds inside what is carved already are not walked. A step of a structure is taken once,
however many finds lead to it, and closing records are searched once and looked up, so magic
bytes that repeat cost no more than their number. Only stretches that a RIFF, gzip or FLAC find
claims and that then prove broken are read once for each such find.

Defined cases: null or empty bytes have no type, keep the declared one and hold no embedded
media; a magic number whose structure does not hold counts for nothing; of finds that overlap
the leftmost stays, at one place the longest; repeated rows give equal results; an empty table
gives an empty table; columns other than those named are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import chunks, map_texts, small_batches

PAD = 64
_WAV_HEAD = 44
_WAV_RATE = 8000


_TRAILER = re.compile(rb"startxref\s{1,99}(\d{1,18})\s{1,99}%%EOF")
_XREF = re.compile(rb"(?<!start)xref|(?<![0-9])\d{1,10} \d{1,5} obj")


class Bytes:
    """A buffer with what validators have learned of it, so that magic bytes that repeat do not
    walk or search the same stretch again."""

    def __init__(self, data: bytes):
        self.d = data
        self._walked: dict[Callable, dict[int, int | None]] = {}

    def walk(self, step: Callable[[bytes, int], int | None], state: int) -> int | None:
        """Follow ``step`` from ``state`` to the end that it finds. A step gives the next state, the
        end as its complement (below 0), or None where the structure breaks; it is taken once
        from each state, whatever the number of walks that pass there."""
        known, path = self._walked.setdefault(step, {}), []
        while state not in known:
            path.append(state)
            to = step(self.d, state)
            if to is None or to < 0:
                known[state] = None if to is None else ~to
            else:
                state = to
        end = known[state]
        known.update(dict.fromkeys(path, end))
        return end

    @functools.cached_property
    def zip_ends(self) -> dict[int, int]:
        """Start -> end of the archives whose closing record points back to that start."""
        out: dict[int, int] = {}
        d, p = self.d, self.d.find(b"PK\5\6")
        while p >= 0 and p + 22 <= len(d):
            size, offset, note = struct.unpack_from("<IIH", d, p + 12)
            if 0 <= p - size - offset and d[p - size : p - size + 4] == b"PK\1\2" and p + 22 + note <= len(d):
                out.setdefault(p - size - offset, p + 22 + note)
            p = d.find(b"PK\5\6", p + 1)
        return out

    @functools.cached_property
    def pdf_trailers(self) -> tuple[list[int], list[int], list[int], list[int], dict[int, int]]:
        """Of all trailers: places, offsets that they name, ends; the places of what a trailer can
        name; and for each start of a file the last end of its revisions: those whose offset,
        counted from there, is the cross reference right before the trailer."""
        places, offsets, ends, last = [], [], [], {}
        targets = [m.start() for m in _XREF.finditer(self.d)]
        for m in _TRAILER.finditer(self.d):
            places.append(m.start()), offsets.append(int(m[1])), ends.append(m.end())
            k = bisect_left(targets, m.start())
            if k:
                # the nearest table or stream; an object in a table's trailer does not count
                last[targets[k - 1] - offsets[-1]] = m.end()
        return places, offsets, ends, targets, last


def _png_chunk(d: bytes, p: int) -> int | None:
    if p + 12 > len(d):
        return None
    size, kind = struct.unpack_from(">I4s", d, p)
    if p + 12 + size > len(d) or zlib.crc32(memoryview(d)[p + 4 : p + 8 + size]) != struct.unpack_from(">I", d, p + 8 + size)[0]:
        return None
    return ~(p + 12 + size) if kind == b"IEND" else p + 12 + size


def _png(b: Bytes, at: int) -> int | None:
    return b.walk(_png_chunk, at + 8) if b.d[at + 8 : at + 16] == b"\0\0\0\x0dIHDR" else None


def _jpeg_segment(d: bytes, state: int) -> int | None:
    """State: twice the place, and 1 after a scan."""
    p, scan = state >> 1, state & 1
    if p + 2 > len(d) or d[p] != 0xFF:
        return None
    m = d[p + 1]
    if m == 0xFF:
        return state + 2
    if m == 0xD9:
        return ~(p + 2) if scan else None
    if m in (0x00, 0x01) or 0xD0 <= m <= 0xD8 or p + 4 > len(d):
        return None
    size = struct.unpack_from(">H", d, p + 2)[0]
    if size < 2 or p + 2 + size > len(d):
        return None
    p += 2 + size
    while m == 0xDA:  # entropy-coded data: FF is followed by 00 or a restart marker
        p = d.find(b"\xff", p)
        if p < 0 or p + 1 >= len(d):
            return None
        if d[p + 1] and not 0xD0 <= d[p + 1] <= 0xD7:
            break
        p += 2
    return 2 * p + (scan or m == 0xDA)


def _jpeg(b: Bytes, at: int) -> int | None:
    return b.walk(_jpeg_segment, 2 * (at + 2))


def _gif_block(d: bytes, state: int) -> int | None:
    """State: twice the place, and 1 after an image."""
    p, images = state >> 1, state & 1
    if p >= len(d):
        return None
    if d[p] == 0x3B:
        return ~(p + 1) if images else None
    if d[p] == 0x2C and p + 10 <= len(d):
        flags, images = d[p + 9], 1
        p += 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1
    elif d[p] == 0x21:
        p += 2
    else:
        return None
    while p < len(d) and d[p]:
        p += 1 + d[p]
    return 2 * (p + 1) + images


def _gif(b: Bytes, at: int) -> int | None:
    if at + 13 > len(b.d):
        return None
    return b.walk(_gif_block, 2 * (at + 13 + (3 << ((b.d[at + 10] & 7) + 1) if b.d[at + 10] & 0x80 else 0)))


def _bmp(b: Bytes, at: int) -> int | None:
    if at + 30 > len(b.d):
        return None
    size, r1, r2, offset, head, _, _, planes, bits = struct.unpack_from("<IHHIIiiHH", b.d, at + 2)
    fine = head in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if fine and not r1 and not r2 and 26 <= offset <= size <= len(b.d) - at else None


def _riff(form: bytes) -> Callable[[Bytes, int], int | None]:
    def check(b: Bytes, at: int) -> int | None:
        d = b.d
        if at + 12 > len(d) or d[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
        if end > len(d):
            return None
        p = at + 12
        while p + 8 <= end:
            p += 8 + struct.unpack_from("<I", d, p + 4)[0]
            p += (p - at) & 1
        return end if p in (end, end + 1) and end > at + 12 else None

    return check


def _pdf(b: Bytes, at: int) -> int | None:
    """The end of the last revision: the last trailer whose offset, counted from here, is its
    cross reference. The first trailer of a linearised file names 0, its last one the first
    cross reference of the file."""
    if not b.d[at + 5 : at + 6].isdigit():
        return None
    places, offsets, ends, targets, last = b.pdf_trailers
    end = last.get(at)
    k = bisect_left(places, at)
    if end is None and k < len(places) and offsets[k] == 0:
        end = ends[k]
        first = bisect_left(targets, at)
        if first < len(targets) and k + 1 < len(places) and offsets[k + 1] == targets[first] - at:
            end = ends[k + 1]
    if end is None:
        return None
    # line end after the mark belongs to the file
    return end


def _zip(b: Bytes, at: int) -> int | None:
    return b.zip_ends.get(at)


def _gzip(b: Bytes, at: int) -> int | None:
    d, z = b.d, zlib.decompressobj(31)
    try:
        p = at
        while p < len(d) and not z.eof:
            z.decompress(d[p : p + 65536], 1 << 16)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 16)
            p += 65536
        return min(p, len(d)) - len(z.unused_data) if z.eof else None
    except zlib.error:
        return None


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_crc(page: bytes) -> int:
    """The page checksum: the common CRC with all bits the other way round, from 0."""
    got = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{got:032b}"[::-1], 2)


def _ogg_page(d: bytes, p: int) -> int | None:
    if p + 27 > len(d) or d[p : p + 5] != b"OggS\0":
        return ~p
    n = d[p + 26]
    end = p + 27 + n + sum(d[p + 27 : p + 27 + n])
    if end > len(d) or _ogg_crc(d[p : p + 22] + bytes(4) + d[p + 26 : end]) != struct.unpack_from("<I", d, p + 22)[0]:
        return ~p
    return ~end if d[p + 5] & 4 else end


def _ogg(b: Bytes, at: int) -> int | None:
    """From a first page to its last one, or as far as pages are whole."""
    if at + 27 > len(b.d) or not b.d[at + 5] & 2:
        return None
    end = b.walk(_ogg_page, at)
    return end if end > at else None


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(d: bytes, p: int) -> tuple[int, int] | None:
    """Samples of the frame whose header stands at ``p``, and the header's end."""
    if p + 6 > len(d) or d[p] != 0xFF or d[p + 1] & 0xFE != 0xF8 or d[p + 2] >> 4 == 0 or d[p + 2] & 15 == 15 or d[p + 3] & 1:
        return None
    code, rate = d[p + 2] >> 4, d[p + 2] & 15
    lead = d[p + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    q = p + 5 + more
    size = {1: 192}.get(code) or (576 << (code - 2) if code <= 5 else 256 << (code - 8) if code >= 8 else 0)
    if code in (6, 7):
        size = int.from_bytes(d[q : q + code - 5], "big") + 1
        q += code - 5
    q += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if q >= len(d):
        return None
    crc = 0
    for x in d[p:q]:
        crc = _CRC8[crc ^ x]
    return (size, q + 1) if crc == d[q] else None


def _flac_block(d: bytes, p: int) -> int | None:
    if p + 4 > len(d):
        return None
    head = struct.unpack_from(">I", d, p)[0]
    end = p + 4 + (head & 0xFFFFFF)
    return None if end > len(d) else ~end if head >> 31 else end


def _flac(b: Bytes, at: int) -> int | None:
    """The metadata, then frames: each ends where its checksum does and either another frame
    begins or the stream has all the samples that its head counts. No head count (0): as many
    frames as follow each other."""
    d = b.d
    if d[at + 4 : at + 8] not in (b"\0\0\0\x22", b"\x80\0\0\x22") or at + 42 > len(d):
        return None
    least = int.from_bytes(d[at + 12 : at + 15], "big")
    total = int.from_bytes(d[at + 21 : at + 26], "big") & ((1 << 36) - 1)
    p = b.walk(_flac_block, at + 4)
    seen, table = 0, _CRC16
    while p is not None:
        got = _flac_frame(d, p)
        if got is None:
            return p if seen and not total else None
        seen += got[0]
        crc, end = 0, None
        for q in range(p, len(d)):
            crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ d[q]]
            if crc == 0 and q + 1 - p >= max(least, got[1] - p + 3) and ((total and seen >= total) or (q + 1 == len(d) and not total) or _flac_frame(d, q + 1)):
                end = q + 1
                break
        if end is None:
            return None
        if (total and seen >= total) or end == len(d):
            return end
        p = end
    return None


def _mp4_box(d: bytes, state: int) -> int | None:
    """State: four times the place, 1 after ftyp, 2 after moov."""
    p = state >> 2
    size, kind = struct.unpack_from(">I4s", d, p) if p + 8 <= len(d) else (0, b"")
    if size < 8 or p + size > len(d) or not kind.isalnum():
        return ~p if state & 3 == 3 else None
    return 4 * (p + size) | state & 3 | {b"ftyp": 1, b"moov": 2}.get(kind, 0)


def _mp4(b: Bytes, at: int) -> int | None:
    return b.walk(_mp4_box, 4 * (at - 4)) if at >= 4 else None


def _pnm(b: Bytes, at: int) -> int | None:
    m = _PNM.match(b.d, at)
    if not m:
        return None
    w, h, most = map(int, m.groups())
    end = m.end() + w * h * (1 if b.d[at + 1] == 0x35 else 3) * (2 if most > 255 else 1)
    return end if w and h and 0 < most < 65536 and end <= len(b.d) else None


_PNM = re.compile(rb"P[56]\s{1,99}(\d{1,9})\s{1,99}(\d{1,9})\s{1,99}(\d{1,9})\s")

#: Kilobits a second by version (1; 2 and 2.5), layer and index; hertz by version and index.
_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _mpeg_frame(d: bytes, p: int) -> int | None:
    """A frame's length follows from its header; a closing tag of 128 bytes belongs to the file."""
    version, layer = (d[p + 1] >> 3 & 3, 4 - (d[p + 1] >> 1 & 3)) if p + 4 <= len(d) else (1, 4)
    if p + 4 > len(d) or d[p] != 0xFF or d[p + 1] & 0xE0 != 0xE0 or version == 1 or layer == 4 or d[p + 2] >> 4 in (0, 15) or d[p + 2] >> 2 & 3 == 3:
        return ~(p + 128) if d[p : p + 3] == b"TAG" and p + 128 <= len(d) else ~p
    rate = 1000 * _RATES[1 if version == 3 else 2, layer][(d[p + 2] >> 4) - 1]
    hertz, padding = _HERTZ[version][d[p + 2] >> 2 & 3], d[p + 2] >> 1 & 1
    if layer == 1:
        size = (12 * rate // hertz + padding) * 4
    else:
        size = (144 if layer == 2 or version == 3 else 72) * rate // hertz + padding
    return ~p if p + size > len(d) else p + size


def _id3(b: Bytes, at: int) -> int | None:
    """The tag and the whole frames after it."""
    d = b.d
    if at + 10 > len(d) or d[at + 3] not in (2, 3, 4) or max(d[at + 6 : at + 10]) > 127:
        return None
    s, t, u, v = d[at + 6 : at + 10]
    p = at + 10 + (s << 21 | t << 14 | u << 7 | v)
    end = b.walk(_mpeg_frame, p) if p < len(d) else p
    return end if end > p else None


#: Magic bytes, type, validator, and how far the magic stands from the object's start.
SIGNATURES: list[tuple[bytes, str, Callable[[Bytes, int], int | None], int]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png, 0),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg, 0),
    (b"GIF87a", "image/gif", _gif, 0),
    (b"GIF89a", "image/gif", _gif, 0),
    (b"BM", "image/bmp", _bmp, 0),
    (b"RIFF", "image/webp", _riff(b"WEBP"), 0),
    (b"RIFF", "audio/wav", _riff(b"WAVE"), 0),
    (b"RIFF", "video/x-msvideo", _riff(b"AVI "), 0),
    (b"%PDF-", "application/pdf", _pdf, 0),
    (b"PK\3\4", "application/zip", _zip, 0),
    (b"\x1f\x8b\x08", "application/gzip", _gzip, 0),
    (b"OggS", "audio/ogg", _ogg, 0),
    (b"fLaC", "audio/flac", _flac, 0),
    (b"ftyp", "video/mp4", _mp4, 4),
    (b"P5", "image/x-portable-graymap", _pnm, 0),
    (b"P6", "image/x-portable-pixmap", _pnm, 0),
    (b"ID3", "audio/mpeg", _id3, 0),
]

_automata: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _automata:
        a = ahocorasick.Automaton()
        by_magic: dict[bytes, list[int]] = {}
        for i, s in enumerate(SIGNATURES):
            by_magic.setdefault(s[0], []).append(i)
        for magic, ids in by_magic.items():
            a.add_word(magic.decode("latin-1"), (len(magic), ids))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def sniff(data: bytes | None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The confirmed type at offset 0 (or None), and the embedded objects as (type, start, length)."""
    if not data:
        return None, []
    buffer = Bytes(data)
    places = []
    for end, (size, ids) in _automaton().iter(data.decode("latin-1")):
        places += [(end - size + 1 - SIGNATURES[i][3], i, end - size + 1) for i in ids]
    places.sort()
    whole, inside, free = None, [], 1
    best = None  # the longest of the place at hand
    for k, (start, i, at) in enumerate(places):
        if start == 0 or start >= free:
            end = SIGNATURES[i][2](buffer, at)
            if end is not None and (best is None or end > best[0]):
                best = (end, SIGNATURES[i][1])
        if best and (k + 1 == len(places) or places[k + 1][0] != start):
            if start:
                inside.append((best[1], start, best[0] - start))
                free = best[0]
            else:
                whole = best[1]
            best = None
    return whole, inside


def sniff_column(df: DataFrame, *, id_col: str, data_col: str, declared_col: str) -> DataFrame:
    """``id_col``, ``sniffed`` (null: nothing confirmed), ``media_type`` (the declared type,
    corrected where the sniffed one differs), ``corrected`` boolean and ``embedded``
    array<struct<media_type, start, length, data>>. Batches both ways are bounded by bytes."""
    small_batches(df.sparkSession)
    one = df.select(F.col(id_col).alias("i"), F.col(declared_col).alias("m"), F.col(data_col).cast("binary").alias("d"))
    embedded = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))
    names = [id_col, "sniffed", "media_type", "corrected", "embedded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks([x or 0 for x in pa.compute.binary_length(batch.column(2)).to_pylist()]):
                rows = []
                for declared, data in zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in (1, 2))):
                    kind, inside = sniff(data)
                    cut = [{"media_type": k, "start": at, "length": n, "data": data[at : at + n]} for k, at, n in inside]
                    rows.append((kind, kind or declared, kind is not None and kind != declared, cut))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_(), embedded))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    kind = one.schema["i"].dataType.simpleString()
    return one.mapInArrow(run, f"`{id_col}` {kind}, sniffed string, media_type string, corrected boolean, embedded array<struct<media_type:string,start:bigint,length:bigint,data:binary>>")


def to_wav(payload: bytes) -> bytes:
    """``payload`` as the samples of an 8-bit mono WAV file; its length must be even."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, 1, _WAV_RATE, _WAV_RATE, 1, 8, b"data", n)
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV file, found by its chunks."""
    p = 12
    while media[p : p + 4] != b"data":
        size = struct.unpack_from("<I", media, p + 4)[0]
        p += 8 + size + (size & 1)
    size = struct.unpack_from("<I", media, p + 4)[0]
    return media[p + 8 : p + 8 + size]


def text_payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes filled up with 0 to a positive multiple of ``PAD``."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % PAD or (0 if raw else PAD))


def media_digest(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a WAV column, sniffed (declared: application/octet-stream), read
    back by its confirmed structure and measured.

    Columns: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (type, whether it corrected the declared one, samples, their mean and mean
    square, embedded objects as type:start:length).
    """

    def one(text):
        n, payload = text_payload(text)
        media = to_wav(payload)
        kind, inside = sniff(media)
        if kind != "audio/wav":
            raise ValueError(f"the stored form is not confirmed: {kind}")
        back = samples(media)
        x = np.frombuffer(back, np.uint8)
        total, square = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.float64), x))
        marks = ",".join(f"{k}:{a}:{m}" for k, a, m in inside)
        feature = f"type={kind};corrected=true;samples={len(x)};mean={total / len(x):.4f};square={square / len(x):.4f};embedded={marks}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(df, [id_col], text_col, schema, lambda: lambda texts: [one(t) for t in texts])
