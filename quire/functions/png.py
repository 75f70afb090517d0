"""PNG pixels with zlib and numpy alone: decoding, Lanczos resampling, encoding."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour type -> samples for a pixel.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def size(data: bytes) -> tuple[int, int]:
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack_from(">II", data, 16)


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            done = line
        elif kind == 2:
            done = line + above
        elif kind == 1:
            pad = -stride % step
            wide = np.concatenate([line, np.zeros(pad, np.uint8)]).reshape(-1, step)
            done = np.cumsum(wide, axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind in (3, 4):
            now, up = bytearray(stride), above.tobytes()
            for x, v in enumerate(line.tobytes()):
                a = now[x - step] if x >= step else 0
                b = up[x]
                if kind == 3:
                    guess = a + b >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[x] = v + guess & 255
            done = np.frombuffer(bytes(now), np.uint8)
        else:
            raise ValueError(f"filter {kind}")
        out[y] = above = done
    return out


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, samples) of an 8-bit PNG without interlacing; palettes become RGB."""
    width, height = size(data)
    depth, colour, _, _, interlaced = struct.unpack_from(">BBBBB", data, 24)
    if depth != 8 or interlaced or colour not in _CHANNELS:
        raise ValueError("only 8-bit PNGs without interlacing are read")
    parts = list(_chunks(data))
    n = _CHANNELS[colour]
    raw = zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"))
    pixels = _unfilter(raw, height, width * n, n).reshape(height, width, n)
    if colour == 3:
        palette = np.frombuffer(next(body for kind, body in parts if kind == b"PLTE"), np.uint8).reshape(-1, 3)
        pixels = palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
    return pixels


def encode(pixels: np.ndarray) -> bytes:
    height, width, n = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * n)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _weights(old: int, new: int) -> np.ndarray:
    """The matrix (new, old) of a Lanczos filter of three lobes, widened when it shrinks."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    x = (np.arange(old)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w, _ = pixels.shape
    tall = np.tensordot(_weights(h, height), pixels.astype(np.float64), (1, 0))
    both = np.einsum("nw,hwc->hnc", _weights(w, width), tall)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def fit(width: int, height: int, most: tuple[int, int]) -> tuple[int, int]:
    scale = min(most[0] / width, most[1] / height)
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))


def shrink(data: bytes, media_type: str, most: tuple[int, int]) -> tuple[bytes, str]:
    """A picture within ``most`` and what was done: ``fits``, ``resized``, or ``kept`` where it
    cannot be decoded here (no JPEG codec is at hand)."""
    if media_type != "image/png":
        return data, "kept"
    try:
        w, h = size(data)
        if w <= most[0] and h <= most[1]:
            return data, "fits"
        return encode(resize(decode(data), *fit(w, h, most))), "resized"
    except (ValueError, KeyError, StopIteration, zlib.error, struct.error):
        return data, "kept"
