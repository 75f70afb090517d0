"""Byte-level BPE encoding and decoding (operator 5).

Method: the words of a chunk are laid out as rows of padded matrices, one matrix for each
length bucket. Every round, each row merges its leftmost pair of minimum rank; ranks come
from an open-addressing hash table of pairs, and rows without a mergeable pair leave the
matrix (compaction). Results are those of the tiktoken library.

Rows of over ``SHORT`` bytes merge in one round all places of their minimum rank, from the left
up to the first whose new neighbours make a pair of a lower rank: what one merge at a time
would give, in fewer rounds. So a very long piece takes about as many rounds as it has ranks,
not as it has merges.

Defined cases: a null or empty text has no tokens and decodes to no bytes; a piece that is
itself a token is that token; a piece of any length is a row; repeated rows give equal results; an empty table
gives an empty table; columns other than the id and the text are not touched.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import regex
from pyspark.sql import DataFrame

from ._cache import Memo
from ._spark import map_texts

#: Rows of more bytes than this merge all places of a rank in one round.
SHORT = 128
#: Cells of a matrix, or one longer row.
CELLS = 1 << 20
#: Words whose ids a worker remembers (twice as many at most, and those of two chunks).
CACHE_WORDS = 200_000

_INF = np.int32(2**31 - 1)
_BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, SHORT)


class PairTable:
    """(left id, right id) -> rank, looked up for whole arrays at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = left.astype(np.int64) << 32 | right
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, _INF, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = (self._hash(keys[todo]) + step) & (len(self.keys) - 1)
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.vals[slot[won]] = keys[todo[won]], rank[todo[won]]
            todo, step = np.delete(todo, won), step + 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks; pairs without one, and pairs with an id below 0, get the largest int."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._hash(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.vals[slot], _INF)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0) & (keys >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        token = [b""] * size
        for t, r in self.ranks.items():
            token[r] = t
        self.token_len = np.array([len(t) for t in token], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        # a merge joins any two tokens whose bytes together are a token
        left, right, rank = [], [], []
        get = self.ranks.get
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = get(t[:i]), get(t[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.cache = Memo(lambda w: self.encode_words([w.encode()])[0], CACHE_WORDS)

    def _matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of each word of at most ``width`` bytes."""
        n = len(words)
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[flat], np.int32(-1))
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        row = np.arange(n)
        while len(row):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            here = np.arange(len(row))
            best = rank[here, at] if rank.shape[1] else np.full(len(row), _INF)
            done = best == _INF
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[row[i]] = ids[i, : size[i]]
                live = ~done
                row, ids, rank, size, at, best = row[live], ids[live], rank[live], size[live], at[live], best[live]
                here = np.arange(len(row))
                if not len(row):
                    break
            cols = np.arange(ids.shape[1] - 1)
            ids[here, at] = best
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            size = size - 1
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            if rank.shape[1]:
                for k in (at - 1, at):
                    ok = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                    rank[ok, k[ok]] = self.pairs.get(ids[ok, k[ok]], ids[ok, k[ok] + 1])
        return out

    def _wide(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """As ``_matrix``, with all places of a row's minimum rank merged in a round."""
        n = len(words)
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        at = np.arange(width, dtype=np.int32)
        ids = np.where(at < size[:, None], self.of_byte[flat], np.int32(-1))
        rank = np.full((n, width), _INF)
        rank[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        row = np.arange(n)
        while True:
            best = rank.min(1)
            for i in np.flatnonzero(best == _INF).tolist():
                out[row[i]] = ids[i, : size[i]]
            live = best < _INF
            if not live.any():
                return out
            row, ids, rank, size, best = row[live], ids[live], rank[live], size[live], best[live]
            hit = rank == best[:, None]
            # of places in a row the first, third, ... merge: they do not overlap
            since = at - np.maximum.accumulate(np.where(hit, np.int32(-1), at), axis=1)
            take = hit & (since & 1 == 1)
            # the pairs that each merge makes, with what stands left and right of it at its turn
            r, c = np.nonzero(take)
            token, none = best[r], np.int32(-1)
            left = np.where(c > 0, np.where((c > 1) & take[r, c - 2], token, ids[r, c - 1]), none)
            right = np.where(c + 2 < len(at), ids[r, np.minimum(c + 2, len(at) - 1)], none)
            lower = np.minimum(self.pairs.get(left, token), self.pairs.get(token, right)) < token
            if lower.any():
                stop = np.full(len(row), len(at), np.int64)
                np.minimum.at(stop, r[lower], c[lower])
                take &= at <= stop[:, None]
            ids[take] = np.broadcast_to(best[:, None], ids.shape)[take]
            keep = at < size[:, None]
            keep[:, 1:] &= ~take[:, :-1]
            # compaction: rows move together and the matrix narrows to the longest
            size = keep.sum(1)
            at = at[: size.max()]
            place = at < size[:, None]
            new = np.full(place.shape, -1, np.int32), np.full(place.shape, _INF), np.zeros(place.shape, bool)
            for to, old in zip(new, (ids, rank, take)):
                to[place] = old[keep]
            ids, rank, changed = new
            changed[:, :-1] |= changed[:, 1:].copy()
            r, c = np.nonzero(changed)
            after = np.where(c + 1 < len(at), ids[r, np.minimum(c + 1, len(at) - 1)], np.int32(-1))
            rank[r, c] = self.pairs.get(ids[r, c], after)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif w:
                width = next(b for b in _BUCKETS if len(w) <= b) if len(w) <= SHORT else 1 << (len(w) - 1).bit_length()
                buckets.setdefault(width, []).append(i)
        for width, rows in buckets.items():
            merge, most = (self._matrix, 8192) if width <= SHORT else (self._wide, max(1, CELLS // width))
            for k in range(0, len(rows), most):
                part = rows[k : k + most]
                longest = width if width <= SHORT else max(len(words[j]) for j in part)
                for i, ids in zip(part, merge([words[j] for j in part], longest)):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        found = [self.find(t) if t else [] for t in texts]
        memo = self.cache
        memo.fill(set().union(*found), lambda new: self.encode_words([w.encode() for w in new]))
        return [b"".join(map(memo.__getitem__, words)) for words in found]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that are little-endian unsigned 32-bit integers."""
        t = np.frombuffer(ids, "<u4")
        size = self.token_len[t]
        ends = np.cumsum(size)
        if not len(t):
            return b""
        where = np.repeat(self.token_at[t] - (ends - size), size) + np.arange(ends[-1])
        return self.token_bytes[where].tobytes()


_models: dict[tuple[str, str], ByteBPE] = {}


def model(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of a worker; read once."""
    if (path, pattern) not in _models:
        _models[path, pattern] = ByteBPE(path, pattern)
    return _models[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit) and
    ``decoded`` binary (the bytes decoded from ``ids``), a row for each row of ``df``."""

    def make():
        bpe = model(path, pattern)

        def run(texts):
            return [(len(i) // 4, i, bpe.decode(i)) for i in bpe.encode(texts)]

        return run

    return map_texts(df, [id_col], text_col, "n_tokens long, ids binary, decoded binary", make)


def encode_digest(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_column``, with lowercase hex SHA-256 in place of the bytes:
    ``ids_sha256`` and ``decoded_sha256``. The hashes are taken in the kernel, so that
    ids and decoded bytes never travel back to the JVM."""

    def make():
        bpe = model(path, pattern)
        sha = hashlib.sha256

        def run(texts):
            return [(len(i) // 4, sha(i).hexdigest(), sha(bpe.decode(i)).hexdigest()) for i in bpe.encode(texts)]

        return run

    return map_texts(df, [id_col], text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
