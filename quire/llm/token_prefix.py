"""Token counts (operator 6): exact at every prefix, by dynamic programming.

Method: a sequence of BPE tokens is what the tokenizer makes of their text exactly when each
two neighbours are (a pair is right if merging their joined characters gives the two back).
So the last token of every prefix of a word follows from those of shorter prefixes, and its
count is one more than the count at the token's start. A text keeps one signed byte for each
character: the change of the exact count when the prefix grows by that character. Their sums
answer counts, budgets and truncations without encoding anything again.

Prefixes are those of the *normalised* text (NFC, lower case; the runs of white space keep
their length, they hold no tokens). Special tokens of the vocabulary in a text count as the
library counts them by default: one token for the whole string.

Defined cases: a null or empty text, or one of white space only, has no tokens; repeated rows
give equal results; an empty table gives an empty table; columns other than the id and the
text are not touched.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame

from ._cache import Memo
from ._spark import map_texts

#: Words whose counts a worker remembers (twice as many at most).
CACHE_WORDS = 200_000


def _byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _lower(text: str) -> str:
    """Lower case letter by letter (no rule for a final sigma)."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class PrefixCounter:
    """Prefix counts of a word-end BPE of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.parts = {a + b: (a, b) for a, b in reversed(pairs)}
        #: every beginning of a token; 1 is added if it is one itself, 2 if it is one at a word's end
        last_part = {t[: -len(self.end)] for t in self.vocab if t.endswith(self.end)}
        whole = {t for t in self.vocab if not t.endswith(self.end)}
        self.starts = {t[:k]: 0 for t in last_part | whole for k in range(1, len(t) + 1)}
        self.starts = {t: (t in whole) + 2 * (t in last_part) for t in self.starts}
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        words = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        # white space as a last choice: the matches then cover the whole text
        self.tiles = regex.compile(words + r"|\s+").findall
        self.space = regex.compile(r"\s").match
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.chars = _byte_chars()
        #: for a token, the tokens after it that are known to fit or not: within a word, and at its end
        self.right: dict[str, tuple[dict[str, bool], dict[str, bool]]] = {}
        self.known = 0
        self.cache = Memo(self._deltas, CACHE_WORDS)

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The pieces that stand at one end of ``token`` while it is merged together (side 1:
        its right end), each with the rank of the merge that swallows it."""
        chain: list[tuple[str, float]] = [(token, float("inf"))]
        while (pair := self.parts.get(chain[-1][0])) is not None:
            chain.append((pair[side], self.rank[pair]))
        return chain[::-1]

    def _fits(self, a: str, b: str) -> bool:
        """Whether the tokenizer leaves ``a`` and ``b`` side by side as they are: no pair of
        pieces that meet at the border merges before one of them is swallowed. At equal
        ranks the pair further left is first."""
        xs = self.edges.get((a, 1)) or self.edges.setdefault((a, 1), self._edge(a, 1))
        ys = self.edges.get((b, 0)) or self.edges.setdefault((b, 0), self._edge(b, 0))
        i = j = 0
        fits = True
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_ends and r <= y_ends:
                fits = False
                break
            if i == len(xs) - 1 and j == len(ys) - 1:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        self.known += 1
        if self.known > 500_000:
            self.right.clear()
            self.known = 0
        return fits

    def word_counts(self, word: str) -> list[int]:
        """Exact token counts of the prefixes of ``word`` after 1, 2, ... characters, each
        prefix taken as a word of its own."""
        plain = word.isascii() and word.isalpha()
        text, stop = word, None
        if not plain:
            # bytes are spelled as characters; prefixes end only where a character of the word does
            parts = ["".join([self.chars[b] for b in c.encode()]) for c in word]
            text, stop = "".join(parts), set(accumulate(map(len, parts)))
        n, end, fits, starts, right = len(text), self.end, self._fits, self.starts, self.right
        last: list[str | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        ended = [0] * (n + 1)
        for s in range(n):
            before = last[s]
            if s:
                if before is None:
                    continue
                inner, final = right.get(before) or right.setdefault(before, ({}, {}))
            c = count[s] + 1
            for e in range(s + 1, n + 1):
                t = text[s:e]
                kind = starts.get(t)
                if kind is None:
                    break
                if kind & 1 and e < n and last[e] is None:
                    ok = True if s == 0 else inner.get(t)
                    if ok is None:
                        ok = inner[t] = fits(before, t)
                    if ok:
                        last[e], count[e] = t, c
                if kind & 2 and not ended[e] and (plain or e in stop):
                    ok = True if s == 0 else final.get(t)
                    if ok is None:
                        ok = final[t] = fits(before, t + end)
                    if ok:
                        ended[e] = c
        return ended[1:] if plain else [ended[e] for e in sorted(stop)]

    def _deltas(self, piece: str) -> bytes:
        """The changes of the count over one tile."""
        if self.space(piece):
            return bytes(len(piece))
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            # a contraction: its prefixes split in another way
            counts = [0] * len(piece)
            for k in range(1, len(piece) + 1):
                counts[k - 1] = sum(self.word_counts(p)[-1] for p in self.tiles(piece[:k]))
        else:
            counts = self.word_counts(piece)
        return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])

    def _segments(self, text: str) -> list[str]:
        """Normalised text and special tokens by turns."""
        parts = self.special.split(text) if "<|" in text else [text]
        return [p if k % 2 else _lower(unicodedata.normalize("NFC", p)) for k, p in enumerate(parts)]

    def normalise(self, text: str) -> str:
        """The text that prefixes are taken of."""
        return "".join(self._segments(text))

    def _plain(self, text: str) -> tuple[bytes, str]:
        """The changes over normalised text without special tokens; its last tile."""
        tiles = self.tiles(text)
        memo = self.cache
        return b"".join(map(memo.__getitem__, tiles)), tiles[-1] if tiles else ""

    def deltas(self, text: str | None) -> np.ndarray:
        """For each character of the normalised text, the change of the token count."""
        if not text:
            return np.zeros(0, np.int8)
        segments = self._segments(text)
        if len(segments) == 1:
            return np.frombuffer(self._plain(segments[0])[0], np.int8)
        out: list[np.ndarray] = []
        for k, part in enumerate(segments):
            if k % 2 == 0:
                got, tail = self._plain(part)
                out.append(np.frombuffer(got, np.int8))
                tail = "" if self.space(tail) else tail
                continue
            # until it is whole, a special token's prefix is ordinary text after the last tile
            base = sum(self._count_of(t) for t in [tail] if t)
            counts = [sum(map(self._count_of, self.tiles(tail + part[:j]))) - base for j in range(1, len(part))]
            out.append(np.diff([0, *counts, 1]).astype(np.int8))
        return np.concatenate(out)

    def _count_of(self, tile: str) -> int:
        return int(np.frombuffer(self._deltas(tile), np.int8).sum())


def count_at(deltas: np.ndarray, prefix: int) -> int:
    """Tokens of the first ``prefix`` characters."""
    return int(deltas[:prefix].sum(dtype=np.int64))


def longest_within(deltas: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    counts = np.cumsum(deltas, dtype=np.int64)
    return int(np.flatnonzero(counts <= budget).max(initial=-1)) + 1


_models: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _models:
        _models[path] = PrefixCounter(path)
    return _models[path]


def prefix_counts(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` long and ``deltas`` binary (a signed byte for each character
    of the normalised text; ``count_at`` and ``longest_within`` read it)."""

    def make():
        c = counter(path)

        def run(texts):
            found = [c.deltas(t) for t in texts]
            return [(int(d.sum(dtype=np.int64)), d.tobytes()) for d in found]

        return run

    return map_texts(df, [id_col], text_col, "n_tokens long, deltas binary", make)


def count_tokens(df: DataFrame, path: str, budget: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` long (UTF-8), ``n_tokens`` long, ``over_limit`` boolean (more
    than ``budget`` tokens) and ``fit_chars`` long: the characters of the normalised text's
    longest prefix within the budget, read off the prefix counts."""

    def make():
        c = counter(path)

        def run(texts):
            rows = []
            for t in texts:
                d = c.deltas(t)
                n = int(d.sum(dtype=np.int64))
                rows.append((len((t or "").encode()), n, n > budget, longest_within(d, budget)))
            return rows

        return run

    return map_texts(df, [id_col], text_col, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long", make)
