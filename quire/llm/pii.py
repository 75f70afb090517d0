"""PII (operator 3): a skip-chain conditional random field over the tokens of a document.

Method: four exact patterns give the base spans. A conditional random field then labels the
tokens that hold a digit or an @ (tokens without either are outside, by the label set's
nature): neighbours in the text share transition potentials, and distant tokens that repeat
each other (same digits, same letters) or are similar (same last seven digits, same mail
domain) share skip potentials, so that what is certain at one place carries to the others.
Base spans are evidence, clamped to their label. Loopy sum-product message passing runs over
all documents of a chunk at once, each document until its messages stand still; a token is
added when its marginal reaches ``SURE``.

All mentions of one key hang on one hub, a hidden label of their own, so edges grow with the
tokens and a certainty is two links from every other mention, however many there are. A hub
whose certain mentions agree is certain itself.

Learning: the potentials are fitted by pseudo-likelihood on ``TRAIN_DOCS`` labelled documents
that a fixed grammar writes (numbers, addresses, cards and mail in several notations, some
repeated in short form, among dates, prices, versions and order numbers). No row of the
corpus is learned from, so predictions do not change with the input.

Defined cases: null and empty texts have no spans; very long texts and tokens are read whole, in
time that grows with their length; an added span never overlaps a base span; repeated rows give equal results; an empty table gives an empty
table; columns other than those named are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from array import array
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from ._spark import map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Labelled documents that the potentials are learned from.
TRAIN_DOCS = 500
#: The least marginal of an added token.
SURE = 0.9
#: A document's messages stand still when none moves by more than this.
STILL = 1e-4
#: Rounds after which messages that do not settle are taken as they are.
MOST_ROUNDS = 2000
_CHAIN, _SAME, _LIKE = 0, 1, 2

_any = re.compile(r"[0-9@]").search
_word = re.compile(r"[^\x20\x09-\x0D]+")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, sorted. Each kind's matches are leftmost and
    do not overlap; a match that fails its test is dropped and not tried again."""
    if not text or not _any(text):
        return []
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        # before an @ the run of name characters is the whole local part
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        m = _domain(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _ip.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _phone.finditer(text):
        if 10 <= len(_digit.findall(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_letters, _wide, _digits = re.compile("[A-Za-z]+"), re.compile("[^\x00-\x7f]+"), re.compile("[0-9]+")
_no_digit = re.compile("[^0-9]+")
_EDGES = ".,;:!?\"'()[]<>"


def _shape(token: str) -> str:
    """The whole token with its runs of letters and of digits named, digits with their number."""
    return _digits.sub(lambda m: f"9{m.end() - m.start()}", _wide.sub("u", _letters.sub("a", token)))


def features(token: str, before: str | None, after: str | None) -> list[str]:
    """Names of the features of a token; ``before`` and ``after`` are the neighbouring words."""
    digits = _no_digit.sub("", token)
    core = token.strip(_EDGES)
    n = len(digits)
    out = [
        "s=" + _shape(token),
        "c=" + _shape(core),
        f"n={min(n, 20)}",
        f"at={'@' in token}",
        f"dots={min(core.count('.'), 4)}",
        f"dash={min(core.count('-'), 3)}",
        f"plus={token[0] == '+'}",
        f"alpha={any(map(str.isalpha, core))}",
        f"only={core.replace('-', '').replace('.', '').isdigit()}",
    ]
    if 13 <= n <= 19:
        out.append(f"luhn={luhn(digits)}")
    for name, word in (("b", before), ("a", after)):
        if word is None:
            out.append(name + "=edge")
        else:
            out.append(name + "=" + (_shape(word) if _any(word) else "word"))
    return out


def _keys(token: str) -> list[tuple[int, str]]:
    """What a token is linked by: (edge type, key)."""
    digits = _no_digit.sub("", token)
    out = []
    core = token.lower().strip(_EDGES)
    if "@" in core:
        out += [(_SAME, core), (_LIKE, core.rsplit("@", 1)[1])]
    elif len(digits) >= 5:
        out.append((_SAME, digits))
        if len(digits) >= 7:
            out.append((_LIKE, digits[-7:]))
    return [k for k in out if k[1]]


class Graph:
    """The tokens of several documents with their features, their edges and the hubs of keys that
    a document repeats. With an ``index`` of feature names only the known ones are held."""

    def __init__(self, index: dict[str, int] | None = None):
        self.index = index
        self.feats: list[list[str]] = []
        self.rows, self.cols = array("i"), array("i")
        self.span: list[tuple[int, int, int]] = []  # document, start, end
        self.left, self.right = array("i"), array("i")  # neighbours
        self.hub_doc = array("i")
        self.hub, self.member, self.kind = array("i"), array("i"), array("b")  # a hub's links

    def add(self, doc: int, text: str) -> None:
        mentions: dict[tuple[int, str], list[int]] = {}
        previous = None  # the last token's word number and node
        before, now, k = None, None, -1
        words = ((m.start(), m.end()) for m in _word.finditer(text))
        here = next(words, None)
        while here:
            following = next(words, None)
            a, b = here
            before, now, k = now, text[a:b], k + 1
            here = following
            if not _any(now):
                continue
            node = len(self.span)
            self.span.append((doc, a, b))
            found = features(now, before, text[slice(*following)] if following else None)
            if self.index is None:
                self.feats.append(found)
            else:
                ids = [i for i in map(self.index.get, found) if i is not None]
                self.rows.extend([node] * len(ids)), self.cols.extend(ids)
            if previous and previous[0] == k - 1:
                self.left.append(previous[1]), self.right.append(node)
            previous = (k, node)
            for key in _keys(now):
                mentions.setdefault(key, []).append(node)
        for (kind, _), nodes in mentions.items():
            if len(nodes) > 1:
                self.hub.extend([len(self.hub_doc)] * len(nodes)), self.member.extend(nodes), self.kind.extend([kind] * len(nodes))
                self.hub_doc.append(doc)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends and types of all edges; hubs are nodes after the tokens."""
        ints = lambda x: np.array(x, np.int64)
        left = np.concatenate((ints(self.left), ints(self.hub) + len(self.span)))
        kind = np.concatenate((np.full(len(self.left), _CHAIN), ints(self.kind)))
        return left, np.concatenate((ints(self.right), ints(self.member))), kind

    def hub_labels(self, labels: np.ndarray, k: int) -> np.ndarray:
        """For each hub how many of its mentions have each label (below 0: none)."""
        hub, label = np.array(self.hub, np.int64), labels[np.array(self.member, np.int64)] if len(self.hub) else np.zeros(0, np.int64)
        known = label >= 0
        return np.bincount(hub[known] * k + label[known], minlength=len(self.hub_doc) * k).reshape(-1, k)


def _write(rng: random.Random) -> list[tuple[str, str]]:
    """One labelled document of the grammar: (token, label)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdeilmnorstuv") for _ in range(rng.randint(2, 9)))

    def card():
        body = rng.choice("3456") + d(rng.choice([12, 13, 14, 14, 14, 14]))
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + check

    def entity() -> list[list[tuple[str, str]]]:
        """Ways to write one entity, the full one first."""
        kind = rng.choice(KINDS)
        lab = lambda s: [(t, kind) for t in s.split()]
        if kind == "email":
            host = f"{name()}{rng.choice(['', d(1)])}.{rng.choice(['example.com', 'org', 'net', 'de'])}"
            mail = f"{name()}{rng.choice(['.', '_', '-', ''])}{rng.choice([name(), d(2)])}@{host}"
            return [lab(mail), lab(f"<{mail}>,"), lab(mail + "."), lab(mail.upper())]
        if kind == "ip":
            ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
            return [lab(ip), lab(ip + ","), lab(f"({ip})"), lab(f"{ip}:{d(4)}")]
        if kind == "card":
            c = card()
            return [lab(c), lab(" ".join(c[i : i + 4] for i in range(0, len(c), 4))), lab("-".join(c[i : i + 4] for i in range(0, len(c), 4))), lab(c + ".")]
        a, b, c = d(3), d(3), d(4)
        return [lab(f"+1 ({a}) {b}-{c}"), lab(f"+{rng.randint(1, 99)} {a} {b} {c}"), lab(f"({a}) {b}-{c}"), lab(f"{a}-{b}-{c}"), lab(f"{b}-{c}"), lab(f"+1-{a}-{b}-{c},")]

    def plain() -> list[tuple[str, str]]:
        y, m = rng.randint(1900, 2030), rng.randint(1, 12)
        return [(t, "O") for t in rng.choice([f"{y}-{m:02}-{rng.randint(1, 28):02}", f"{rng.randint(0, 23)}:{d(2)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", f"{y}", f"{y}.", f"${d(2)}.{d(2)}", f"#{d(6)}", f"{d(3)},{d(3)}", f"v{d(1)}.{d(1)}.{d(2)}", f"@{name()}", d(rng.randint(1, 12)), d(rng.randint(14, 22)), f"id={d(8)}", f"{name()}{d(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), f"{m}/{y}", f"{d(3)}%", f"pp. {d(3)}-{d(3)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}"]).split()]

    out: list[tuple[str, str]] = []
    for _ in range(rng.randint(2, 5)):
        ways = entity()
        n = rng.choice([1, 1, 2, 3])
        for k in range(n):
            out += [(name(), "O")] * rng.choice([0, 1, 1, 2, 3])
            out += ways[0] if k == 0 and rng.random() < 0.7 else rng.choice(ways)
            out += [(name(), "O")] * rng.choice([0, 0, 1, 2])
            for _ in range(rng.randint(0, 2)):
                out += plain() + [(name(), "O")]
    return out


class _Cover:
    """The sorted spans of a text, asked which of them overlaps a place."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.spans = spans
        self.reach = list(accumulate((e for _, _, e in spans), max))

    def kind(self, a: int, b: int) -> int:
        """The kind of the first span that overlaps a to b, or -1."""
        # the first that reaches beyond a is one that ends there itself
        at = bisect_right(self.reach, a)
        return self.spans[at][1] if at < len(self.spans) and self.spans[at][0] < b else -1


class SkipChain:
    """Unary weights of hashed feature names, and a potential matrix for each edge type."""

    def __init__(self, seed: int = 11, rounds: int = 150, cost: float = 0.02):
        rng, graph, gold = random.Random(seed), Graph(), []
        for doc in range(TRAIN_DOCS):
            words = _write(rng)
            graph.add(doc, " ".join(t for t, _ in words))
            gold += [LABELS.index(label) for t, label in words if _any(t)]
        k = len(LABELS)
        # a hub's label is the one that most of its mentions have
        y = np.array(gold)
        y = np.concatenate((y, graph.hub_labels(y, k).argmax(1)))
        self.index: dict[str, int] = {}
        for fs in graph.feats:
            for f in fs:
                self.index.setdefault(f, len(self.index))
        rows, cols = self._active(graph)
        left, right, kind = graph.edges()
        u, t = np.zeros((len(self.index), k)), np.zeros((3, k, k))
        hot = np.eye(k)[y]
        moment = [np.zeros_like(u), np.zeros_like(t)]
        for step in range(rounds):
            logit = np.zeros((len(y), k))
            for c in range(k):
                logit[:, c] = np.bincount(rows, u[cols, c], len(y))
            np.add.at(logit, right, t[kind, y[left]])
            np.add.at(logit, left, t[kind, :, y[right]])
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = hot - p
            gu, gt = -cost * u, -cost * t * 20
            for c in range(k):
                gu[:, c] += np.bincount(cols, err[rows, c], len(u))
            np.add.at(gt, (kind, y[left]), err[right])
            for c in range(k):
                np.add.at(gt[:, :, c], (kind[y[right] == c],), err[left[y[right] == c]])
            for w, g, m in ((u, gu, moment[0]), (t, gt, moment[1])):
                m += g * g  # AdaGrad
                w += 0.5 * g / np.sqrt(m + 1e-6)
        self.unary, self.pair = u, t

    def _active(self, graph: Graph) -> tuple[np.ndarray, np.ndarray]:
        if graph.index is not None:
            return np.array(graph.rows, np.int64), np.array(graph.cols, np.int64)
        known = [(i, self.index[f]) for i, fs in enumerate(graph.feats) for f in fs if f in self.index]
        return tuple(np.array(known, np.int64).reshape(-1, 2).T)

    def marginals(self, graph: Graph, clamp: np.ndarray) -> np.ndarray:
        """Loopy belief propagation. clamp: the known label of a token, or -1."""
        n, k = len(graph.span), len(LABELS)
        votes = graph.hub_labels(clamp, k)
        agreed = (votes > 0).sum(1) == 1
        clamp = np.concatenate((clamp, np.where(agreed, votes.argmax(1), -1)))
        rows, cols = self._active(graph)
        belief = np.zeros((len(clamp), k))
        for c in range(k):
            belief[:, c] = np.bincount(rows, self.unary[cols, c], len(clamp))
        known = clamp >= 0
        belief[known] = np.where(np.arange(k) == clamp[known, None], 0.0, -50.0)
        left, right, kind = graph.edges()
        if len(left):
            doc = np.concatenate(([d for d, _, _ in graph.span], np.array(graph.hub_doc, np.int64))).astype(np.int64)
            # both directions of an edge, sorted by potential, so that each is one product
            src, dst = np.concatenate((left, right)), np.concatenate((right, left))
            which = np.concatenate((2 * kind, 2 * kind + 1))
            order = np.argsort(which, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            back = place[np.concatenate((np.arange(len(left)) + len(left), np.arange(len(left))))[order]]
            src, dst, which = src[order], dst[order], which[order]
            of = doc[dst]
            pots = [np.exp(m) for p in self.pair for m in (p, p.T)]
            msg, live = np.zeros((len(src), k)), np.arange(len(src))
            for _ in range(MOST_ROUNDS):
                out = belief[src[live]] - msg[back[live]]
                out = np.exp(out - out.max(1, keepdims=True))
                cut = np.searchsorted(which[live], np.arange(len(pots) + 1))
                new = np.log(np.concatenate([out[a:b] @ p for p, a, b in zip(pots, cut, cut[1:])]))
                new -= new.max(1, keepdims=True)
                step = 0.5 * (new - msg[live])
                msg[live] += step
                for c in range(k):
                    belief[:, c] += np.bincount(dst[live], step[:, c], len(belief))
                moving = np.zeros(len(graph.span) and int(doc.max()) + 1, bool)
                moving[of[live[np.abs(step).max(1) > STILL / 2]]] = True
                live = live[moving[of[live]]]
                if not len(live):
                    break
        p = np.exp(belief[:n] - belief[:n].max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """For each text: the base spans, and the spans that the field adds."""
        base = [base_spans(t) if t else [] for t in texts]
        graph = Graph(self.index)
        for i, t in enumerate(texts):
            if t and _any(t):
                graph.add(i, t)
        added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not graph.span:
            return list(zip(base, added))
        over = [_Cover(b) for b in base]
        clamp = np.array([over[doc].kind(a, b) + 1 for doc, a, b in graph.span])
        covered = clamp > 0
        p = self.marginals(graph, np.where(covered, clamp, -1))
        best = p.argmax(1)
        sure = (p.max(1) >= SURE) & (best > 0) & ~covered
        for node in np.flatnonzero(sure).tolist():
            doc, a, b = graph.span[node]
            text, kind = texts[doc], int(best[node]) - 1
            # a bracket stays if its other half is inside
            closing = text.rfind(")", a, b)
            while a < b and text[a] in _EDGES and not (text[a] == "(" and closing >= a):
                a += 1
            opening = text.find("(", a, b)
            while b > a and text[b - 1] in _EDGES and not (text[b - 1] == ")" and 0 <= opening < b):
                b -= 1
            if a == b or over[doc].kind(a, b) >= 0:
                continue
            mine = added[doc]
            # neighbouring tokens of one kind are one entity
            if mine and mine[-1][1] == kind and a - mine[-1][2] <= 2 and text[mine[-1][2] : a].isspace():
                mine[-1] = (mine[-1][0], kind, b)
            else:
                mine.append((a, kind, b))
        return list(zip(base, added))


@functools.cache
def trained() -> SkipChain:
    """The field, fitted once in a process; the same in all of them."""
    return SkipChain()


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_pii(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans, long),
    ``base_sha256``, ``spans`` (all spans as kind:start:end in code points, by start, then in
    the order of the kinds, comma-joined) and ``n_added`` long."""
    field = df.sparkSession.sparkContext.broadcast(trained())

    def run(texts):
        rows = []
        for base, added in field.value.spans(texts):
            n = [sum(k == j for _, k, _ in base) for j in range(4)]
            sha = hashlib.sha256(spell(base).encode()).hexdigest()
            rows.append((*n, sha, spell(base + added), len(added)))
        return rows

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_texts(df, [id_col], text_col, schema, lambda: run)


def redact(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with every span of the text replaced by its kind in brackets, as in [EMAIL]. Where
    spans overlap, their union is replaced once, under the first one's kind. Other columns and
    their order stay."""
    field = df.sparkSession.sparkContext.broadcast(trained())

    def clean(text, spans):
        out, at = [], 0
        for a, k, b in sorted(spans):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(texts):
        return [(clean(t, base + added) if base or added else t,) for t, (base, added) in zip(texts, field.value.spans(texts))]

    others = [c for c in df.columns if c != text_col]
    done = map_texts(df, others, text_col, f"`{text_col}` string", lambda: run)
    return done.select(*df.columns)
