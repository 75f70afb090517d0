"""Language ID (operator 4): hierarchical discrimination.

Method: a linear support vector machine for each language family (one against the rest) gives
the family; within it, one-versus-one linear support vector machines vote on the language.
Features are the hashed character trigrams of the lower-cased words of the whole text; their
weights are averaged over the text, so that a prediction is one gather and one sum.

Learning: a bounded sample of labelled rows of the ``MAX_LABELS`` most frequent labels: ``per_lang``
of each on average, so that all together are ``MAX_ROWS`` on average, and never more than twice
that; rows that repeat id and text count once, and texts of over ``MAX_BYTES`` are not learned
from. They are taken by a hash of id and text, least first. The machines are fitted by dual
coordinate descent; logistic scales fitted on the sample turn margins into the score.

Defined cases: null text or text without a letter is ``und`` with score 0; with no learned
label every text is ``und``; labels whose family is not known form a family of their own;
equal votes go to the larger margin sum, then to the label first in order; rows with a null
id or label are never learned from; repeated rows are predicted alike; an empty table gives
an empty table; other columns than those named are not touched.
"""

from __future__ import annotations

import regex
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import map_texts

UND = "und"
BITS = 14
#: Bounds of the sample: rows learned from for each label and in all (on average; at most twice
#: that), labels, and bytes of a text.
PER_LANG, MAX_ROWS, MAX_LABELS, MAX_BYTES = 300, 2400, 256, 1 << 18
#: Of ``StrictModel``: the least fit of a text (nats a trigram), the share of trigrams taken as
#: spread evenly, the slot of trigrams without a letter, what each of them adds to the sum, and the rows of a label that is checked.
MIN_FIT, UNSEEN, NO_LETTER, NO_LETTER_FIT, FEW_ROWS = 0.5, 0.05, 0, -1.0, 5

#: Language codes of each family.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn mr ne gu pa ur",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv",
}
_family_of = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_letter = regex.compile(r"\p{L}").search


def family(lang: str) -> str:
    return _family_of.get(lang, lang)


def _code_table() -> np.ndarray:
    """Code point -> itself for letters and 0 for others; letters past the table stand for themselves."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x3000)], np.uint32)


def trigram_codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and where each text begins. Every text is set
    between two gaps, so it has at least one trigram."""
    joined = "\0\0".join(["", *[t.lower() for t in texts], ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, len(table) - 1)
    codes = np.where(points < len(table), table[low], points)
    size = np.array([len(t.lower()) for t in texts]) + 2
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    h = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64), starts


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of an L2-loss linear SVM, by dual coordinate descent. y: 1 or -1; rows of the
    rarer class weigh more, so that both classes count alike."""
    n = len(y)
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    diag = 1 / (2 * cost * share)
    q = (x * x).sum(1) + diag
    alpha, w = np.zeros(n), np.zeros(x.shape[1], np.float64)
    order = np.random.RandomState(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(n):
            g = y[i] * (x[i] @ w) - 1 + diag[i] * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(0.0, alpha[i] - g / q[i])
            w += (new - alpha[i]) * y[i] * x[i]
            most = max(most, abs(g))
            alpha[i] = new
        if most < 0.01:
            break
    return w


def _scale(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope k for which 1 / (1 + exp(-k margin)) fits the labels best."""
    grid = np.geomspace(0.25, 64, 33)
    loss = [np.logaddexp(0, -k * margin * y).mean() for k in grid]
    return float(grid[int(np.argmin(loss))])


class LanguageModel:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.members = [[x for x in self.langs if family(x) == f] for f in self.families]
        columns: list[tuple] = []  # ("f", family index) or ("p", first, second)
        if len(self.families) == 2:
            columns.append(("f", 0))
        elif len(self.families) > 2:
            columns += [("f", k) for k in range(len(self.families))]
        for group in self.members:
            columns += [("p", a, b) for i, a in enumerate(group) for b in group[i + 1 :]]
        self.columns = columns
        self.weights = np.zeros((1 << BITS, len(columns)), np.float32)
        self.slopes = np.ones(len(columns))
        if not columns:
            return
        x = np.empty((len(texts), 1 << BITS), np.float32)
        table = _code_table()
        for i, t in enumerate(texts):
            h, _ = trigram_codes([t], table)
            x[i] = np.bincount(h, minlength=1 << BITS) * np.float32(20 / len(h))
        lang = np.array(langs)
        fam = np.array([self.families.index(family(v)) for v in langs])
        for c, what in enumerate(columns):
            rows = np.ones(len(lang), bool) if what[0] == "f" else (lang == what[1]) | (lang == what[2])
            y = np.where(fam == what[1] if what[0] == "f" else lang == what[1], 1.0, -1.0)[rows]
            w = _svm(x[rows], y)
            self.weights[:, c] = 20 * w
            self.slopes[c] = _scale(x[rows] @ w, y)

    def predict(self, texts: list[str | None], table: np.ndarray) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and _letter(t)] if self.langs else []
        if not rows:
            return out
        kept = [texts[i] for i in rows]
        h, starts = trigram_codes(kept, table)
        count = np.diff(np.append(starts, len(h)))
        margin = np.empty((len(rows), len(self.columns)))
        for c in range(len(self.columns)):
            margin[:, c] = np.add.reduceat(self.weights[:, c][h], starts, dtype=np.float64) / count
        chance = 1 / (1 + np.exp(-np.clip(margin * self.slopes, -60, 60)))
        found = self._checked([self._decide(margin[r], chance[r]) for r in range(len(rows))], h, starts, count)
        for i, got in zip(rows, found):
            out[i] = got
        return out

    def _checked(self, found: list[tuple[str, float]], h: np.ndarray, starts: np.ndarray, count: np.ndarray) -> list[tuple[str, float]]:
        return found

    def _decide(self, margin: np.ndarray, chance: np.ndarray) -> tuple[str, float]:
        of_family = [c for c, what in enumerate(self.columns) if what[0] == "f"]
        if not of_family:
            best, sure = 0, 1.0
        elif len(of_family) == 1:
            best = 0 if margin[0] >= 0 else 1
            sure = chance[0] if best == 0 else 1 - chance[0]
        else:
            best = int(np.argmax(margin[: len(of_family)]))
            sure = chance[best] / chance[: len(of_family)].sum()
        group = self.members[best]
        wins = dict.fromkeys(group, 0.0)
        total = dict.fromkeys(group, 0.0)
        least = dict.fromkeys(group, 1.0)
        for c, what in enumerate(self.columns):
            if what[0] == "p" and what[1] in wins:
                a, b = what[1], what[2]
                wins[a if margin[c] >= 0 else b] += 1
                total[a] += margin[c]
                total[b] -= margin[c]
                least[a], least[b] = min(least[a], chance[c]), min(least[b], 1 - chance[c])
        lang = max(group, key=lambda v: (wins[v], total[v]))
        return lang, float(min(1.0, max(0.0, sure * least[lang])))


class StrictModel(LanguageModel):
    """A model that also rejects: a text whose trigrams are in no learned language ``MIN_FIT``
    likelier than by chance, on average, is ``und`` with score 0. The margins only tell the
    learned languages from each other, and are as wide for junk as for a short clean text; and
    a clean text that they take for another language has to stay.

    A row whose trigrams suit another label's rows better than those of its own is not learned
    from: the machines would learn a wrong label by heart. Labels of few rows are left alone."""

    def __init__(self, texts: list[str], langs: list[str]):
        table = _code_table()
        shares = [self._shares(t, table) for t in texts]
        names = sorted(set(langs))
        total = {v: np.zeros(1 << BITS) for v in names}
        size = dict.fromkeys(names, 0)
        for (at, share), lang in zip(shares, langs):
            total[lang][at] += share
            size[lang] += 1

        def suits(at, share, own):
            # the row itself is left out, or it would vouch for its label
            return max(names, key=lambda v: share @ self._log((total[v][at] - share * (v == own)) / max(1, size[v] - (v == own))))

        good = [size[v] < FEW_ROWS or suits(*s, v) == v for s, v in zip(shares, langs)]
        for (at, share), lang, g in zip(shares, langs, good):
            if not g:
                total[lang][at] -= share
                size[lang] -= 1
        super().__init__([t for t, g in zip(texts, good) if g], [v for v, g in zip(langs, good) if g])
        self.logs = np.zeros((len(self.langs), 1 << BITS), np.float32)
        for k, v in enumerate(self.langs):
            self.logs[k] = self._log(np.maximum(0, total[v]) / size[v])
        self.logs[:, NO_LETTER] = NO_LETTER_FIT

    @staticmethod
    def _shares(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of a text's trigrams with a letter, and the share of each."""
        at, n = np.unique(trigram_codes([text], table)[0], return_counts=True)
        at, n = at[at != NO_LETTER], n[at != NO_LETTER]
        return at, n / max(1, n.sum())

    @staticmethod
    def _log(share: np.ndarray) -> np.ndarray:
        return np.log((1 - UNSEEN) * np.maximum(0, share) * (1 << BITS) + UNSEEN)

    def fits(self, h: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Mean log ratio of each text's trigrams, in the language that suits it best, to chance."""
        return np.max([np.add.reduceat(row[h], starts, dtype=np.float64) for row in self.logs], axis=0) / count

    def _checked(self, found, h, starts, count):
        return [f if good else (UND, 0.0) for f, good in zip(found, (self.fits(h, starts, count) >= MIN_FIT).tolist())]


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, kind: type[LanguageModel] = LanguageModel) -> LanguageModel:
    """Learn from rows that are not held out and have an id, a text and a label. Two passes:
    label counts (no text is read), then a sample by a hash of the id, thinned so that each
    label has ``per_lang`` rows on average. The sample is all that the driver receives."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    most = rows.groupBy(F.col(lang_col).alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(MAX_LABELS)
    count = {r[0]: r[1] for r in most.collect()}
    if not count:
        return kind([], [])
    each = min(per_lang, max(1, MAX_ROWS // len(count)))
    share = F.create_map(*[F.lit(v) for lang, n in count.items() for v in (lang, min(1.0, each / n))])
    hashed = F.xxhash64(F.col(id_col), F.col(text_col))
    draw = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= MAX_BYTES) & (draw < share[F.col(lang_col)]))
    sample = sample.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("v"), hashed.alias("h"))
    sample = sample.groupBy("h").agg(F.min_by(F.struct("i", "t", "v"), "v").alias("r")).orderBy("h").limit(2 * MAX_ROWS)
    got = sample.select("r.*").collect()
    got = sorted(r for r in got if _letter(r[1]))
    return kind([r[1] for r in got], [r[2] for r in got])


def predict(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col`` (or the ``keep`` columns), ``lang_pred`` and ``score`` (0 to 1). The model
    has a fixed number of weights for each pair of labels; it is broadcast once."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        table = _code_table()
        return lambda texts: held.value.predict(texts, table)

    return map_texts(df, keep or [id_col], text_col, "lang_pred string, score double", make)
