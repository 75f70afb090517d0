"""Secret scans (operator 8), with DataFrame functions only.

Method: three exact patterns give the base spans. Other long runs of key characters are scored
by two character Markov models, one of random strings and one of ordinary identifiers: the
sum of the log-likelihood ratios of their character pairs. Runs whose sum reaches a threshold
are added under the kind ``markov``.

Learning: the labelled samples are random strings spelled in four alphabets and many lengths
from hash values (``RANDOM_ROWS`` of each); as many plain numbers, dates and ruled lines; and ordinary words,
and words put together as identifiers and paths are, of documents that match no base pattern:
distinct texts picked by a hash of the text, ``SAMPLE_DOCS`` of them at most on average. A hash
of each string parts the samples: one half is counted for the models, the other sets the
threshold, of its strings that are as long as a run: the sum that ``FALSE`` of the ordinary ones
reach or, where the sum that all but ``MISSED`` of the random ones reach is higher, the middle of
the two. The table has 128 x 128 numbers whatever the input is.

Positions: the pieces between the matches of a pattern and the matches themselves tile the
text, so running sums of their lengths are the places, in code points. Sums, and the reach of
base spans, run in as many steps as the number of matches has binary digits, so that time grows
with the text and not with its square.

Defined cases: null and empty texts have no spans; very long texts are whole; an added span
never overlaps a base span; repeated rows give equal results; an empty table gives an empty
table (the models then know the random strings and numbers only, and smoothing); other columns
are not touched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import running
from ._spark import materialize

KINDS = ("assign", "access", "hex", "markov")
#: Fixed patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the models judge: runs of key characters.
LEAST_RUN = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
#: Bounds of the labelled samples.
RANDOM_ROWS, SAMPLE_DOCS = 4000, 400
#: Shares of the held-out ordinary and random strings that set the threshold.
FALSE, MISSED = 0.001, 0.01

_LONGS, _SPAN = "array<bigint>", "array<struct<start:bigint,end:bigint>>"
_FAR = (1 << 62) - 1


@dataclass(frozen=True)
class Model:
    """``ratios``: the log-likelihood ratio of each character pair, at 128 * first + second;
    ``least``: the threshold; of the held-out samples, ``missed``: the share of random strings
    below it, ``false``: the share of ordinary strings that reach it."""

    ratios: list[float]
    least: float
    missed: float | None
    false: float | None


def _pairs(df: DataFrame) -> DataFrame:
    """Counts of the character pairs of the strings ``w``: (random, a, b, n), at most 2 x 128 x 128 rows."""
    w = df.where(F.length("w") >= 2)
    pair = w.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.col("w").substr(i, F.lit(2)))).alias("p"))
    pair = pair.groupBy("random", "p").count()
    return pair.select("random", F.ascii(F.substring("p", 1, 1)).alias("a"), F.ascii(F.substring("p", 2, 1)).alias("b"), F.col("count").alias("n")).where("a < 128 and b < 128")


def samples(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The labelled strings: ``w``, ``random`` boolean, ``held`` boolean (sets the threshold)."""
    spark = df.sparkSession
    seeds = spark.range(RANDOM_ROWS)
    sha = F.sha2(F.concat(F.lit("quire-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(sha))
    n = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(25)).cast("int") + LEAST_RUN
    cut = lambda w: F.substring(w, F.lit(1), n)
    spelled = seeds.select(F.explode(F.array(cut(sha), cut(b64), cut(F.translate(F.upper(b64), "+/=", "")), cut(F.translate(b64, "+/", "-_")))).alias("w"))
    # numbers, dates and ruled lines are ordinary, however long
    big = lambda salt: F.abs(F.xxhash64("id", F.lit(salt))).cast("string")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(30000)).cast("int")), "yyyy-MM-dd")
    number = seeds.select(F.explode(F.array(F.concat(big(0), big(1)), cut(F.concat(big(3), big(4))), F.concat(day, F.lit("/"), day), F.expr("repeat(element_at(array('-', '=', '_', '+', '/'), cast(id % 5 as int) + 1), 16 + cast(id % 40 as int))"))).alias("w"))
    total = df.count()
    t = F.col("t")
    docs = df.select(F.col(text_col).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < math.ceil(SAMPLE_DOCS / max(1, total) * (1 << 30)))
    docs = docs.where(t.isNotNull() & ~t.rlike(ASSIGN) & ~t.rlike(ACCESS) & ~t.rlike(HEX)).groupBy(F.xxhash64("t").alias("h")).agg(F.min("t").alias("t"))
    words = docs.select(F.regexp_extract_all("t", F.lit("[A-Za-z]{2,40}"), F.lit(0)).alias("ws")).where(F.size("ws") > 3)
    words = words.select("ws", F.slice("ws", F.lit(2), F.size("ws")).alias("x"), F.slice("ws", F.lit(3), F.size("ws")).alias("y"))
    # neighbouring words, put together in one of five ways, and the same in capitals
    sign = lambda i: F.element_at(F.array(*map(F.lit, ("_", "-", "/", "", "="))), F.pmod(i, F.lit(5)).cast("int") + 1)
    three = F.transform(F.arrays_zip("ws", "x", "y"), lambda z, i: F.concat(F.when(i % 3 == 0, F.initcap(z["ws"])).otherwise(z["ws"]), sign(i), F.when(i % 3 < 2, F.initcap(F.coalesce(z["x"], F.lit("")))).otherwise(F.coalesce(z["x"], F.lit(""))), sign(i), F.initcap(F.coalesce(z["y"], F.lit("")))))
    plain = words.select(F.explode(F.concat("ws", three, F.transform(three, lambda w: F.upper(w)))).alias("w"))
    out = spelled.select("w", F.lit(True).alias("random")).unionByName(number.unionByName(plain).select("w", F.lit(False).alias("random")))
    return out.withColumn("held", F.pmod(F.xxhash64("w", F.lit(9)), F.lit(2)) == 0)


def fit(df: DataFrame, *, text_col: str = "text") -> Model:
    """The models and their threshold; ``df`` gives the ordinary words."""
    rows = materialize(samples(df, text_col=text_col), "samples")
    n = [[0.0] * (128 * 128) for _ in range(2)]
    for r in _pairs(rows.where("not held")).collect():
        n[r["random"]][128 * r["a"] + r["b"]] += r["n"]
    size = [[sum(t[128 * a : 128 * a + 128]) for a in range(128)] for t in n]
    # add-half smoothing over the 66 key characters
    chance = lambda k, a, b: math.log((n[k][128 * a + b] + 0.5) / (size[k][a] + 33))
    ratios = [chance(1, a, b) - chance(0, a, b) for a in range(128) for b in range(128)]
    judged = rows.where(F.col("held") & F.col("w").rlike(f"^{RUN}$")).select("random", _score(F.col("w"), _table(ratios)).alias("s"))
    edge = lambda which, p: F.expr(f"percentile(CASE WHEN {which} THEN s END, {p})")
    plain, spelled = judged.agg(edge("NOT random", 1 - FALSE), edge("random", MISSED)).first()
    plain, spelled = plain or 0.0, spelled or 0.0
    least = max(plain, (plain + spelled) / 2)
    share = lambda which, hit: F.avg(F.when(which, hit.cast("double")))
    rates = judged.agg(share(F.col("random"), F.col("s") < least), share(~F.col("random"), F.col("s") >= least)).first()
    return Model(ratios, least, *rates)


def _table(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")


def _score(word: Column, table: Column) -> Column:
    """The sum of the log-likelihood ratios of the pairs of an ASCII string."""
    # the sum runs over one pass of characters; the struct carries the one before
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        more = F.when(acc["last"] >= 0, F.element_at(table, acc["last"] * 128 + code + 1)).otherwise(F.lit(0.0))
        return F.struct(code.alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(F.split(word, ""), start, step, lambda acc: acc["sum"])


def scan(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and an array of spans for each kind: ``assign``, ``access``, ``hex`` and
    ``markov`` (start and end in code points). Arrays that a later step uses more than once are
    columns of a step of their own, or they would be computed for each use."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": RUN}
    text, each = F.col("__t"), lambda f: [f(k).alias(k) for k in pattern]
    cols = lambda prefix: [F.col(prefix + k) for k in pattern]
    rows = df.select(F.col(id_col).alias("__i"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    found = rows.select("__i", "__t", *[c.alias("f_" + k) for k, c in zip(pattern, each(lambda k: F.regexp_extract_all(text, F.lit(pattern[k]), F.lit(0))))])

    def sizes(k: str) -> Column:
        f = F.col("f_" + k)
        both = F.zip_with(F.slice(F.split(text, pattern[k], -1), F.lit(1), F.size(f)), f, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        return F.when(F.size(f) == 0, F.array().cast(_LONGS)).otherwise(both).alias("n_" + k)

    values = F.when(F.size("f_assign") == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    sized = found.select("__i", *cols("f_"), values.alias("values"), *[sizes(k) for k in pattern])
    ends = sized.select("__i", *cols("f_"), "values", *[running(F.col("n_" + k), lambda x, y: x + y, 0).alias("e_" + k) for k in pattern])

    def spans(k: str) -> Column:
        return F.zip_with("e_" + k, "f_" + k, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))

    long = F.filter(F.zip_with(spans("assign"), "values", lambda s, v: F.when(F.length(v) >= 8, s)), lambda s: s.isNotNull())
    runs = F.zip_with("e_run", "f_run", lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(1).alias("run"), e.alias("end"), m.alias("word")))
    placed = ends.select("__i", long.cast(_SPAN).alias("assign"), spans("access").cast(_SPAN).alias("access"), spans("hex").cast(_SPAN).alias("hex"), runs.alias("runs"))
    # base spans and runs by start: a run is free if no base span before it reaches over its
    # start, and none after it starts before its end
    base = F.transform(F.concat("assign", "access", "hex"), lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("run"), s["end"].alias("end"), F.lit("").alias("word")))
    none = F.size("runs") == 0
    events = F.when(none, F.col("runs")).otherwise(F.array_sort(F.concat(base, "runs")))
    mixed = placed.select("__i", "assign", "access", "hex", events.alias("events"))
    reach = running(F.col("reach"), lambda x, y: F.greatest(x, y), -1)
    following = F.reverse(running(F.col("next"), lambda x, y: F.least(x, y), _FAR))
    mixed = mixed.select(
        "*",
        F.transform("events", lambda e: F.when(e["run"] == 0, e["end"]).otherwise(F.lit(-1).cast("bigint"))).alias("reach"),
        F.reverse(F.transform("events", lambda e: F.when(e["run"] == 0, e["start"]).otherwise(F.lit(_FAR)))).alias("next"),
    )
    mixed = mixed.select("__i", "assign", "access", "hex", "events", reach.alias("reach"), following.alias("next"))
    table = _table(model.ratios)

    def added(z: Column) -> Column:
        e = z["events"]
        free = (e["run"] == 1) & (z["reach"] <= e["start"]) & (z["next"] >= e["end"])
        return F.when(free, _score(e["word"], table) >= model.least).otherwise(F.lit(False))

    picked = F.filter(F.arrays_zip("events", "reach", "next"), added)
    markov = F.transform(picked, lambda z: F.struct(z["events"]["start"].alias("start"), z["events"]["end"].alias("end")))
    return mixed.select(F.col("__i").alias(id_col), "assign", "access", "hex", markov.cast(_SPAN).alias("markov"))


def _spelled(*kinds: str) -> Column:
    """Spans of the kinds as kind:start:end, by start, then in the order of the kinds."""
    def rank(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    ranked = [rank(i, k) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*ranked)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_assign``, ``n_access``, ``n_hex`` (base spans, long), ``base_sha256``,
    ``spans`` (all, comma-joined) and ``n_added`` long."""
    found = scan(df, fit(df, text_col=text_col), id_col=id_col, text_col=text_col)
    count = lambda k: F.size(k).cast("long")
    return found.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_spelled("assign", "access", "hex"), 256).alias("base_sha256"),
        _spelled(*KINDS).alias("spans"),
        count("markov").alias("n_added"),
    )
