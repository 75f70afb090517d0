"""SimHash near-dedup (operator 7): deletion-variant signatures.

Method: fingerprints of 64 bits link at ``bits`` or fewer differing bits (3 by contract). Cut into
two segments of 32 bits, two linked fingerprints have one segment that differs by at most one
bit; for 5 bits three segments are enough, and so on. Each segment is indexed once for each of
its bits, with that bit taken out: segments that differ by at most one bit share a variant.
Distinct fingerprints meet by equality of variants, their whole distance is verified, and the
links are merged into components.

A stage that wants similar texts rather than a distance takes a wider radius and several
fingerprints (``keep_one`` with ``bits`` and ``prints``): a link in any of them counts.

Skew: equal fingerprints (copies) are folded into one node before anything else, so a group
of copies costs one node. Of the links within a variant only a spanning forest leaves a task.
A variant that more than ``HOT_RUN`` distinct fingerprints share is indexed again by one-bit
variants of what it leaves open, cut in the same way, and so on until at most ``OPEN`` bits are
open, so that no group has more than 2048 members. No link is dropped.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any other;
rows that repeat a doc_id are each returned and form one node for each fingerprint; rows with
a null id get their fingerprint and the component of the others in reach (null if there is
none with an id); an empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import map_texts, materialize
from .components import connected_components

SEED = 42
MAX_BITS = 3
#: Distinct fingerprints of one variant that are compared directly, and bits that may be open
#: where all are.
HOT_RUN, OPEN = 8192, 11
#: Entries of a task's memory of links; it starts anew when full, which only repeats links.
FOREST = 500_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z in lower case."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    stops = last[words - 1 :] if len(tokens) >= words else last[-1:]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def _majority(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of hashes laid end to end, the bits that over half of each text's have."""
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(size)[:-1])), axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > size[:, None]).astype(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).ravel()


def _other(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes unlike ``h``, for the k-th further fingerprint."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: list[str | None], words: int, prints: int = 1) -> np.ndarray:
    """Unsigned 64-bit fingerprints, a row for each text: a bit is 1 if it is set in over half of the
    hashes. The first is of the hashes themselves, further ones are of hashes made of them."""
    hashes = [shingle_hashes(t, words) for t in texts]
    size = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(texts), prints), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        flat = np.concatenate([hashes[i] for i in some])
        for k in range(prints):
            out[some, k] = _majority(_other(flat, k) if k else flat, size[some])
    return out


def fingerprint_column(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, prints: int = 1, keep: list[str] | None = None) -> DataFrame:
    """``id_col`` (or ``keep``) and ``fp``, the fingerprint as a signed long; further ones are ``fp1``
    and so on."""

    def run(texts):
        return [tuple(r) for r in fingerprints(texts, words, prints).view(np.int64).tolist()]

    names = ["fp", *[f"fp{k}" for k in range(1, prints)]]
    return map_texts(df, keep or [id_col], text_col, ", ".join(f"{n} long" for n in names), lambda: run)


def _without(value: Column, p: int) -> Column:
    """``value`` with bit ``p`` taken out."""
    high = F.shiftleft(F.shiftrightunsigned(value, p + 1), p)
    return high.bitwiseOR(value.bitwiseAND(F.lit((1 << p) - 1).cast("long")))


def _variants(value: Column, bits: int, tag: int) -> list[Column]:
    """Keys of a segment of ``bits`` bits: the segment's tag, the bit taken out, the rest."""
    return [F.lit(tag * 64 + p << 32).cast("long").bitwiseOR(_without(value, p)) for p in range(bits)]


def _part(value: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _meet(rows: DataFrame, most: int | None, bits: int) -> DataFrame:
    """Rows (key, fp), each pair distinct, to links and hot rows: (hot boolean, a, b), a link
    of fingerprints a and b, or for a key of over ``most`` rows the row (key a, fingerprint b).

    Equal keys come together sorted, so one pass with bounded memory is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """New links among rows in which equal keys are neighbours."""
            us, vs = [], []
            d = 1
            rows = np.arange(len(key) - 1)
            while len(rows):
                rows = rows[rows + d < len(key)]
                rows = rows[key[rows] == key[rows + d]]
                near = rows[np.bitwise_count((fp[rows] ^ fp[rows + d]).view(np.uint64)) <= bits]
                for a, b in zip(fp[near].tolist(), fp[near + d].tolist()):
                    x, y = root(a), root(b)
                    if x != y:
                        parent[x] = y
                        us.append(a), vs.append(b)
                d += 1
            if len(parent) > FOREST:
                parent.clear()
            return np.array(us, np.int64), np.array(vs, np.int64)

        def out(hot: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["hot", "a", "b"])

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        streaming = None  # the key whose rows pass as hot
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if streaming is not None:
                n = int(np.searchsorted(k, streaming, "right"))
                if n:
                    yield out(True, k[:n], f[:n])
                if n == len(k):
                    continue
                k, f, streaming = k[n:], f[n:], None
            key, fp = np.concatenate((key, k)), np.concatenate((fp, f))
            if not len(key):
                continue
            # the last key may go on in the next batch
            tail = int(np.searchsorted(key, key[-1], "left"))
            for part in _runs(key[:tail], fp[:tail], most):
                a, b = part[1:] if part[0] else links(*part[1:])
                if len(a):
                    yield out(part[0], a, b)
            key, fp = key[tail:], fp[tail:]
            if most is not None and len(key) > most:
                yield out(True, key, fp)
                streaming, key, fp = int(key[0]), key[:0], fp[:0]
        if len(key):
            a, b = links(key, fp)
            if len(a):
                yield out(False, a, b)

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "hot boolean, a long, b long")


def _runs(key: np.ndarray, fp: np.ndarray, most: int | None) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Rows of keys with two rows or more; (True, ...) with those of over ``most``."""
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    count = np.repeat(size, size)
    big = count > most if most is not None else np.zeros(len(key), bool)
    if big.any():
        yield True, key[big], fp[big]
    rest = (count > 1) & ~big
    if rest.any():
        yield False, key[rest], fp[rest]


def _parts(width: int, bits: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the fewest segments of which one differs by at most one bit."""
    n = bits // 2 + 1
    size = -(-width // n)
    return [(low, min(size, width - low)) for low in range(0, width, size)]


def _left(value: Column, low: int, size: int) -> Column:
    """``value`` without the ``size`` bits from ``low``."""
    high = F.shiftleft(F.shiftrightunsigned(value, low + size), low) if low + size < 64 else F.lit(0).cast("long")
    return high.bitwiseOR(_part(value, 0, low)) if low else high


def _thinned(found: DataFrame) -> DataFrame:
    """Links (a, b) without those that others make up for: tasks that each left a spanning forest
    meet, a sixteenth as many, and leave one between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[y] = x
                    kept.append((a, b))
            if len(parent) > FOREST:
                parent.clear()
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["a", "b"])

    tasks = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // 16)
    return found.select("a", "b").repartition(tasks, "a").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (``fp``) to links (a, b) that connect what lies within reach."""
    return _thinned(_links(nodes, bits))


def _links(nodes: DataFrame, bits: int) -> DataFrame:
    fp = F.col("fp")
    parts = _parts(64, bits)
    first = nodes.select(F.explode(F.array(*[v for k, (low, size) in enumerate(parts) for v in _variants(_part(fp, low, size), size, k)])).alias("key"), "fp")
    met = materialize(_meet(first, HOT_RUN, bits), "links")
    found = met.where("not hot").select("a", "b")
    hot = met.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return found
    # what a key leaves open: all but the segment that is named in it
    named = F.shiftright("key", 38)
    rest = F.coalesce(*[F.when(named == k, _left(fp, low, size)) for k, (low, size) in enumerate(parts)])
    rows, width = hot.select("key", rest.alias("rest"), "fp"), 64 - min(size for _, size in parts)
    while True:
        below = _parts(width, bits)
        one = lambda k, low, size: [F.struct(v.alias("sub"), _left(F.col("rest"), low, size).alias("rest")) for v in _variants(_part(F.col("rest"), low, size), size, k)]  # noqa: B023, E731
        again = rows.select("key", "fp", F.explode(F.array(*[x for k, (low, size) in enumerate(below) for x in one(k, low, size)])).alias("s"))
        rows = again.select(F.xxhash64("key", "s.sub").alias("key"), "s.rest", "fp")
        width -= min(size for _, size in below)
        last = width <= OPEN
        met = materialize(_meet(rows.select("key", "fp").distinct(), None if last else HOT_RUN, bits), "links")
        found = found.unionByName(met.where("not hot").select("a", "b"))
        still = met.where("hot").select(F.col("a").alias("key")).distinct()
        if last or still.isEmpty():
            return found
        rows = rows.join(still, "key", "left_semi")


def groups(prints: DataFrame, *, id_col: str = "doc_id", bits: int = MAX_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``fp``, ``component_id`` for every distinct fingerprint of ``prints`` (id, fp): the
    smallest id reachable over links. ``keep``: ``component`` adds the component itself, which
    is never null (one of its fingerprints)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "nodes")
    # fingerprints of rows without id still connect others, so the nodes are the fingerprints
    comp = connected_components(links(nodes, bits).select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = nodes.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left")
    joined = joined.select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    joined = materialize(joined, "members")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    return materialize(joined.join(least, "component").select("fp", "component_id", *keep), "classes")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, a row for
    each row of ``df``."""
    prints = materialize(fingerprint_column(df, id_col=id_col, text_col=text_col, words=words), "prints")
    out = prints.join(groups(prints, id_col=id_col), "fp")
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(prints: DataFrame, names: list[str], bits: int) -> DataFrame:
    """``prints`` (id and the fingerprints ``names``) to ``node``, a number for each distinct row of
    fingerprints, ``component`` and ``component_id``, the smallest id in it. Rows are linked where
    any fingerprint lies within reach; rows that share one meet at the least of them."""
    node = F.xxhash64(*names)
    nodes = materialize(prints.groupBy(*names).agg(F.min("id").alias("rep")).withColumn("node", node), "nodes")
    edges = []
    for name in names:
        leads = nodes.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("lead"))
        lead = materialize(leads, "leads")
        of = lambda end: lead.select(F.col("fp").alias(end), F.col("lead").alias("lead_" + end))  # noqa: B023, E731
        edges.append(nodes.join(lead, nodes[name] == lead["fp"]).where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")))
        near = materialize(links(lead.select("fp"), bits), "near")
        edges.append(near.join(of("a"), "a").join(of("b"), "b").select(F.col("lead_a").alias("u"), F.col("lead_b").alias("v")))
    comp = connected_components(reduce(DataFrame.unionByName, edges))
    joined = nodes.select("node", "rep").join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    joined = materialize(joined, "members")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    return materialize(joined.join(least, "component").select("node", "component", "component_id"), "classes")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = MAX_BITS, prints: int = 1) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component, linked at ``bits`` or fewer bits in
    any of ``prints`` fingerprints; of rows that repeat that id within the component, one stays. Rows with a null id stay only if no other row is in reach.
    Ids may be of any type that has an order; all columns are carried in a struct, so that their
    names cannot clash with ours, and are not touched."""
    src = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    names = ["fp", *[f"fp{k}" for k in range(1, prints)]]
    found = materialize(fingerprint_column(src, text_col="text", words=words, prints=prints, keep=["id", "key"]), "prints")
    if prints == 1:
        judged = found.join(groups(found, id_col="id", bits=bits, keep=("component",)), "fp")
    else:
        judged = found.withColumn("node", F.xxhash64(*names)).join(similar(found, names, bits), "node")
    # one (id, text) for each component; its copies are folded before they are shuffled
    best = judged.where(F.col("id").eqNullSafe(F.col("component_id")))
    best = best.groupBy("component", "id").agg(F.min("key").alias("key")).select(F.col("id").alias("best_id"), F.col("key").alias("best_key"))
    kept = src.join(best, (F.col("key") == F.col("best_key")) & F.col("id").eqNullSafe(F.col("best_id")))
    # one id can be best in several components; what repeats id and text is one row
    return kept.dropDuplicates(["id", "key"]).select("row.*")
