"""Substring dedup (operator 10): count-min prefilter, then an exact second pass.

Method: a window is ``WINDOW`` consecutive words. Every window holds one anchor, the run of
``ANCHOR`` words with the least hash in it, and equal windows have equal anchors at different
places. A count-min sketch of the anchors (two rows of cells that saturate at two) therefore
never underestimates how often a window occurs. Each task fills sketches of its own; they are
merged cell range by cell range, not on the driver. The second pass groups exactly, by 128
bits of hash made of two unlike hashes of each word, only windows whose anchor is estimated
repeated: none is lost.

Sizes: the cells grow with the input (``CELLS`` for each expected anchor), without a bound. Up
to ``MAX_BITS`` the bit map of cells that saturate is broadcast (``2 * 2**MAX_BITS / 8`` bytes at
most); a larger one stays where it was merged, and the anchors come to it by two equality
joins. The result is the same.

Skew: of equal windows within one chunk of rows only the first is shuffled, the others are
known to be repeats at once; of chunks of one task only those go on that come before what went
on already. So a passage in a third of all documents reaches its group with a few rows for each
task, not with one for each document. The first place of a group is found in one sorted pass.

Defined cases: null, empty and blank texts have no words; texts of fewer than ``WINDOW`` words
have no window; rows that repeat a doc_id with the same text are one document, each returned
alike; rows that repeat a doc_id with another text are judged as documents of their own, at
the same place in the order, told apart by 64 bits of hash; a null id comes before all others;
ids of any type that has an order will do; an empty table gives an empty table; other columns
are carried in a struct, so that their names cannot clash with ours, and are not touched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructField, StructType

from ._cache import Memo
from ._spark import chunks, materialize, small_batches

WINDOW, ANCHOR = 20, 10
#: Cells of a sketch row for each expected anchor, the least bits of a cell number, and the most
#: of a sketch that is broadcast.
CELLS, MIN_BITS, MAX_BITS = 4, 16, 27
#: Bits of a cell number within one range of a sketch row.
RANGE_BITS = 18
#: Bits of a slot number of ids; at most this many slots are broadcast.
SLOT_BITS = 18
#: Characters of text whose windows are judged at one time in the second pass.
PASS_CHARS = 1 << 20
#: Windows that a task remembers to have sent on; it starts anew when full, which only sends more.
SENT = 200_000

_split = re.compile(rb"[^\x20\x09-\x0D]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(a: np.ndarray, b: np.ndarray, salt: np.uint64) -> np.ndarray:
    h = (a ^ salt) * _M1 + (b ^ (a >> np.uint64(29))) * _M2
    h ^= h >> np.uint64(32)
    h *= _M3
    return h ^ (h >> np.uint64(29))


def _runs(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours, put together from runs of powers of two."""
    s = np.uint64(salt)
    size, part, out, done = 1, h, None, 0
    while True:
        if n & size:
            out = part if out is None else _mix(out[: len(part) - done], part[done:], s)
            done += size
        size *= 2
        if size > n:
            return out
        part = _mix(part[: len(part) - size // 2], part[size // 2 :], s)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all runs of ``n`` neighbours."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Hasher:
    """Two unlike hashes of each word of texts laid end to end."""

    def __init__(self):
        digest = xxhash.xxh3_128_digest
        self.memo = Memo(digest, 100_000)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of all words, and the number of words of each text."""
        get, parts, count = self.memo.__getitem__, [], []
        for t in texts:
            w = t.encode().split() if t else []
            count.append(len(w))
            parts += map(get, w)
        both = np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), np.array(count, np.int64)


def _valid(count: np.ndarray, total: int) -> np.ndarray:
    """Which words start a window within their text."""
    ends = np.repeat(np.cumsum(count), count)
    return np.arange(total) + WINDOW <= ends


def _anchors(h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each word (all ones: no window), and the hash of the run
    at each word that is some window's anchor (all ones elsewhere)."""
    n = len(h)
    low, mine = np.full(n, _NONE), np.full(n, _NONE)
    if n < WINDOW:
        return low, mine
    run = _runs(h, ANCHOR, 1)
    span = WINDOW - ANCHOR + 1
    low[: n - WINDOW + 1] = _least(run, span)
    low[~valid] = _NONE
    # a run is an anchor if a window around it has it as its least
    over = np.where(valid, low, np.uint64(0))
    most = ~_least(~np.concatenate((np.zeros(span - 1, np.uint64), over[: len(run)])), span)
    chosen = (most == run) & (most > 0)
    mine[: len(run)][chosen] = run[chosen]
    return low, mine


def _cells(anchor: np.ndarray, bits: int, row: int) -> np.ndarray:
    h = anchor * (_M1 if row == 0 else _M2)
    return (h ^ (h >> np.uint64(31))) * _M3 >> np.uint64(64 - bits)


def _pack(cells: np.ndarray) -> bytes:
    return cells.astype("<u4").tobytes()


def sketch(df: DataFrame, text_col: str, bits: int) -> DataFrame:
    """Partition sketches merged by cell range: (part, full binary), for the ranges that have
    one the bits of cells that were hit twice or more. ``part``: sketch row and range."""
    low_bits = min(bits, RANGE_BITS)
    ranges = 1 << (bits - low_bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def flush():
            flat = np.concatenate(held)
            for row in (0, 1):
                cells, hits = np.unique(_cells(flat, bits, row), return_counts=True)
                part = (cells >> np.uint64(low_bits)).astype(np.int64)
                cell = cells & np.uint64((1 << low_bits) - 1)
                edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)]):
                    one = hits[a:b] == 1
                    yield row * ranges + int(part[a]), _pack(cell[a:b][one]), _pack(cell[a:b][~one])

        def batch_of(rows):
            rows = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "once", "more"])

        for batch in batches:
            texts = batch.column(0)
            for a, b in chunks([x or 0 for x in pa.compute.binary_length(texts).to_pylist()]):
                h, _, count = hasher.words(texts.slice(a, b - a).to_pylist())
                _, mine = _anchors(h, _valid(count, len(h)))
                mine = mine[mine != _NONE]
                if len(mine):
                    held.append(mine)
                    size += len(mine)
                if size > 1_000_000:
                    yield batch_of(flush())
                    held, size = [], 0
        if held:
            yield batch_of(flush())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # parts come one after the other; one pair of bit maps is held
        part, once, full = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(full).tobytes()], pa.binary())], names=["part", "full"])

        for batch in batches:
            for p, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if p != part:
                    if part is not None and full.any():
                        yield done()
                    part, once, full = p, np.zeros(1 << low_bits, bool), np.zeros(1 << low_bits, bool)
                cells = np.frombuffer(a.as_buffer(), "<u4")
                full[cells[once[cells]]] = True
                once[cells] = True
                cells = np.frombuffer(b.as_buffer(), "<u4")
                full[cells] = True
                once[cells] = True
        if part is not None and full.any():
            yield done()

    import pyarrow.compute  # noqa: F401  (pa.compute)

    filled = df.select(text_col).mapInArrow(fill, "part int, once binary, more binary")
    return filled.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, full binary")


class Estimate:
    """The cells that were hit twice or more, in both sketch rows."""

    def __init__(self, bits: int, parts: list[tuple[int, bytes]]):
        self.bits = bits
        size = (1 << min(bits, RANGE_BITS)) // 8
        self.full = np.zeros((2, (1 << bits) // 8), np.uint8)
        flat = self.full.reshape(-1)
        for part, got in parts:
            flat[part * size : (part + 1) * size] = np.frombuffer(got, np.uint8)

    def repeated(self, anchor: np.ndarray) -> np.ndarray:
        out = anchor != _NONE
        for row in (0, 1):
            c = _cells(anchor, self.bits, row)
            out &= (self.full[row][c >> np.uint64(3)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return out


def _packed(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The first row of each document of rows sorted by document, and each one's starts as
    little-endian int32."""
    edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    offsets = np.append(edge, len(doc)) * 4
    data = pa.py_buffer(start.astype("<i4").tobytes())
    return edge, pa.Array.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), data]).cast(pa.binary())


def _full_cells(parts: DataFrame, bits: int, row: int) -> DataFrame:
    """``cell``: the cells of a sketch row that were hit twice or more, where they were merged."""
    low_bits = min(bits, RANGE_BITS)
    ranges = 1 << (bits - low_bits)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, full in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = np.flatnonzero(np.unpackbits(np.frombuffer(full.as_buffer(), np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(cells + ((part - row * ranges) << low_bits))], names=["cell"])

    mine = parts.where((F.col("part") >= row * ranges) & (F.col("part") < (row + 1) * ranges))
    return mine.mapInArrow(spell, "cell long")


def _met(keyed: DataFrame, parts: DataFrame, bits: int) -> DataFrame:
    """``keyed`` rows with an anchor that is estimated repeated, and ``anchors``, the list of those.
    Anchors go to the cells by equality joins, which adaptive execution splits at hot cells."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for a, b in chunks([x or 0 for x in pa.compute.binary_length(batch.column(2)).to_pylist()]):
                h, _, count = hasher.words(batch.column(2).slice(a, b - a).to_pylist())
                _, mine = _anchors(h, _valid(count, len(h)))
                at = np.flatnonzero(mine != _NONE)
                doc = np.repeat(np.arange(len(count)), count)[at]
                cells = [pa.array(_cells(mine[at], bits, row).astype(np.int64)) for row in (0, 1)]
                own = [pa.array(batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False)[doc]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(mine[at].view(np.int64)), *cells], names=["place", "key", "anchor", "c0", "c1"])

    import pyarrow.compute  # noqa: F401  (pa.compute)

    rows = keyed.select("place", "key", "text").mapInArrow(spell, "place long, key long, anchor long, c0 long, c1 long").distinct()
    for row in (0, 1):
        rows = rows.join(_full_cells(parts, bits, row).withColumnRenamed("cell", f"c{row}"), f"c{row}", "left_semi")
    lists = rows.groupBy("place", "key").agg(F.collect_set("anchor").alias("anchors"))
    return keyed.join(lists, ["place", "key"])


class _Sent:
    """What a task has sent on of windows that it met twice: the earliest place of each."""

    def __init__(self):
        self.first: dict[int, tuple[int, int, int]] = {}

    def later(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, place: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """Which rows come after the place that was sent. ``twice``: those to remember."""
        out = np.zeros(len(h1), bool)
        known = self.first
        rows = list(zip(h1.tolist(), h2.tolist(), ids.tolist(), place.tolist()))
        for k, (a, b, i, p) in enumerate(rows):
            seen = known.get(a)
            if seen is None or seen[0] != b:
                if twice[k]:
                    known[a] = (b, i, p)
            elif (i, p) > seen[1:]:
                out[k] = True
            else:
                known[a] = (b, i, p)
        if len(known) > SENT:
            known.clear()
        return out


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """``place``, ``key`` and ``start``: the word at which a window starts that also starts earlier;
    a row for each. ``keyed``: as ``_keyed``."""
    small_batches(keyed.sparkSession)
    # words have six bytes or so, and an anchor comes every sixth word
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(max(np.ceil(np.log2(max(1, total / 36 * CELLS))), MIN_BITS))
    parts = sketch(keyed, "text", bits)
    rows = keyed.select("place", "key", "named", "text", F.lit(None).cast("array<bigint>").alias("anchors"))
    guess = None
    if bits <= MAX_BITS:
        guess = keyed.sparkSession.sparkContext.broadcast(Estimate(bits, [(r[0], bytes(r[1])) for r in parts.collect()]))
    else:
        rows = _met(keyed.select("place", "key", "named", "text"), materialize(parts, "sketch"), bits).select(*rows.columns)
    # the spot packs start, and above it whether there is an id: rows without come first
    out_schema = "h1 long, h2 long, place long, spot long, key long, starts binary"
    names = ["h1", "h2", "place", "spot", "key", "starts"]
    done_names = ["place", "key", "start"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sent = Hasher(), _Sent()
        for batch in batches:
            texts = batch.column(3)
            for a, b in chunks([x or 0 for x in pa.compute.binary_length(texts).to_pylist()], PASS_CHARS):
                h, g, count = hasher.words(texts.slice(a, b - a).to_pylist())
                valid = _valid(count, len(h))
                low, _ = _anchors(h, valid)
                if guess is not None:
                    at = np.flatnonzero(guess.value.repeated(low))
                else:
                    known = np.unique(batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
                    at = np.flatnonzero(valid & np.isin(low, known))
                if not len(at):
                    continue
                h1, h2 = _runs(h, WINDOW, 2)[at].view(np.int64), _runs(g, WINDOW, 3)[at].view(np.int64)
                begin = np.concatenate(([0], np.cumsum(count)[:-1]))
                doc = np.repeat(np.arange(len(count)), count)[at]
                start = at - begin[doc]
                ids, text, named = (batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                # equal ids have equal ranks: rows of one place in the order
                rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) * 2 + named
                when = rank[doc] << 32 | start
                order = np.lexsort((when, h2, h1))
                o1, o2, ow = h1[order], h2[order], when[order]
                later = np.concatenate(([False], (o1[1:] == o1[:-1]) & (o2[1:] == o2[:-1])))
                first = np.maximum.accumulate(np.where(later, 0, np.arange(len(order))))
                # the first of equal windows goes on, with rows at its very place; the others are repeats
                known = later & (ow != ow[first])
                size = np.bincount(first, minlength=len(order))
                send, twice = order[~known], size[first][~known] > 1
                own, spot = doc[send], named[doc[send]] << 32 | start[send]
                gone = sent.later(h1[send], h2[send], ids[own], spot, twice)
                got = np.sort(np.concatenate((order[known], send[gone])))
                send, own, spot = send[~gone], own[~gone], spot[~gone]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (h1[send], h2[send], ids[own], spot, text[own])), pa.nulls(len(send), pa.binary())], names=names)
                if len(got):
                    edge, starts = _packed(doc[got], start[got])
                    own = doc[got][edge]
                    cols = [ids[own] * 31 + text[own], np.zeros(len(own), np.int64), ids[own], np.zeros(len(own), np.int64), text[own]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), starts], names=names)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by window and place; all but the first place of a window are repeats
        last = None
        for batch in batches:
            ready = batch.column(5).is_valid()
            whole = ready.to_numpy(zero_copy_only=False)
            if whole.any():
                own = batch.filter(ready)
                size = pa.compute.binary_length(own.column(5)).to_numpy() // 4
                ids, text = (np.repeat(own.column(k).to_numpy(), size) for k in (2, 4))
                start = np.frombuffer(b"".join(own.column(5).to_pylist()), "<i4")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(text), pa.array(start)], names=done_names)
            rows = np.flatnonzero(~whole)
            if not len(rows):
                continue
            h1, h2, ids, place, text = (batch.column(k).to_numpy(zero_copy_only=False)[rows] for k in range(5))
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            if last is not None and (h1[0], h2[0]) == last[:2]:
                new[0] = False
            lead = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
            f_id, f_place = ids[np.maximum(lead, 0)], place[np.maximum(lead, 0)]
            if last is not None:
                f_id, f_place = np.where(lead < 0, last[2], f_id), np.where(lead < 0, last[3], f_place)
            last = (h1[-1], h2[-1], f_id[-1], f_place[-1])
            got = (ids != f_id) | (place != f_place)
            if got.any():
                cols = [ids[got], text[got], (place[got] & 0xFFFFFFFF).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=done_names)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    spread = rows.mapInArrow(windows, out_schema)
    spread = spread.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "place", "spot")
    return spread.mapInArrow(later, "place long, key long, start int")


def _slot(place: Column) -> Column:
    return F.pmod(F.xxhash64(place), F.lit(1 << SLOT_BITS))


def _keyed(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``row`` (the ``keep`` columns), ``text``, ``place`` of the document in the order (no id: before
    all others), ``named`` (1: has an id), and ``key``, which tells rows of one id apart: 64 bits
    of the text and of whether there is an id, or 0 for an id that needs none, to keep the shuffle small."""
    src = df.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = F.col("id").cast("long")
    if not isinstance(src.schema["id"].dataType, IntegralType):
        # numbers in the order of the ids
        order = src.select("id").where("id is not null").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("at"))
        src, place = src.join(materialize(order, "order"), "id", "left"), F.col("at")
    src = src.select("row", "text", F.coalesce(place, F.lit(-(1 << 63))).alias("place"), F.col("id").isNotNull().cast("long").alias("named"))
    whole = F.xxhash64("text", F.col("named") == 0)
    # slots of the ids that stand on unlike rows; other ids may fall into them too
    unlike = src.groupBy("place").agg(F.min(whole).alias("a"), F.max(whole).alias("b")).where("a <> b")
    slots = materialize(unlike.select(_slot(F.col("place")).alias("slot")).distinct(), "slots").withColumn("shared", F.lit(True))
    tagged = src.withColumn("slot", _slot(F.col("place"))).join(F.broadcast(slots), "slot", "left")
    return tagged.select("row", "text", "place", "named", F.when(F.col("shared"), whole).otherwise(F.lit(0)).cast("long").alias("key"))


def covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    """Which words stand in a window that starts at one of ``starts``."""
    begun = np.bincount(starts, minlength=n_words)[:n_words] > 0
    step = np.cumsum(begun)
    step[WINDOW:] -= step[:-WINDOW].copy()
    return step > 0


def _map_judged(df: DataFrame, id_col: str, text_col: str, keep: list[str], schema: str, fn) -> DataFrame:
    """The ``keep`` columns and the columns of ``schema`` that ``fn`` makes of each text and the
    starts of its repeated windows."""
    keyed = _keyed(df, id_col, text_col, keep)
    found = repeated_windows(keyed)
    runs = materialize(found.groupBy("place", "key").agg(F.collect_list("start").alias("runs")), "runs")
    src = keyed.join(runs, ["place", "key"], "left").select("row", "text", "runs")
    added = StructType.fromDDL(schema)
    out = StructType([src.schema["row"], StructField("got", added)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks([x or 0 for x in pa.compute.binary_length(batch.column(1)).to_pylist()]):
                texts, lists = batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a)
                size = lists.value_lengths().fill_null(0).to_numpy()
                runs = np.split(lists.flatten().to_numpy(), np.cumsum(size)[:-1])
                rows = [fn(t, r) for t, r in zip(texts, runs)]
                kind = arrow.field(1).type
                got = pa.StructArray.from_arrays([pa.array([r[j] for r in rows], kind.field(j).type) for j in range(kind.num_fields)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), got], schema=arrow)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    return src.mapInArrow(run, out)


def dedup_digest(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` (long) and ``kept_sha256`` (kept words joined by
    one space), a row for each row of ``df``."""

    def one(text, runs):
        words = text.encode().split() if text else []
        if len(runs):
            gone = covered(len(words), runs)
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
        else:
            kept = words
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _map_judged(df, id_col, text_col, [id_col], "n_words long, n_removed long, kept_sha256 string", one).select("row.*", "got.*")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the repeated words taken out of its text. Untouched stretches keep their own
    white space; texts without a repeat stay as they are. Other columns and their order stay."""

    def one(text, runs):
        if not len(runs):
            return (text,)
        raw = text.encode()
        spans = [m.span() for m in _split.finditer(raw)]
        gone = covered(len(spans), runs).tolist()
        out, at = [], 0
        for (a, b), g in zip(spans, gone):
            out.append(raw[at:a] if not g else b"")
            out.append(b"" if g else raw[a:b])
            at = b
        return (b"".join([*out, raw[at:]]).strip().decode(),)

    others = [c for c in df.columns if c != text_col]
    done = _map_judged(df, id_col, text_col, others, "text string", one)
    return done.select(*[F.col("got.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
