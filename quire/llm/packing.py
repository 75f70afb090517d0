"""Best-fit packing (operator 2): variable-capacity best fit.

Method: the pieces of a shard are placed in falling order of length. A piece goes into the
open bin in which it leaves least room. If none has room, a bin is opened, and the permitted
lengths are weighed jointly: of those that hold the piece, the one whose cost for each byte
that it will hold is least, when what is still unplaced fills it up. At the end each bin is
downsized to the smallest permitted length that holds its contents.

Lengths are UTF-8 bytes and one end mark for each document (a byte-level model's tokens; give
``length`` for another unit). A document over the largest length is cut into pieces of that
length, and a rest; nothing is dropped or truncated.

Scale: only ids and lengths are shuffled, never texts. Shards are picked by a hash of the piece
and hold ``SHARD`` pieces on average, so a shard is bounded whatever the input is, and a bin is
the shard's own. What sharding costs is a few half-filled bins in each. Rows that repeat are
counted before they are shuffled and dealt out to shards ``COPIES`` at a time, so one row in a
third of a table does not fill a shard.

Defined cases: null and empty texts have the end mark only; equal lengths go by id, then by
piece; rows that repeat an id are packed each on their own; an empty table gives an empty
table; a null id is packed like any other; other columns are not touched.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialize

#: Permitted sequence lengths.
CAPACITIES = (1024, 2048, 4096, 8192, 16384)
#: Pieces of a shard, on average, and the most equal ones that go to one shard together.
SHARD, COPIES = 4096, 64


def sequence_cost(capacity: int) -> float:
    """The default cost of a sequence: linear work, a little that grows with its square (the
    attention), and a fixed part."""
    return 64.0 + capacity + capacity * capacity / 65536


def pack(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int]]:
    """Bin number of each length, and the final capacity of each bin. Lengths are at most the
    largest capacity; they are taken in falling order, equal ones as they come."""
    caps = sorted(set(capacities))
    price = [cost(c) for c in caps]
    unplaced = sum(lengths)
    bin_of = [0] * len(lengths)
    room: list[int] = []
    open_: list[tuple[int, int]] = []  # (room, bin), rising
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(open_, (n, -1))
        if at < len(open_):
            left, b = open_.pop(at)
        else:
            fits = range(bisect_left(caps, n), len(caps))
            best = min(fits, key=lambda c: (price[c] / min(caps[c], unplaced), caps[c]))
            left, b = caps[best], len(room)
            room.append(caps[best])
        bin_of[i] = b
        unplaced -= n
        room[b] = left - n
        if room[b]:
            insort(open_, (room[b], b))
    used = [0] * len(room)
    for i, b in enumerate(bin_of):
        used[b] += lengths[i]
    return bin_of, [caps[bisect_left(caps, u)] for u in used]


def pack_documents(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    length: Column | None = None,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """A row for each piece: ``id_col``, ``piece`` (from 0), ``piece_start`` and
    ``piece_length`` (in units of length), ``bin_id`` (shard:number), ``bin_offset`` and
    ``bin_capacity``."""
    most = max(capacities)
    own = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1 if length is None else length.cast("long")
    rows = df.select(F.col(id_col).alias("id"), own.alias("n"), F.xxhash64(id_col, text_col).alias("h"))
    sizes = materialize(rows.groupBy("id", "n", "h").agg(F.count("*").alias("copies")), "lengths")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    shards = max(1, -(-(sizes.agg(F.sum(F.col("copies") * parts)).first()[0] or 0) // SHARD))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(most).cast("long"))
    deal = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    pieces = sizes.select("id", "n", "h", "copies", F.posexplode(cut).alias("piece", "piece_start")).select("*", deal.alias("hand"))
    pieces = pieces.withColumn("piece_length", F.least(F.col("n") - F.col("piece_start"), F.lit(most)))
    pieces = pieces.withColumn("copies", F.least(F.col("copies") - F.col("hand") * COPIES, F.lit(COPIES)))
    # pieces of one document may part, so a very long one does not fill a shard
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("h", "piece", "hand"), F.lit(shards)))
    kind = sizes.schema["id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.loc[rows.index.repeat(rows["copies"])].sort_values(["id", "piece", "h"], kind="stable", ignore_index=True)
        bins, caps = pack(rows["piece_length"].tolist(), capacities, cost)
        rows["bin"] = bins
        rows["bin_offset"] = rows.groupby("bin")["piece_length"].cumsum() - rows["piece_length"]
        rows["bin_id"] = [f"{s}:{b}" for s, b in zip(rows["shard"], bins)]
        rows["bin_capacity"] = [caps[b] for b in bins]
        return rows[["id", "piece", "piece_start", "piece_length", "bin_id", "bin_offset", "bin_capacity"]]

    schema = f"id {kind}, piece int, piece_start long, piece_length long, bin_id string, bin_offset long, bin_capacity long"
    out = pieces.select("id", "piece", "piece_start", "piece_length", "shard", "h", "copies").groupBy("shard").applyInPandas(run, schema)
    return out.withColumnRenamed("id", id_col)
