"""Exact top-k search (operator 9): exhaustive term-at-a-time accumulation.

Method: vectors are sparse rows of integer weights (dimensions are the terms). Candidates and
queries are cut into blocks; for each pair of blocks the candidates' weights are kept as
postings, and every query adds, term by term, its weight times the postings into a dense
array of scores. A partition selection keeps the k best of the block, and the partial lists
of a query are merged.

Scale: the query set is stated, and all of it meets all rows in blocks. A task holds one block
of each side; what is shuffled is each row once for each block of the other side, and k rows
for each query and candidate block, merged with a limit below the shuffle.

Defined cases: vectors that are null or hold a null or a component that is not finite take no
part, nor do rows with a null id; an empty vector scores 0 with every other; dimensions that
one of two vectors lacks count as 0; a query does not meet rows of its own id; rows that
repeat an id count as one, with the least of their vectors; ties go to the smaller id; an
empty table gives an empty table; other columns are not touched. Weights whose products could
pass 64 bits are accumulated as unbounded integers; a score over 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 8192, 1024
#: Blocks that a smaller table is still cut into.
LEAST_BLOCKS = 6


def quantise(vector: np.ndarray, scale: int) -> list[int] | np.ndarray:
    """floor(scale * x) of each component, as integers."""
    x = np.floor(np.asarray(vector, np.float64) * scale)
    return x.astype(np.int64) if not len(x) or np.abs(x).max() < 2**62 else np.array([int(v) for v in x], object)


class Postings:
    """For each term the rows that have it, and their weights."""

    def __init__(self, vectors: list[np.ndarray], kind):
        self.rows = len(vectors)
        self.kind = kind
        width = max((len(v) for v in vectors), default=0)
        size = {len(v) for v in vectors}
        if size == {width}:
            table = np.array(vectors, kind).reshape(self.rows, width)
        else:
            table = np.zeros((self.rows, width), kind)
            for i, v in enumerate(vectors):
                table[i, : len(v)] = v
        self.terms = []
        for column in table.T:
            rows = np.flatnonzero(column)
            # a term that most rows have is kept for all of them, in place
            self.terms.append((None, column.copy()) if 2 * len(rows) > self.rows else (rows, column[rows]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        acc = np.zeros(self.rows, self.kind)
        for (rows, weights), w in zip(self.terms, query.tolist()):
            if w:
                if rows is None:
                    acc += weights * self.kind(w) if self.kind is not object else weights * w
                else:
                    acc[rows] += weights * w
        return acc


def block_top(q_ids: list[int], queries: list, c_ids: np.ndarray, candidates: list, k: int, scale: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of a block for each query.
    ``c_ids`` rises, so that equal scores leave the smaller ids first."""
    qs, cs = [quantise(v, scale) for v in queries], [quantise(v, scale) for v in candidates]
    top = lambda vs: max((int(abs(v).max()) for v in vs if len(v)), default=0)
    bound = top(qs) * top(cs) * max((len(v) for v in cs), default=0)
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    post = Postings(cs, kind)
    out = []
    for qid, q in zip(q_ids, qs):
        acc = post.scores(q)
        own = int(np.searchsorted(c_ids, qid))
        has = own < len(c_ids) and c_ids[own] == qid
        want = k + has
        if len(acc) > want:
            edge = np.partition(acc, len(acc) - want)[len(acc) - want]
            pick = np.flatnonzero(acc > edge)
            level = np.flatnonzero(acc == edge)
            pick = np.concatenate((pick, level[: want - len(pick) + has]))
        else:
            pick = np.arange(len(acc))
        if has:
            pick = pick[pick != own]
        order = pick[np.lexsort((pick, [-int(s) for s in acc[pick]]))][:k] if kind is object else pick[np.lexsort((pick, -acc[pick].astype(np.int64)))][:k]
        out += [(qid, int(c_ids[i]), int(acc[i])) for i in order]
    return out


def _usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def top_k(df: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each row that ``is_query``
    picks, the k other rows with the highest integer inner product."""
    rows = df.where(F.col(id_col).isNotNull() & _usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks = max(-(-n // CANDIDATES), min(LEAST_BLOCKS, -(-n // 512)), 1)
    sets = max(-(-nq // QUERIES), 1)
    place = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cand = rows.select("id", "v", place(blocks, 1).alias("b"), every(sets).alias("s"))
    query = rows.where("q").select("id", "v", place(sets, 2).alias("s"), every(blocks).alias("b"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id", kind="stable")
        got = block_top(left["id"].tolist(), left["v"].tolist(), right["id"].to_numpy(np.int64), right["v"].tolist(), k, scale)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype("int64")

    part = query.groupBy("b", "s").cogroup(cand.groupBy("b", "s")).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
