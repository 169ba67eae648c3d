"""Exact top-k search by MaxScore over sharded postings.

Every component is a term; a vector's integer weight under the term is its posting. Vectors and queries are dealt to a grid
of cells of bounded size (a shard of vectors by a block of queries). In a cell a query bounds what each term can add, from
the term's largest and smallest weight in the shard, and terms stand by the width of that range. Non-essential are the most
terms, from the narrowest on, with which a vector that gets the least of all others still cannot beat the k-th best score;
the rest are essential. Essential postings are traversed for all vectors; the others are probed, widest range first, only
while a vector can still compete. The k-th score is that of the cell so far, or of the first shard if that is higher: the
first shard is searched before the others and its k-th scores go with the queries. Cells' best k are merged by query.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; an empty vector
scores 0 with all; of vectors of different lengths the missing components count as 0; equal scores rank by the smaller id;
rows repeated with one id are candidates one by one and never of a query with that id; a repeated query is one query, by its
first vector in order of components, however queries are dealt; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialise

SHARD_ROWS = 4096
QUERY_ROWS = 2048
#: Vectors of a shard that are scored at once, at first; each further step takes four times as many.
BLOCK = 256
#: Non-essential terms that are probed at once.
PROBE = 8

HITS = "query_id long, vec_id long, score long"


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), object if any(abs(x) >= 1 << 62 for v in lists for x in v) else np.int64)
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def essential_terms(low: np.ndarray, high: np.ndarray, floor: int) -> int:
    """How many leading terms are essential: the fewest for which the least of theirs and the most of all others together do
    not beat the floor."""
    least = np.concatenate([[0], np.cumsum(low)])
    most = np.concatenate([np.cumsum(high[::-1])[::-1], [0]])
    fails = np.flatnonzero(least + most <= floor)
    return int(fails[0]) if len(fails) else len(low)


def cell_top_k(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int, known: int | None = None) -> list[tuple[int, int]]:
    """(score, id) of the best k rows but the query's own, fewer where ``known``, a k-th score found elsewhere, is higher; ids
    ascend, so of equal scores the earlier stay."""
    n, width = vectors.shape
    if not width:
        return [(0, int(i)) for i in ids[ids != query_id][:k]]
    ends = np.stack([vectors.min(axis=0) * query, vectors.max(axis=0) * query])
    low, high = ends.min(axis=0), ends.max(axis=0)
    order = np.argsort(low - high, kind="stable")  # widest range first
    terms, rest, low, high = vectors[:, order], query[order], low[order], high[order]
    # most[j]: what terms from j on can add together
    most = np.concatenate([np.cumsum(high[::-1])[::-1], [0]])
    best_scores, best_ids = np.zeros(0, vectors.dtype), np.zeros(0, np.int64)
    at, step = 0, BLOCK
    while at < n:
        rows = np.arange(at, min(n, at + step))
        rows = rows[ids[rows] != query_id]
        at, step = at + step, 4 * step
        # A vector must beat the cell's k-th, for its id is larger, and reach that of another cell, where it may be smaller.
        floors = [*best_scores[k - 1 :], *([] if known is None else [known - 1])]
        floor = max(floors) if floors else None
        essential = width if floor is None else essential_terms(low, high, floor)
        score = terms[rows, :essential] @ rest[:essential]
        for j in range(essential, width, PROBE):
            alive = score + most[j] > floor
            rows, score = rows[alive], score[alive]
            if not len(rows):
                break
            score = score + terms[rows, j : j + PROBE] @ rest[j : j + PROBE]
        if floor is not None:
            rows, score = rows[score > floor], score[score > floor]
        if len(rows):
            scores, found = np.concatenate([best_scores, score]), np.concatenate([best_ids, ids[rows]])
            top = np.argsort(-scores, kind="stable")[:k]
            best_scores, best_ids = scores[top], found[top]
    return [(int(s), int(i)) for s, i in zip(best_scores, best_ids, strict=True)]


def _search(k: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("id").to_pylist(), group.column("ints").to_pylist(), group.column("asks").to_pylist(), group.column("known").to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
        asked = [(i, v, x) for i, v, q, x in rows if q]
        held = [(i, v) for i, v, q, _ in rows if not q]
        width = max([len(r[1]) for r in rows], default=0)
        out: list[tuple[int, int, int]] = []
        if held and asked:
            ids, vectors, queries = np.array([i for i, _ in held], np.int64), _matrix([v for _, v in held], width), _matrix([v for _, v, _ in asked], width)
            most = max((int(np.abs(m).max(initial=0)) for m in (vectors, queries)), default=0)
            exact = most * most * max(width, 1) < 1 << 52  # then doubles hold every sum
            kind = np.float64 if exact else object
            vectors, queries = vectors.astype(kind), queries.astype(kind)
            for (query_id, _, known), query in zip(asked, queries, strict=True):
                out += [(query_id, i, s) for s, i in cell_top_k(ids, vectors, query_id, query, k, known)]
        return pa.table({n: pa.array([r[c] for r in out], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank, vec_id, score. ``asks`` tells the query rows."""
    v = F.col(f"`{vec_col}`")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(whole & F.col(f"`{id_col}`").isNotNull())
    rows = materialise(rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("ints"), asks.alias("asks")), "vectors")
    asked = materialise(rows.filter("asks").groupBy("id").agg(F.min("ints").alias("ints")), "vectors-asked")
    shards, blocks = max(1, -(-rows.count() // SHARD_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    every = lambda first, last: F.explode(F.sequence(F.lit(first), F.lit(last)))
    held = rows.select("id", "ints", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("known"), F.pmod(F.xxhash64("id", "ints"), F.lit(shards)).cast("int").alias("shard"))
    asked = asked.select("id", "ints", F.lit(True).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def searched(held: DataFrame, asked: DataFrame, first: int, last: int) -> DataFrame:
        cells = held.withColumn("block", every(0, blocks - 1)).unionByName(asked.withColumn("shard", every(first, last)))
        return cells.groupBy("shard", "block").applyInArrow(_search(k), HITS)

    hits = searched(held.filter("shard = 0"), asked.withColumn("known", F.lit(None).cast("long")), 0, 0)
    if shards > 1:
        hits = materialise(hits, "vectors-first")
        known = hits.groupBy("query_id").agg(F.min("score").alias("known"), F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "known")
        hits = hits.unionByName(searched(held.filter("shard > 0"), asked.join(known, "id", "left"), 1, shards - 1))
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
