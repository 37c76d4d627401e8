"""Exact top-k inner products over vectors sorted by length.

Vectors are cut into tiles of descending length. A query first meets the tile of the longest vectors; the score of
its k-th best there bounds what is worth looking at. It goes on only to tiles whose longest vector could reach that
score (|q| |v| >= score), which is decided from one row per tile before any vector moves. Inside a tile vectors are
taken in descending length again, and a query leaves as soon as no later one can reach its score. Pairs are
bounded by partial sums: queries and vectors are rotated by the singular vectors of the tile, so that few leading
components hold most of the length, and what the others can add is at most the product of the residual lengths
(Cauchy-Schwarz). Only pairs whose bound reaches the score are computed, exactly, on the whole numbers.

Queries and tiles meet in groups of bounded size, by (tile, block of queries), never as all pairs of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.shared import durable

TILE_VALUES = 1 << 19  # components in a tile: 8,192 vectors of 64
BLOCK_VALUES = 1 << 17  # components in a block of queries
CHUNK = 512
QUERIES = 256
MAX_TILES = 1 << 16  # one row each; tiles grow beyond 34 billion components
EXACT = float(1 << 53)
NO_FLOOR = -(1 << 63) + 1
PAIR = ["tile", "block"]
HITS = "query_row long, query_id long, score long, vec_id long"


def _values(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Rows of one length as a matrix of whole numbers, floor(scale * x) in double precision."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(lists), -1)


class _Best:
    """The k best of each query so far: score descending, then smaller id (a null id last)."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.least = k, floor.copy()
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id, self.none = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, none = np.concatenate([self.id, ids]), np.concatenate([self.none, none])
        order = np.lexsort((ids, none, -score, query))
        query = query[order]
        new = np.ones(len(query), bool)
        new[1:] = query[1:] != query[:-1]
        begins = np.flatnonzero(new)
        rank = np.arange(len(query)) - begins[np.cumsum(new) - 1]
        keep = rank < self.k
        last = query[rank == self.k - 1]
        self.query, self.score = query[keep], score[order][keep]
        self.id, self.none = ids[order][keep], none[order][keep]
        self.least[last] = np.maximum(self.least[last], score[order][rank == self.k - 1])


def _search(q: np.ndarray, floor: np.ndarray, own: np.ndarray, v: np.ndarray, row: np.ndarray, ids, none, k: int) -> _Best:
    """The k best vectors of each query among those that reach its floor; ``own`` and ``row`` tell rows apart."""
    best = _Best(floor, k)
    if not len(v) or not len(q):
        return best
    long_q, long_v = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    order = np.argsort(-long_v, kind="stable")
    v, row, ids, none, long_v = v[order], row[order], ids[order], none[order], long_v[order]
    # Sums of whole numbers below 2 ** 53 are exact whatever the order; longer vectors take Python's integers.
    exact = long_q.max() * long_v.max() < EXACT
    q_whole, v_whole = (q, v) if exact else (_integers(q), _integers(v))
    energy, rotation = np.linalg.eigh((v.T @ v) / max(1.0, long_v[0] ** 2))
    rotation, energy = rotation[:, ::-1], np.maximum(energy[::-1], 0)
    lead = 1 + int(np.searchsorted(np.cumsum(energy), 0.8 * energy.sum())) if energy.size else 0
    q_turned, v_turned = q @ rotation[:, :lead], v @ rotation[:, :lead]
    q_rest = np.sqrt(np.maximum(long_q**2 - (q_turned**2).sum(axis=1), 0))
    v_rest = np.sqrt(np.maximum(long_v**2 - (v_turned**2).sum(axis=1), 0))
    for at in range(0, len(v), CHUNK):
        part = slice(at, at + CHUNK)
        slack = 1e-9 * long_v[at]
        # Later vectors are no longer than this chunk's first: queries they cannot serve are through.
        active = np.flatnonzero(long_q * (long_v[at] + slack) >= best.least)
        if not len(active):
            break
        for some in range(0, len(active), QUERIES):
            use = active[some : some + QUERIES]
            bound = q_turned[use] @ v_turned[part].T + q_rest[use, None] * v_rest[part] + slack * long_q[use, None] + 1e-6
            may = (bound >= best.least[use, None]) & (own[use, None] != row[part])
            i, j = np.nonzero(may)
            if not len(i):
                continue
            if 8 * len(i) > may.size:  # many are left: one product of matrices
                found = (q_whole[use] @ v_whole[part].T)[i, j]
            else:
                found = (q_whole[use[i]] * v_whole[at + j]).sum(axis=1)
            found = found.astype(np.int64) if exact else np.array(found.tolist(), np.int64)
            good = found >= best.least[use[i]]
            i, j, found = i[good], j[good], found[good]
            best.add(use[i], found, ids[at + j], none[at + j])
    return best


def _integers(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def _meet(queries: DataFrame, tiled: DataFrame, k: int, scale: float) -> DataFrame:
    """Search the queries of each (tile, block) in that tile; the rows of a tile go to the blocks that ask for it."""
    asked = queries.select(*PAIR).distinct()
    sought = tiled.join(asked, "tile").select(*PAIR, "dim", "row", "vec_id", "v")
    asking = queries.select(*PAIR, "dim", "row", "vec_id", "v", "floor")
    asking = asking.toDF(*asking.columns)  # columns of their own: both sides come from one table

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for dim in np.unique(left.column("dim").to_numpy()):
            ours = left.filter(pc.equal(left.column("dim"), int(dim)))
            theirs = right.filter(pc.equal(right.column("dim"), int(dim)))
            floor = ours.column("floor").to_numpy()
            rows, ids = ours.column("row").to_numpy(), ours.column("vec_id").to_numpy()
            found = theirs.column("vec_id")
            best = _search(
                _values(ours.column("v"), scale), floor, rows,
                _values(theirs.column("v"), scale), theirs.column("row").to_numpy(),
                found.fill_null(0).to_numpy(), found.is_null().to_numpy(), k,
            )
            answers = pa.array(best.id, pa.int64(), mask=best.none)
            out.append(pa.table([rows[best.query], ids[best.query], best.score, answers], names=_NAMES))
        return pa.concat_tables(out)

    return asking.groupBy(*PAIR).cogroup(sought.groupBy(*PAIR)).applyInArrow(search, HITS)


_NAMES = [part.split()[0] for part in HITS.split(", ")]


def top_inner(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    scale: float = 1024.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile_values: int = TILE_VALUES,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the highest inner product to each query row.

    Components count as floor(scale * x). ``queries`` is a condition on the columns of ``vectors``; a query's
    candidates are all rows but its own, so another row of the same id or vector is one. Ties go to the smaller id,
    a null id last; rows that agree in score and id are interchangeable. Vectors that are null or hold null or
    non-finite components take no part; only vectors of one length are compared. A query without candidates gives
    no row, fewer than k candidates all of them, an empty table an empty one. Scores beyond 64 bits are an error.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * scale
    whole = lambda y: F.when(F.abs(y) < 1e15, F.floor(y).cast("double")).otherwise(y)
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + whole(scaled(x)) * whole(scaled(x)))
    prepared = durable(
        vectors.where(vector.isNotNull() & finite).select(
            F.col(id_col).cast("long").alias("vec_id"),
            vector.alias("v"),
            F.size(vector).alias("dim"),
            F.sqrt(squares).alias("long"),
            F.coalesce(queries, F.lit(False)).alias("asks"),
        )
    ).withColumn("row", F.monotonically_increasing_id())
    values, asking = prepared.agg(F.sum("dim"), F.sum(F.when(F.col("asks"), F.col("dim")))).first()
    n_tiles = min(MAX_TILES, 1 + (values or 0) // tile_values)
    n_blocks = 1 + (asking or 0) // block_values
    by = [F.col("dim"), F.col("long").desc(), F.col("row")]
    tiled = durable(prepared.repartitionByRange(n_tiles, *by).withColumn("tile", F.spark_partition_id()))

    tiles = tiled.groupBy("dim", "tile").agg(F.max("long").alias("longest"))
    firsts = tiles.groupBy("dim").agg(F.min("tile").alias("tile"))
    asked = tiled.where("asks").drop("tile").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    seeds = asked.join(F.broadcast(firsts), "dim").withColumn("floor", F.lit(NO_FLOOR).cast("long"))
    nearest = durable(_meet(seeds, tiled, k, scale))
    floors = nearest.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    floor = F.coalesce(F.when(F.col("n") >= k, F.col("kth")), F.lit(NO_FLOOR)).cast("long")
    rest = tiles.join(firsts, ["dim", "tile"], "left_anti")
    reach = F.col("long") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("floor")
    going_on = (
        asked.join(floors, F.col("row") == F.col("query_row"), "left")
        .withColumn("floor", floor)
        .drop("query_row", "n", "kth")
        .join(F.broadcast(rest), "dim")
        .where(reach)
    )
    hits = nearest.unionByName(_meet(going_on, tiled, k, scale))
    best_first = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
