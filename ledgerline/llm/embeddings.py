"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference vectors (pivots), in order. Inverted lists are kept per label for
every pair (in large tables: triple) of a vector's nearest pivots, so that two vectors meet in a list exactly if they
share that many; the number shared is counted from both descriptions, and each meeting is looked at in one list
only (that of the smallest shared pivots). Candidates are then verified by cosine in double precision. The number
of pivots follows the number of vectors, so that lists stay short. Lists hold node numbers; vectors are fetched for
the lists that two or more nodes are in. Equal vectors are one node with a weight, so copies bring no pairs; long
lists are cut into blocks, whose pairs are compared without being written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import blocks, shared
from ledgerline.llm.components import components, local_roots

SAMPLE = 4  # vectors looked at for each pivot wanted
LEAST_PIVOTS, MOST_PIVOTS = 256, 4096
APART = 0.8
BASE = 1 << 16  # pivots of a list in one number
FEW, MANY = (6, 2), (8, 3)  # leaders and how many of them a list has in common
SCORES = 1 << 20  # similarities to pivots that are held at once


class Shape(NamedTuple):
    """Parameters of the index: reference vectors, nearest ones kept per vector, how many of them name a list."""

    pivots: int
    leaders: int
    share: int


def shape_for(n: int) -> Shape:
    """The index for ``n`` distinct vectors, such that lists do not grow with the table.

    Lists are named by pairs of pivots while 4 * sqrt(n) pivots make enough of them, and by triples of the most
    pivots beyond that (from about a million vectors).
    """
    wanted = 1 << max(0, math.ceil(math.log2(4 * math.sqrt(max(n, 1)))))
    return Shape(max(LEAST_PIVOTS, wanted), *FEW) if wanted <= MOST_PIVOTS else Shape(MOST_PIVOTS, *MANY)


def _numbers(vectors: DataFrame, vector_col: str) -> Column:
    """The vector column as it is where it holds floats or doubles, else as doubles."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    return F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Distinct (label, vector) with the smallest id and the number of rows; only vectors that can link."""
    value = F.col("v")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(value, lambda x: x != 0)
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), _numbers(vectors, vector_col).alias("v"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & finite & some)
        .groupBy("label", "v")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )


def pick_pivots(nodes: DataFrame, shape: Shape, n: int) -> dict[int, np.ndarray]:
    """Reference vectors, as unit rows per dimension, out of about SAMPLE times as many of the ``n`` nodes, picked by hash.

    Two pivots are less than APART similar: a crowd of near copies in the sample would otherwise order its
    members by noise, and they would share few of their nearest pivots. Dimensions have pivots in proportion.
    """
    sample = SAMPLE * shape.pivots
    order = F.xxhash64("label", "v")
    picked = nodes.where(F.pmod(order, F.lit(max(1, n // sample))) == 0)
    rows = picked.orderBy(order, "least").limit(2 * sample).select("v").toArrow().column("v").combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    pivots = {}
    for size in np.unique(sizes).tolist():
        units = _units(_matrix(rows.take(pa.array(np.flatnonzero(sizes == size)))))
        held = np.empty((max(shape.share, shape.pivots * len(units) // len(sizes)), size))
        found = 0
        for unit in units:
            if found < len(held) and (not found or (held[:found] @ unit).max() < APART):
                held[found] = unit
                found += 1
        pivots[size] = held[:found]
    return pivots


def _units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # norms of very large or small numbers stay finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _flat_units(lists: pa.Array) -> np.ndarray:
    """Unit vectors one after the other, for lists (none of them empty) of any lengths."""
    at = lists.offsets.to_numpy()
    numbers = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if len(at) < 2:
        return numbers
    sizes, inside = np.diff(at), slice(at[0], at[-1])
    part = numbers[inside] / np.repeat(np.maximum.reduceat(np.abs(numbers[inside]), at[:-1] - at[0]), sizes)
    numbers[inside] = part / np.repeat(np.sqrt(np.add.reduceat(part * part, at[:-1] - at[0])), sizes)
    return numbers


def described(nodes: DataFrame, pivots: dict[int, np.ndarray], shape: Shape) -> DataFrame:
    """Nodes with ``dim, leaders`` (ascending) and ``keys``, the lists that each is in.

    Vectors of a dimension with fewer pivots than a list has in common all meet in one list of that dimension.
    """
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS rows at most
    kept = nodes.select("label", "node", "copies", "v")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    names = [*kept.columns, "dim", "leaders", "keys"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                known = sent.value.get(size)
                some = batch.take(pa.array(np.flatnonzero(sizes == size)))
                step = max(1, SCORES // max(size, len(known) if known is not None else 1))
                for part in range(0, some.num_rows, step):
                    rows = some.slice(part, step)
                    n = rows.num_rows
                    if known is None or len(known) < shape.share:
                        leaders, keys = np.zeros((n, 0), np.int64), np.zeros((n, 1), np.int64)
                    else:
                        away = -(_units(_matrix(rows.column("v"))) @ known.T)
                        width = min(shape.leaders, len(known))
                        near = np.argpartition(away, width - 1, axis=1)[:, :width]
                        leaders = np.sort(near, axis=1)
                        places = combinations(range(width), shape.share)
                        keys = np.stack([sum(leaders[:, p] * BASE**k for k, p in enumerate(some_of)) for some_of in places], axis=1)
                    lists = [
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * m.shape[1], pa.array(m.reshape(-1), kind))
                        for m, kind in ((leaders, pa.int32()), (keys, pa.int64()))
                    ]
                    dims = pa.array(np.full(n, size), pa.int32())
                    yield pa.RecordBatch.from_arrays([*rows.columns, dims, *lists], names)

    return kept.mapInArrow(describe, f"{kinds}, dim int, leaders array<int>, keys array<long>")


def verified(index: DataFrame, shape: Shape, threshold: float) -> DataFrame:
    """Per task and node: ``node, linked`` (rows linked to it here) and ``other``, a node it is connected to."""
    keys = ["label", "dim", "key"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in blocks.runs(batches, keys):
            node = table.column("node").to_numpy()
            own = np.stack([table.column("_own").to_numpy(), table.column("_a").to_numpy(), table.column("_b").to_numpy()])
            copies = table.column("copies").to_numpy()
            key, lists, vectors = table.column("key").to_numpy(), table.column("leaders").combine_chunks(), table.column("v").combine_chunks()
            lead_at, vec_at = lists.offsets.to_numpy(), vectors.offsets.to_numpy()
            lead, numbers = lists.values.to_numpy(), _flat_units(vectors)
            values, place = np.unique(node, return_inverse=True)
            labels, counts = np.arange(len(values)), np.zeros(len(values), np.int64)
            dims = table.column("dim").to_numpy()
            width = np.diff(lead_at)
            for i, j in blocks.lagged(ends):
                # rows of the same block also meet in its groups with other blocks: they count in their own
                once = (own[0][i] != own[0][j]) | (own[1][i] == own[2][i])
                i, j = i[once], j[once]
                for size, n in {*zip(dims[i].tolist(), width[i].tolist())}:
                    this = (dims[i] == size) & (width[i] == n)
                    for part in range(0, int(this.sum()), 1 << 14):
                        a, b = i[this][part : part + (1 << 14)], j[this][part : part + (1 << 14)]
                        if n:
                            left = lead[lead_at[a][:, None] + np.arange(n)]
                            right = lead[lead_at[b][:, None] + np.arange(n)]
                            common = (left[:, :, None] == right[:, None, :]).any(axis=2)
                            rank = np.cumsum(common, axis=1)
                            first = sum(
                                np.where(common & (rank == k + 1), left, 0).sum(axis=1).astype(np.int64) * BASE**k
                                for k in range(shape.share)
                            )
                            due = (rank[:, -1] >= shape.share) & (first == key[a])
                            a, b = a[due], b[due]
                        if not len(a):
                            continue
                        x = numbers[vec_at[a][:, None] + np.arange(size)]
                        y = numbers[vec_at[b][:, None] + np.arange(size)]
                        close = np.einsum("ij,ij->i", x, y) >= threshold
                        a, b = a[close], b[close]
                        if len(a):
                            np.add.at(counts, place[a], copies[b])
                            np.add.at(counts, place[b], copies[a])
                            labels = local_roots(labels, place[a], place[b])
            hit = counts > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[hit]), pa.array(counts[hit]), pa.array(values[labels[hit]])], ["node", "linked", "other"]
            )

    wide = index.select("node", "copies", "leaders", "v")
    listed = index.select("label", "dim", F.explode("keys").alias("key"), "node")
    grouped = blocks.in_blocks(listed, keys, "node", keep_own=True, attach=lambda groups: groups.join(wide, "node"))
    return grouped.mapInArrow(verify, "node long, linked long, other long")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: links between vectors of one label at this cosine.

    Vectors that are null, empty or zero, or hold null or non-finite numbers, and rows without label or id link
    with nothing: they are their own component. Vectors of different length do not link. Equal vectors link
    whatever the threshold; a repeated row is another vector of its class. Labels may have any type and are compared as
    they are; one id may have several vectors, in one label or in several, which are vectors of their own. ``component_id`` is the smallest id
    reachable and ``kept`` is true for that id. An empty table gives an empty one; other columns are not carried.
    """
    nodes = shared.durable(valid_vectors(vectors, id_col, vector_col, label_col))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())
    n = nodes.count()
    shape = shape_for(n)
    index = shared.durable(described(nodes, pick_pivots(nodes, shape, n), shape))
    found = shared.durable(verified(index, shape, threshold))
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    member = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    firsts = member.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    named = nodes.select(F.col("label").alias("_label"), F.col("v").alias("_v"), "node", "copies", "least")
    named = named.join(linked, "node", "left").join(member.join(firsts, "component").drop("component"), "node", "left")
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("_label"), _numbers(vectors, vector_col).alias("_v")
    )
    joined = rows.join(named, ["_label", "_v"], "left")
    inside = F.col("node").isNotNull() & F.col("vec_id").isNotNull()
    links = F.when(inside, F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long")
    component = F.when(inside, F.coalesce("first", "least")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
