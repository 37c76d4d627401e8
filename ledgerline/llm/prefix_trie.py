"""Trie of conversation prefixes by fixed-length block hashing.

Every turn has a 128-bit digest keyed by its place, and a prefix is the XOR of its turns' digests, so the digest of
a prefix is a running XOR that can be cut anywhere. Conversations are compared by blocks of BLOCK turns first: one
row per conversation and block carries the digests before and after the block. Equal rows are one edge between two
block borders, counted where they lie before anything moves, and no round per level is needed, however long a
conversation is. Turn boundaries inside a block are looked at only where several different blocks follow the same
prefix; a block that has no sibling is a chain of nodes with the same members.

Sums over subtrees need no walk either. A node belongs to its smallest member. The nodes that belong to one
conversation are the lower end of its path, so the subtree of a node holds all nodes of its members but for those
of its own conversation that lie above it: a sum over members, made like the counts, less a running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import durable
from ledgerline.operators import ordered

BLOCK = 4
NODE = ["depth", "x", "y"]
EDGE = ["block", "x0", "y0", "dx", "dy"]


class Trie(NamedTuple):
    """``nodes``: depth, x, y (the prefix), up_x, up_y (its parent), bytes (of the last text), conv_id (smallest
    member), n_convs, n_children, n_leaves, saved. ``ends``: conv_id and the node at which it ends."""

    nodes: DataFrame
    ends: DataFrame


def turn_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``conv_id, pos, x, y, bytes`` of turns (with role and text), positions from 1 in the order of the turn.

    A null turn comes first; equal turns go by their digests. Null roles and texts are empty. Rows without a
    conversation are left out. A conversation of any length is numbered in ranges.
    """
    said = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    rows = durable(
        turns.where(F.col(conv_col).isNotNull()).select(
            F.col(conv_col).alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.xxhash64(F.lit(1), *said).alias("x"),
            F.xxhash64(F.lit(2), *said).alias("y"),
            F.octet_length(said[1]).cast("long").alias("bytes"),
        )
    )
    return ordered.ordinal(rows, ["conv_id"], ["turn", "x", "y"], "pos").drop("turn")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> Trie:
    """The trie of turns as ``turn_digests`` gives them.

    ``conversations`` (distinct ``conv_id``) also names those without a turn: they are members of the root only.
    The root is at depth 0; without any conversation there is no node. ``saved`` of a node sums, over its subtree,
    (members - 1) x bytes of the last text: what is stored once instead of for each member. Equal conversations
    end at one node. Prefixes are told apart by 128 bits.
    """
    place = [F.col(c) for c in ("x", "y", "pos")]
    rows = turns.select(
        "conv_id",
        "pos",
        F.xxhash64(*place).alias("tx"),
        F.xxhash64(F.lit(3), *place).alias("ty"),
        "bytes",
        F.expr(f"(pos - 1) div {block}").alias("block"),
    )
    rows = durable(rows)
    ends = rows.groupBy("conv_id").agg(
        F.max("pos").alias("depth"), F.bit_xor("tx").alias("x"), F.bit_xor("ty").alias("y")
    )
    if conversations is None:
        conversations = rows.select("conv_id").distinct()
    else:
        zero = F.lit(0).cast("long")
        silent = conversations.select("conv_id").join(ends, "conv_id", "left_anti")
        ends = ends.unionByName(silent.select("conv_id", *[zero.alias(c) for c in NODE]))

    blocks = durable(_blocks(rows, block))
    edges = durable(_edges(blocks))
    root = (
        conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
        .where("n_convs > 0")
        .select(*[F.lit(0).cast("long").alias(c) for c in (*NODE, "bytes")], "n_convs", "conv_id")
    )
    counts = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    nodes = durable(_nodes(edges, block, counts).unionByName(root, allowMissingColumns=True))

    parent = [(F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    valued = nodes.join(children, NODE, "left").withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
            "own_leaf": F.col("n_children").isNull().cast("long"),
            "own_saved": (F.col("n_convs") - 1) * F.col("bytes"),
        }
    )
    valued = durable(valued)
    of_conv = valued.groupBy("conv_id").agg(F.sum("own_leaf").alias("leaf"), F.sum("own_saved").alias("saved"))
    sums = [F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")]
    of_edge = blocks.select("conv_id", *EDGE).join(of_conv, "conv_id").groupBy(*EDGE).agg(*sums)
    below = _nodes(edges.drop("n_convs", "conv_id").join(of_edge, EDGE), block, sums).select(*NODE, "leaf", "saved")
    whole = valued.agg(F.sum("own_leaf").alias("leaf"), F.sum("own_saved").alias("saved")).where("leaf IS NOT NULL")
    below = below.unionByName(whole.select(*[F.lit(0).cast("long").alias(c) for c in NODE], "leaf", "saved"))
    return Trie(_less_above(valued).join(below, NODE).select(
        *NODE, "up_x", "up_y", "bytes", "conv_id", "n_convs", "n_children",
        (F.col("leaf") - F.col("leaf_above")).alias("n_leaves"),
        (F.col("saved") - F.col("saved_above")).alias("saved"),
    ), ends)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: the prefix before it, its own digest, its turns (``block`` at most)."""
    one = F.struct("pos", "tx", "ty", "bytes")
    blocks = rows.groupBy("conv_id", "block").agg(
        F.bit_xor("tx").alias("dx"), F.bit_xor("ty").alias("dy"), F.sort_array(F.collect_list(one)).alias("turns")
    )
    firsts = rows.where(F.col("pos") % block == 1 % block).select("conv_id", "block")
    ranged = ordered.chunked(blocks, ["conv_id"], ["block"], sized_by=firsts)
    before = ordered.before(ordered.chunk_window(ranged, ["conv_id"], ["block"]))
    ranged = ranged.withColumns({f"in_{c}": F.bit_xor(f"d{c}").over(before) for c in "xy"})
    ranged = ordered.carry(
        ranged,
        ["conv_id"],
        {f"sum_{c}": F.bit_xor(f"d{c}") for c in "xy"},
        {
            "off_x": lambda w: F.bit_xor("sum_x").over(ordered.before(w)),
            "off_y": lambda w: F.bit_xor("sum_y").over(ordered.before(w)),
        },
    )
    at = {f"{c}0": _xor(F.coalesce(f"in_{c}", _zero()), F.coalesce(f"off_{c}", _zero())) for c in "xy"}
    return ranged.withColumns(at).select("conv_id", *EDGE, "turns")


def _zero() -> Column:
    return F.lit(0).cast("long")


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _edges(blocks: DataFrame) -> DataFrame:
    """Distinct blocks after distinct prefixes, and whether a prefix goes on with several of them."""
    edges = blocks.groupBy(*EDGE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")
    )
    edges = durable(edges)
    prefix = EDGE[:3]
    many = edges.groupBy(*prefix).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*prefix, F.lit(True).alias("splits"))
    return edges.join(many, prefix, "left").withColumn("splits", F.coalesce("splits", F.lit(False)))


def _nodes(edges: DataFrame, block: int, values: list[Column]) -> DataFrame:
    """Nodes at every turn of the edges' blocks with aggregated values; only blocks with siblings are regrouped."""
    x, y, steps = F.col("x0"), F.col("y0"), []
    for i in range(block):
        turn = F.get("turns", F.lit(i))
        up, (x, y) = (x, y), (_xor(x, turn["tx"]), _xor(y, turn["ty"]))
        depth = F.col("block") * block + i + 1
        names = (*NODE, "up_x", "up_y", "bytes")
        steps.append(F.struct(*[c.alias(n) for c, n in zip((depth, x, y, *up, turn["bytes"]), names)]))
    told = [c for c in edges.columns if c not in (*EDGE, "turns", "splits")]
    listed = F.filter(F.array(*steps), lambda s: s["x"].isNotNull())
    each = edges.select("splits", *told, F.explode(listed).alias("s")).select("splits", *told, "s.*")
    shared = [F.first(c).alias(c) for c in ("up_x", "up_y", "bytes")]  # equal in all rows of a node
    refined = each.where("splits").groupBy(*NODE).agg(*shared, *values)
    columns = [*NODE, "up_x", "up_y", "bytes", *told]
    return each.where("NOT splits").select(*columns).unionByName(refined.select(*columns))


def _less_above(valued: DataFrame) -> DataFrame:
    """Sums of the nodes of the same conversation above each node."""
    keys, order = ["conv_id"], ["depth"]
    names = {"leaf": "own_leaf", "saved": "own_saved"}
    ranged = ordered.chunked(valued, keys, order)
    before = ordered.before(ordered.chunk_window(ranged, keys, order))
    ranged = ranged.withColumns({f"in_{n}": F.sum(c).over(before) for n, c in names.items()})
    ranged = ordered.carry(
        ranged,
        keys,
        {f"sum_{n}": F.sum(c) for n, c in names.items()},
        {
            "off_leaf": lambda w: F.sum("sum_leaf").over(ordered.before(w)),
            "off_saved": lambda w: F.sum("sum_saved").over(ordered.before(w)),
        },
    )
    above = {
        f"{n}_above": reduce(Column.__add__, [F.coalesce(f"{p}_{n}", _zero()) for p in ("in", "off")]) for n in names
    }
    return ranged.withColumns(above)


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, x, y, ends_sha256``: SHA-256 of the ascending ids of the conversations that end at a node, joined by
    commas. Ids of a busy node are sorted and joined range by range; a worker then reads these texts in order."""
    ends = durable(ends)
    ranged = ordered.chunked(ends, NODE, ["conv_id"])
    cut = ordered.CHUNK in ranged.columns
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ranged.groupBy(*NODE, *([ordered.CHUNK] if cut else [])).agg(joined.alias("ids"))
    plain = texts.where(F.col(ordered.CHUNK).isNull()) if cut else texts
    digests = plain.select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    if not cut:
        return digests
    parts = texts.where(F.col(ordered.CHUNK).isNotNull()).withColumnRenamed(ordered.CHUNK, "part")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in NODE)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        done: list[tuple] = []
        for batch in batches:
            keys = list(zip(*[batch.column(n).to_pylist() for n in NODE]))
            for key, ids in zip(keys, batch.column("ids")):
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
        if node is not None:
            done.append((*node, digest.hexdigest()))
        columns = list(zip(*done)) if done else [()] * 4
        arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, [*NODE, "ends_sha256"])

    sorted_parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "part")
    return digests.unionByName(sorted_parts.mapInArrow(fold, f"{kinds}, ends_sha256 string"))


def with_parent(nodes: DataFrame) -> DataFrame:
    """Add the smallest member of each node's parent (null at the root)."""
    up = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return nodes.join(up, ["depth", "up_x", "up_y"], "left")


def last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with the columns of their last turn, from ``turns`` with ``conv_id`` and ``pos``."""
    named = turns.withColumnRenamed("pos", "depth").drop("bytes", "x", "y")
    return nodes.join(named, ["conv_id", "depth"])


# ---- conversations that share their beginnings ----


def with_shared_starts(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation c: the first h turns of conversation c - c % group, then its own after its first h,
    where h is the unsigned CRC-32 of c's decimal digits modulo ``most``.

    ``turns`` come from ``turn_digests``; returns them with new positions, and all conversations. Only the first
    turns of the conversations that begin a group are copied, at most ``most - 1`` to each of a group.
    """
    turns = durable(turns)
    start = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    first = F.expr(f"conv_id - conv_id % {group}")
    convs = durable(turns.select("conv_id").distinct())
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "first")
    copied = convs.withColumn("first", first).join(heads, "first").where(F.col("pos") <= start("conv_id")).drop("first")
    copied = durable(copied.select("conv_id", "pos", "x", "y", "bytes"))
    taken = copied.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_taken"))
    missing = start("conv_id") - F.coalesce("_taken", _zero())
    short = convs.join(taken, "conv_id", "left").withColumn("_short", missing).where("_short > 0").drop("_taken")
    own = turns.where(F.col("pos") > start("conv_id")).join(short, "conv_id", "left")
    own = own.withColumn("pos", F.col("pos") - F.coalesce("_short", _zero())).drop("_short")
    return copied.unionByName(own), convs
