"""Near-duplicate documents by SimHash, found with the generalised pigeonhole principle.

Two fingerprints that differ in at most ``tau`` of 64 bits differ, in at least one part of any partition of the
bits, in at most that part's threshold, if the thresholds plus one sum to ``tau + 1``. Correlated bits are put
into the same part, and the thresholds are allocated by dynamic programming on the candidates each choice is
expected to bring; both rest on counts over all fingerprints. A part with threshold t is probed with its value
under every way to mask t of its bits. Candidates are verified, and what a task finds leaves it as one link per
fingerprint, never as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import blocks, shared
from ledgerline.llm.components import components, local_roots

SEED = 42
SHINGLES_AT_ONCE = 1 << 16
LINKS_AT_ONCE = 1 << 20
MOST_MASKED = 2
KEY_COST = 20.0  # cost of one probe key (shuffled twice, sorted), in verified candidates


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """SimHash of a text: a bit is set if it is in over half of the shingle hashes; no words: zero."""
    words = text.encode("utf-8").lower().split()  # on bytes: A-Z only, and splits at space and 0x09-0x0D
    if not words:
        return 0
    size = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    firsts, lasts = begins[: len(words) - size + 1], begins[size:] - 1
    counts = np.zeros(64, np.int64)
    for at in range(0, len(firsts), SHINGLES_AT_ONCE):
        some = slice(at, at + SHINGLES_AT_ONCE)
        shingles = [joined[a:b] for a, b in zip(firsts[some].tolist(), lasts[some].tolist())]
        hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(firsts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits in a signed long) for every row; null text has no words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in shared.text_slices(batch):
                values = np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], ["doc_id", "fp"])

    return rows.mapInArrow(sign, f"doc_id {id_type}, fp long")


# ---- partition and thresholds ----


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j, over all rows (4,096 numbers)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64))
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            yield pa.RecordBatch.from_arrays([pa.array([4096]), pa.array([float(len(values))])], ["cell", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(both.reshape(-1))], ["cell", "n"])

    found = {r[0]: r[1] for r in fps.mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect()}
    return int(found.get(4096, 0)), np.array([found.get(i, 0.0) for i in range(4096)]).reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into parts of equal size, each grown from its most correlated free bits."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, groups = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group: list[int] = []
        while len(group) < size:
            rest = sorted(free)
            score = tied[np.ix_(rest, group if group else rest)].sum(axis=1)
            pick = rest[int(np.argmax(score))]
            group.append(pick)
            free.remove(pick)
        groups.append(sorted(group))
    return groups


def within(share: np.ndarray, most: int) -> float:
    """Chance that two fingerprints differ in at most ``most`` of bits that are set in these shares of rows."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for p in 2 * share * (1 - share):
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return float(chance[: most + 1].sum())


def allocate(costs: list[list[float]], need: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) with ``sum(t + 1) == need`` and least cost; ``costs[part][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, extra in enumerate(part):
                total = used + t
                if total <= need and (total not in grown or cost + extra < grown[total][0]):
                    grown[total] = (cost + extra, [*chosen, t - 1])
        best = grown
    return best.get(need, (math.inf, []))


def probe_masks(n: int, both: np.ndarray, tau: int) -> list[int]:
    """Masks (signed) under which fingerprints are compared; links within ``tau`` agree under at least one."""
    share = np.diag(both) / max(n, 1)
    plans = []
    for parts in range(1, tau + 2):
        groups = group_bits(n, both, parts)
        costs = []
        for group in groups:
            options = [0.0]
            for t in range(min(tau, MOST_MASKED) + 1):
                candidates = n * n / 2 * within(share[group], t)
                options.append(KEY_COST * n * math.comb(len(group), t) + candidates)
            costs.append(options)
        cost, thresholds = allocate(costs, tau + 1)
        plans.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(p for p in plans if p[3])
    masks = []
    for group, t in zip(groups, thresholds):
        if t >= 0:
            for hidden in combinations(group, t):
                mask = sum(1 << bit for bit in group if bit not in hidden)
                masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


# ---- links ----


def near_links(fps: DataFrame, tau: int = 3) -> DataFrame:
    """Links (``a, b``) that connect all distinct fingerprints within ``tau`` bits; ``fps`` holds each once.

    Not every such pair is returned, but every such pair is connected by those that are.
    """
    masks = probe_masks(*bit_counts(fps), tau)
    probes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(masks)]))
    keyed = fps.select("fp", probes.alias("probe")).select(
        "fp", F.col("probe.i").alias("probe"), F.col("fp").bitwiseAND(F.col("probe.m")).alias("key")
    )
    keys = ["probe", "key"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in blocks.runs(batches, keys):
            values, place = np.unique(table.column("fp").to_numpy(), return_inverse=True)
            labels, left, right, held = np.arange(len(values)), [], [], 0
            bits = values.view(np.uint64)

            def merge():
                nonlocal labels, left, right, held
                if held:
                    labels = local_roots(labels, np.concatenate(left), np.concatenate(right))
                left, right, held = [], [], 0

            for i, j in blocks.lagged(ends):
                i, j = place[i], place[j]
                close = np.bitwise_count(bits[i] ^ bits[j]) <= tau
                close &= labels[i] != labels[j]
                if close.any():
                    left.append(i[close])
                    right.append(j[close])
                    held += int(close.sum())
                    if held > LINKS_AT_ONCE:
                        merge()
            merge()
            linked = labels != np.arange(len(values))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[linked]), pa.array(values[labels[linked]])], ["a", "b"]
            )

    return blocks.in_blocks(keyed, keys, "fp").mapInArrow(link, "a long, b long")


def near_duplicates(
    docs: DataFrame, tau: int = 3, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: documents linked by fingerprints within ``tau`` bits.

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the smallest id reachable through links. Null and
    empty text have the zero fingerprint, which links like any other. Repeated rows are repeated; a null id takes
    part through its text but is never a component's id unless all ids of the component are null. An empty table
    gives an empty one; other columns are not carried. Fingerprints are made once and checkpointed; equal ones
    are one node, so copies bring no pairs.
    """
    signed = shared.durable(fingerprints(docs, words_per_shingle, id_col, text_col))
    nodes = shared.durable(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = components(near_links(nodes.select("fp"), tau)).withColumnRenamed("node", "fp")
    joined = nodes.join(member, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return signed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
