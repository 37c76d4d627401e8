"""Rows that share a key, brought together in groups of bounded size, and read group by group in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
BUFFER_ROWS = 1 << 15
BUFFER_BYTES = 64 << 20


def in_blocks(
    rows: DataFrame, keys: list[str], spread: str, block: int = BLOCK, keep_own: bool = False,
    *, attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Repartition rows so that any two with the same key meet in some group of at most about ``2 * block`` rows.

    A key with more rows is cut into hashed blocks and every pair of its blocks makes a group, so no pair is lost
    and no group grows. Keys of a single row are dropped. Groups are ``keys + [_a, _b]``, contiguous and sorted;
    ``keep_own`` leaves the row's own block in ``_own``. ``attach`` adds wide columns to the rows of the groups, so that
    rows are narrow while keys are counted and single ones never carry them.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    parts = F.ceil(F.col("_rows") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")
    groups = (
        rows.join(sizes, keys)
        .withColumn("_parts", parts)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_a", F.least("_own", "_other"))
        .withColumn("_b", F.greatest("_own", "_other"))
        .drop("_rows", "_parts", "_other", *([] if keep_own else ["_own"]))
    )
    by = [*keys, "_a", "_b"]
    if attach is not None:
        groups = attach(groups)
    return groups.repartition(*by).sortWithinPartitions(*by)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with, for each row, the position after its group's last row."""
    by = [*keys, "_a", "_b"]
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= BUFFER_ROWS or size >= BUFFER_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            ends = _ends(table, by)
            cut = int(np.searchsorted(ends, len(ends)))  # the last group may go on
            if cut:
                yield table.slice(0, cut), ends[:cut]
            rest = table.slice(cut)
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _ends(table, by)


def _ends(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for name in by:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    begins = np.flatnonzero(new)
    ends = np.append(begins, table.num_rows)
    return ends[np.cumsum(new)]


def lagged(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions in the same group, as arrays of one distance at a time."""
    at, lag = np.arange(len(ends)), 1
    while True:
        at = at[at + lag < ends[at]]
        if not len(at):
            return
        yield at, at + lag
        lag += 1
