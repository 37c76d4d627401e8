"""Ordered work per key that does not put a whole key into one task: a segmented scan over ranges.

A plain window partitioned by a key sorts all rows of that key in one task. If
a single key holds a large share of the table, that task decides the run time.
Here the rows of a busy key are cut into ranges of (key, order). Windows run
per (key, range), every range is summed up in one row, the summaries are
composed in order, and each range gets back what the ranges before it amount
to. Both the big window and the join are spread over ranges, and the summary
is pre-aggregated before its shuffle.

Ranges are cut at splitters: rows of the table itself, picked by a hash of key
and order values, one in HOT_ROWS / 16. They are places in the full order, so
rows of one instant, or without any time, are cut at the columns that follow.
Only keys with several picked rows have splitters; all rows of any other key
lie between the same two and stay together. The picked rows are read when the
operator is called: if no key is busy, which is the usual case, what comes out
is the plain window. No more than MAX_SPLITTERS are kept, by least hash, so the
list and a key's summaries are bounded, and ranges grow only when a table has
over a billion rows of busy keys.

Rows that agree in all order columns are never cut apart. Key columns must not
be NULL (the tables declare them so): the join back uses plain equality, which
keeps the partitioning of the window and saves a shuffle of the big side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "__chunk"
WHOLE = "__whole"  # marks rows of which no key is cut
# Keys with about so many rows are cut; 0 cuts every key at every row.
HOT_ROWS = 1_000_000
# Splitters in so many rows, and how many of them make a key busy.
SPLITS = 16
LEAST = 8
MAX_SPLITTERS = 1 << 14


def chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sized_by: DataFrame | None = None
) -> DataFrame:
    """Add the number of a row's range (NULL for keys that stay whole) and spread rows by (key, range).

    The repartition is explicit: if the input were already partitioned by the
    bare key, windows over (key, range) would accept that and leave a busy key
    in one task. ``sized_by`` is a cheaper table than ``df`` with the same keys
    and order values to take the splitters from. Rows that have ranges already
    (of the same keys and in the same order) keep them. If no key is busy, rows
    are only marked as whole.
    """
    if CHUNK in df.columns or WHOLE in df.columns:
        return df
    found = _splitters(df if sized_by is None else sized_by, keys, order)
    if found is None:
        return df.withColumn(WHOLE, F.lit(True))
    listed, n = found
    row = F.struct(*_comparable(df, [*keys, *order]))
    placed = df.withColumn(CHUNK, _place(row, listed, n))
    if keys:
        near = [F.get(listed, F.col(CHUNK) + i) for i in (-1, 0)]
        same = [reduce(lambda a, b: a & b, [s[k].eqNullSafe(row[k]) for k in keys]) & s.isNotNull() for s in near]
        placed = placed.withColumn(CHUNK, F.when(same[0] | same[1], F.col(CHUNK)))
    return placed.repartition(*keys, CHUNK)


def _comparable(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Times as numbers, which a JSON text holds exactly."""
    timed = {f.name for f in df.schema if f.dataType.typeName() in ("timestamp", "timestamp_ntz")}
    return [(F.unix_micros(F.col(n).cast("timestamp")) if n in timed else F.col(n)).alias(n) for n in names]


def _splitters(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[Column, int] | None:
    """Sorted places of the picked rows of busy keys, as a constant of bounded size, and their number; None without any."""
    every, least = (max(1, HOT_ROWS // SPLITS), LEAST) if HOT_ROWS else (1, 1)
    names = [*keys, *order]
    hashed = rows.select(*_comparable(rows, names)).withColumn("__hash", F.xxhash64(*names))
    picked = hashed.where(F.pmod("__hash", F.lit(every)) == 0)
    if keys:
        of_key = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        picked = picked.withColumn("__n", of_key).where(F.col("__n") >= least)
    kept = picked.orderBy("__hash").limit(MAX_SPLITTERS).select(F.struct(*names).alias("__place"))
    listed = F.array_distinct(F.sort_array(F.collect_list("__place")))
    text, n = kept.agg(F.to_json(listed), F.size(listed)).first()  # MAX_SPLITTERS places at most
    kind = f"array<{kept.schema['__place'].dataType.simpleString()}>"
    return None if text in (None, "[]") else (F.from_json(F.lit(text), kind), n)


def _place(row: Column, listed: Column, n: int) -> Column:
    """How many of the n splitters are not after the row, by halving."""
    return F.aggregate(
        F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)]),
        F.lit(0),
        lambda at, step: F.when(F.get(listed, at + step - 1) <= row, at + step).otherwise(at),
    )


def chunk_window(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """A key's rows, or those of one range of it, in order."""
    return Window.partitionBy(*keys, *([CHUNK] if CHUNK in df.columns else [])).orderBy(*order)


def so_far(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """From the first row of the range to the current row."""
    return chunk_window(df, keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    summary: dict[str, Column],
    carried: dict[str, Callable[[WindowSpec], Column]],
    derived: dict[str, Callable[[WindowSpec], Column]] | None = None,
) -> DataFrame:
    """Add columns computed over all earlier ranges of the same key, NULL where no key is cut.

    ``summary`` are aggregates per range; each function in ``carried`` gets the
    window of range summaries (ordered, no frame) and returns one column. Rows
    of a key's first range get what the function yields on an empty frame, and
    rows of a key that is not cut get NULL.
    ``derived`` are extra summary columns made from a scan of the summaries,
    for ``carried`` functions that need a scan of a scan.
    """
    if CHUNK not in df.columns:
        return df.withColumns({name: F.lit(None) for name in carried})
    per_chunk = (
        df.where(F.col(CHUNK).isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(*[c.alias(name) for name, c in summary.items()])
    )
    ordered = Window.partitionBy(*keys).orderBy(CHUNK)
    for name, make in (derived or {}).items():
        per_chunk = per_chunk.withColumn(name, make(ordered))
    names = [*keys, CHUNK]
    offsets = per_chunk.select(
        *[F.col(k).alias(f"__of_{k}") for k in names],
        *[make(ordered).alias(name) for name, make in carried.items()],
    )
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__of_{k}") for k in names])
    return df.join(offsets, same, "left").drop(*[f"__of_{k}" for k in names])


def before(window: WindowSpec) -> WindowSpec:
    """All chunks before the current one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    sized_by: DataFrame | None = None,
    keep_ranges: bool = False,
) -> DataFrame:
    """Position 1..n of each row within its key.

    ``keep_ranges`` leaves the ranges in place for further work in the same
    order, which then needs no shuffle of its own.
    """
    local = chunked(df, keys, order, sized_by)
    local = local.withColumn(name, F.row_number().over(chunk_window(local, keys, order)).cast("bigint"))
    summary = {"__n": F.count(F.lit(1))}
    placed = carry(local, keys, summary, {"__offset": lambda w: F.sum("__n").over(before(w))})
    placed = placed.withColumn(name, F.col(name) + F.coalesce("__offset", F.lit(0))).drop("__offset")
    return placed if keep_ranges else placed.drop(CHUNK, WHOLE)


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    cols: Sequence[str],
    name: str,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add an array of up to n structs: the preceding rows of the key, oldest first.

    Only the last n rows of a range travel in its summary, so no array holds
    more than n * n rows.
    """
    local = chunked(df, keys, order, sized_by)
    w = chunk_window(local, keys, order)
    local = local.withColumn(name, F.collect_list(F.struct(*cols)).over(w.rowsBetween(-n, -1)))
    if CHUNK not in local.columns:
        return local.drop(WHOLE)
    local = local.withColumn("__is_tail", F.lead(F.lit(True), n).over(w).isNull())
    tail = F.when(
        F.col("__is_tail"), F.struct(*order, F.struct(*cols).alias("__row"))
    )
    placed = carry(
        local,
        keys,
        {"__tail": F.transform(F.array_sort(F.collect_list(tail)), lambda t: t["__row"])},
        {"__earlier": lambda w: F.flatten(F.collect_list("__tail").over(w.rowsBetween(-n, -1)))},
    )
    joined = F.concat(F.coalesce("__earlier", F.array()), F.col(name))
    return (
        placed.withColumn(name, joined)
        .withColumn(
            name, F.slice(name, F.greatest(F.lit(1), F.size(name) - n + 1), F.lit(n))
        )
        .drop(CHUNK, "__is_tail", "__earlier")
    )
