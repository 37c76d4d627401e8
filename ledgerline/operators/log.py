"""Reads over append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this n the planner no longer prunes per-group limits before the
# shuffle, so newest() adds a salted first stage of its own.
GROUP_LIMIT = 1_000
SALTS = 64


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, newest: bool):
    by = [F.col(c).desc() if newest else F.col(c).asc() for c in order]
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def _limit_per_key(df, keys, order, n, newest):
    if n > GROUP_LIMIT:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        df = _ranked(salted, [*keys, "__salt"], order, n, newest).drop("__salt")
    return _ranked(df, keys, order, n, newest)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows per key, unordered."""
    return _limit_per_key(df, keys, order, n, True)


def recent_n(
    df: DataFrame,
    keys: Sequence[str] = ("persona",),
    order: Sequence[str] = ("ts", "id"),
    n: int = 20,
) -> DataFrame:
    """The n newest rows per key, shown oldest first.

    The row_number filter is planned as a group limit, which cuts every key to
    n rows on the map side before the shuffle.
    """
    return newest(df, keys, order, n).orderBy(*keys, *order)


def last_n(
    df: DataFrame,
    keys: Sequence[str] = ("persona",),
    order: Sequence[str] = ("ts", "id"),
    n: int = 0,
) -> DataFrame:
    """The last n rows per key in order; n <= 0 keeps all."""
    rows = df if n <= 0 else newest(df, keys, order, n)
    return rows.orderBy(*keys, *order)


def newest_overall(df: DataFrame, order: Sequence[str] = ("ts", "id"), n: int = 20) -> DataFrame:
    """Top n of the whole input, newest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def log_slice(actions: DataFrame, since: DataFrame | Column, cap: int | None = None) -> DataFrame:
    """Rows at or after a time.

    ``since`` is a column, or a table (persona, since). A ``cap`` takes them from
    the newest rows of each persona only, so that a busy persona loses older rows
    that are in range; without one all are returned and the filter reaches the scan.
    """
    rows = actions if cap is None else newest(actions, ["persona"], ["ts", "id"], cap)
    if isinstance(since, DataFrame):
        kept = rows.join(since.select("persona", "since"), "persona")
        return kept.where(F.col("ts") >= F.col("since")).drop("since")
    return rows.where(F.col("ts") >= since)


def with_date_breaks(df: DataFrame, key: str = "persona") -> DataFrame:
    """Flag the first row of each date, where a report starts a new heading.

    Dates never go back within rows ordered by time, so the row where the date
    changes is the smallest (ts, id) of its date. That is an aggregate with
    map-side partials, not a sort of the whole key.
    """
    dated = df.withColumn("date", F.to_date("ts"))
    firsts = dated.groupBy(key, "date").agg(F.min(F.struct("ts", "id")).alias("__first"))
    return (
        dated.join(firsts, [key, "date"])
        .withColumn("new_date", F.struct("ts", "id") == F.col("__first"))
        .drop("__first")
    )


def last_used(actions: DataFrame) -> DataFrame:
    return actions.groupBy("persona").agg(F.max("ts").alias("last_used_at"))


def touch(personas: DataFrame, actions: DataFrame) -> DataFrame:
    """Advance last_used_at to the newest action of each persona."""
    used = last_used(actions).select(
        F.col("persona").alias("name"), F.col("last_used_at").alias("__used")
    )
    return (
        personas.join(used, "name", "left")
        .withColumn("last_used_at", F.greatest("last_used_at", "__used"))
        .drop("__used")
    )


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key; the order columns must be unique within a key."""
    return _limit_per_key(df, keys, order, 1, False)


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    return newest(df, keys, order, n)


def latest_recording(files: DataFrame) -> DataFrame:
    """Newest recording per directory, by name."""
    return (
        files.where(F.col("name").rlike(r"\.(mp4|mov)$"))
        .groupBy("directory")
        .agg(F.max("name").alias("name"))
    )


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
