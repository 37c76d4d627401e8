"""Filters, predicates and projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import log

# Field names that hold secrets.
SECRET_FIELDS = ("password", "pass", "secret", "token", "key", "recovery")
# Columns that point at secrets and are masked unless asked for.
POINTER_COLUMNS = ("creds_ref",)


def lookup(df: DataFrame, **key: object) -> DataFrame:
    """Rows with exactly these key values; reaches the file scan as a pushed filter."""
    for name, value in key.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def list_for(df: DataFrame, order: Sequence[str], **key: object) -> DataFrame:
    """Ordered rows of one key (or of all, when no key is given)."""
    return lookup(df, **key).orderBy(*key, *order)


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def search_context(
    df: DataFrame, query: str, tags: str | None = None, wildcards: bool = False
) -> DataFrame:
    """Live entries whose summary contains the query, ignoring case.

    With ``wildcards`` the characters % and _ in the query match any text and
    any character; a backslash stays a plain character.
    """
    if wildcards:
        hit = F.col("summary").ilike("%" + query.replace("\\", "\\\\") + "%")
    else:
        hit = F.lower("summary").contains(F.lower(F.lit(query)))
    rows = live(df).where(hit)
    return rows if tags is None else with_any_tag(rows, tags)


def with_tag(df: DataFrame, tag: str) -> DataFrame:
    return df.where(F.array_contains("tags", tag))


def with_any_tag(df: DataFrame, csv: str) -> DataFrame:
    """Rows whose CSV tags share a tag with the filter; '' filters nothing."""
    if not csv:
        return df
    wanted = sorted({t.strip() for t in csv.split(",") if t.strip()})
    if not wanted:
        return df.where(F.lit(False))
    return df.where(F.arrays_overlap(X.split_tags("tags"), F.array(*[F.lit(t) for t in wanted])))


def visible(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("visible"))


def head_per(df: DataFrame, key: str = "page_id", pos: str = "pos", n: int = 50) -> DataFrame:
    """First n rows per key in document order."""
    return log._limit_per_key(df, [key], [pos], n, False)


def redact(df: DataFrame, mode: str = "mask", extra: Iterable[str] = POINTER_COLUMNS) -> DataFrame:
    """Drop or mask columns whose name marks a secret or a pointer to one; blanks stay blank."""
    hidden = {*SECRET_FIELDS, *extra}
    names = [c for c in df.columns if c.lower() in hidden]
    if mode == "drop":
        return df.drop(*names)
    masked = {
        c: F.when(F.col(c).cast("string") == "", "").when(F.col(c).isNotNull(), "***") for c in names
    }
    return df.withColumns(masked) if masked else df


def redact_fields(
    df: DataFrame, field: str = "field", value: str = "value", mode: str = "mask"
) -> DataFrame:
    """The same rule for long (entry, field, value) rows."""
    secret = F.lower(field).isin(*SECRET_FIELDS)
    if mode == "drop":
        return df.where(~secret)
    return df.withColumn(value, F.when(secret, F.lit("***")).otherwise(F.col(value)))


def entries_for(entries: DataFrame, personas: DataFrame, namespace: str) -> DataFrame:
    """Entries named ``namespace/persona/...`` per persona, with the prefix stripped.

    Every slash-terminated prefix of an entry is emitted and joined by equality,
    so no entry is compared with every persona. A persona without entries gets
    one row with ``fallback`` true and no entry: it sees the whole entry list,
    which is not repeated per persona.
    """
    slashes = F.length("entry") - F.length(F.replace(F.col("entry"), F.lit("/"), F.lit("")))
    first = namespace.count("/") + 2
    prefixes = F.transform(
        F.sequence(F.lit(first), slashes),
        lambda i: F.concat(F.call_function("substring_index", F.col("entry"), F.lit("/"), i), F.lit("/")),
    )
    keyed = (
        entries.where(F.col("entry").startswith(f"{namespace}/"))
        .where(slashes >= first)
        .select("entry", F.explode(prefixes).alias("prefix"))
    )
    wanted = personas.select(
        F.col("name").alias("persona"),
        F.concat(F.lit(f"{namespace}/"), F.col("name"), F.lit("/")).alias("prefix"),
    )
    # An inner join and an anti join rather than an outer join, whose many side
    # could not be split for a persona with very many entries.
    matched = keyed.join(wanted, "prefix").select(
        "persona",
        "entry",
        X.strip_prefix("entry", "prefix").alias("service"),
        F.lit(False).alias("fallback"),
    )
    bare = wanted.join(keyed.select("prefix").distinct(), "prefix", "left_anti").select(
        "persona",
        F.lit(None).cast("string").alias("entry"),
        F.lit(None).cast("string").alias("service"),
        F.lit(True).alias("fallback"),
    )
    return matched.unionByName(bare)
