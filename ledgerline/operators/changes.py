"""Table state transitions: (base, changes) -> new base, rejects.

Times are parameters, never the clock, so a job that is run again gives the
same table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import joins, log, ordered

DEFAULT_PERSONA = "default"
# Columns a patch may touch, per table.
PATCHABLE = {
    "personas": ("description", "purpose", "locale", "timezone", "profile"),
    "accounts": ("service", "email", "creds_ref", "status", "notes"),
    "context": ("summary", "source", "tags"),
}


def _at(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


# --- inserts ---


def insert_new(
    base: DataFrame, new: DataFrame, key: str, order: str
) -> tuple[DataFrame, DataFrame]:
    """Insert rows with unused keys. ``order`` is unique in the batch; the first row wins."""
    firsts = new.groupBy(key).agg(F.min(order).alias(order))
    taken = base.select(F.col(key), F.lit(True).alias("__taken"))
    verdicts = (
        new.join(firsts.withColumn("__first", F.lit(True)), [key, order], "left")
        .join(taken, key, "left")
        .withColumn(
            "reject_reason",
            F.when(F.col("__taken"), "already exists").when(
                F.col("__first").isNull(), "repeated in batch"
            ),
        )
        .drop("__first", "__taken")
    )
    accepted = verdicts.where(F.col("reject_reason").isNull()).drop("reject_reason", order)
    rejects = verdicts.where(F.col("reject_reason").isNotNull())
    return base.unionByName(accepted, allowMissingColumns=True), rejects


def ensure_default(personas: DataFrame, as_of: datetime) -> DataFrame:
    """Add the persona 'default' when it is missing."""
    values = {
        **schemas.DEFAULTS["personas"],
        "name": DEFAULT_PERSONA,
        "description": "Default browser persona",
    }
    columns = {**{k: F.lit(v) for k, v in values.items()}, "created_at": _at(as_of)}
    found = personas.where(F.col("name") == DEFAULT_PERSONA).agg(F.count(F.lit(1)).alias("__n"))
    row = found.where(F.col("__n") == 0).select(
        *[c.alias(k) for k, c in columns.items() if k in personas.columns]
    )
    return personas.unionByName(row, allowMissingColumns=True)


def assign_ids(
    base: DataFrame,
    new: DataFrame,
    order: Sequence[str],
    id_col: str = "id",
) -> DataFrame:
    """Dense ids after the highest id of the base, in batch order."""
    last = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).scalar()
    numbered = ordered.ordinal(new, [], order, id_col)
    return numbered.withColumn(id_col, F.col(id_col) + last)


# --- updates ---


def patch(
    base: DataFrame,
    changes: DataFrame,
    key: str,
    allowed: Sequence[str],
    order: str,
    as_of: datetime | Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Overwrite allowed columns where the patch is not NULL; later patches win per column.

    With ``as_of`` a row that really gets a value has updated_at set. Patches
    for unknown keys are rejected.
    """
    cols = [c for c in allowed if c in changes.columns and c in base.columns]
    merged = changes.groupBy(key).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__new_{c}")
            for c in cols
        ]
    )
    out = base.join(merged, key, "left")
    if as_of is not None:
        touched = F.coalesce(*[F.col(f"__new_{c}").cast("string") for c in cols]).isNotNull()
        out = out.withColumn("updated_at", F.when(touched, _at(as_of)).otherwise(F.col("updated_at")))
    out = out.withColumns({c: F.coalesce(f"__new_{c}", c) for c in cols})
    rejects = changes.join(base.select(key), key, "left_anti")
    return out.select(*base.columns), rejects


def update_context(
    base: DataFrame, changes: DataFrame, as_of: datetime | Column, order: str
) -> tuple[DataFrame, DataFrame]:
    """Patch knowledge entries; digested_at stays, so the entry reads as updated."""
    return patch(base, changes, "id", PATCHABLE["context"], order, as_of)


def upsert_flows(base: DataFrame, saves: DataFrame) -> DataFrame:
    """Save recipes by (domain, action): the newest save gives the content.

    An existing recipe keeps id, created and last_failed; a new one is created
    at its first save and gets a NULL id (see ``assign_ids``). Every save sets
    confidence 1 and last_verified. ``saves`` carries ``ts`` and a unique ``seq``.
    """
    keys = ["domain", "action"]
    content = [c for c in ("description", "steps", "caveats", "refs") if c in saves.columns]
    latest = saves.groupBy(*keys).agg(
        F.max_by(F.struct(*content), F.struct("ts", "seq")).alias("__content"),
        F.min("ts").alias("__first"),
        F.max("ts").alias("__last"),
    )
    merged = base.join(latest, keys, "full_outer")
    saved = F.col("__last").isNotNull()
    values = {c: F.when(saved, F.col(f"__content.{c}")).otherwise(F.col(c)) for c in content}
    values["confidence"] = F.when(saved, F.lit(1)).otherwise(F.col("confidence"))
    values["created"] = F.coalesce("created", "__first")
    values["last_verified"] = F.when(saved, F.col("__last")).otherwise(F.col("last_verified"))
    return merged.withColumns(values).select(*base.columns)


# --- deletes ---


def soft_delete(base: DataFrame, ids: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Set deleted_at once; a second call changes nothing."""
    marks = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    return (
        base.join(marks, "id", "left")
        .withColumn(
            "deleted_at",
            F.coalesce("deleted_at", F.when(F.col("__gone"), _at(as_of))),
        )
        .drop("__gone")
    )


def hard_delete(
    base: DataFrame, doomed: DataFrame, keys: Sequence[str] = ("id",)
) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that went); ``joins.flag_known`` gives both in one table."""
    return joins.split_conflicts(base, doomed, keys)


def cascade_delete(
    tables: dict[str, DataFrame], names: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete personas and the rows of their child tables; recipes have no persona and stay.

    'default' cannot be deleted; asking for it is returned as a reject.
    """
    refused = names.where(F.col("name") == DEFAULT_PERSONA)
    doomed = names.where(F.col("name") != DEFAULT_PERSONA).select("name").distinct()
    out = dict(tables)
    out["personas"] = tables["personas"].join(doomed, "name", "left_anti")
    for child, (column, _, _) in schemas.PARENTS.items():
        if child in tables:
            gone = doomed.select(F.col("name").alias(column))
            out[child] = tables[child].join(gone, column, "left_anti")
    return out, refused


# --- digest of the knowledge table ---


def digest_class() -> Column:
    """'new', 'updated', 'deleted', or NULL for entries with nothing pending."""
    live = F.col("deleted_at").isNull()
    return (
        F.when(~live, "deleted")
        .when(F.col("digested_at").isNull(), "new")
        .when(F.col("updated_at") > F.col("digested_at"), "updated")
    )


def digest_classes(context: DataFrame) -> DataFrame:
    """Entries that the next digest must take in, with their class."""
    return context.withColumn("digest_class", digest_class()).where(
        F.col("digest_class").isNotNull()
    )


def digest_counts(context: DataFrame) -> DataFrame:
    return log.counts(digest_classes(context), "persona", "digest_class")


def commit_digest(
    personas: DataFrame, context: DataFrame, summaries: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """Store summaries, stamp what they cover, purge deleted entries.

    Only personas in ``summaries`` (persona, summary) are committed, and only
    changes up to ``as_of``; later ones stay pending.
    """
    at = _at(as_of)
    stored = summaries.select(
        F.col("persona").alias("name"), F.col("summary").alias("__summary")
    )
    new_personas = (
        personas.join(stored, "name", "left")
        .withColumn("context_summary", F.coalesce("__summary", "context_summary"))
        .select(*personas.columns)
    )
    marks = summaries.select("persona").distinct().withColumn("__commit", F.lit(True))
    seen = context.join(marks, "persona", "left")
    committed = F.coalesce("__commit", F.lit(False))
    gone = F.coalesce(F.col("deleted_at") <= at, F.lit(False))
    pending = F.col("digested_at").isNull() | F.coalesce(
        F.col("updated_at") > F.col("digested_at"), F.lit(False)
    )
    stamp = committed & pending & (F.col("created_at") <= at)
    new_context = (
        seen.where(~(committed & gone))
        .withColumn("digested_at", F.when(stamp, at).otherwise(F.col("digested_at")))
        .select(*context.columns)
    )
    return new_personas, new_context
