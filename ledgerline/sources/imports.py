"""Bulk imports: every bad row is set aside with its reason, the rest go in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import filters
from ledgerline.sources import json_arrays

CORRUPT = "_corrupt"


def import_accounts(
    spark: SparkSession, path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, rejects, counts) of JSON files holding an array of {entry, username}.

    Only references are loaded: a password in the file is not in the schema and
    is never read into a row. A large array is read by many tasks.
    """
    schema = f"entry string, username string, {CORRUPT} string"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = json_arrays.read_records(spark, path).select(parsed.alias("__row")).select("__row.*")
    return split_accounts(rows)


def split_accounts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in rows.columns else F.lit(False)
    checked = rows.withColumn(
        "error",
        F.when(corrupt, "not valid JSON")
        .when(X.blank("entry"), "entry is missing")
        .when(X.blank("username"), "username is missing"),
    )
    good = checked.where(F.col("error").isNull()).select("entry", "username")
    rejects = checked.where(F.col("error").isNotNull()).select("entry", "error")
    counts = checked.agg(
        F.count_if(F.col("error").isNull()).alias("imported"),
        F.count_if(F.col("error").isNotNull()).alias("rejected"),
    )
    return filters.redact(good), rejects, counts


def import_milestones(
    rows: DataFrame, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """(milestones, rejects): text column ``ts`` is optional, and lands at its event time.

    Blank takes ``as_of``. Text in no accepted layout, or the epoch itself, is
    rejected.
    """
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    parsed = X.parse_ts("ts")
    given = ~X.blank("ts")
    staged = rows.withColumn("__ts", F.when(given, parsed).otherwise(now.cast("timestamp")))
    usable = F.col("__ts").isNotNull() & ~(given & (F.unix_micros("__ts") == 0))
    good = staged.where(usable).withColumn("ts", F.col("__ts")).drop("__ts")
    return good, staged.where(~usable).drop("__ts")


# --- layered key: value files ---

EXTENSIONS = (".yaml", ".yml")


def read_config_lines(spark: SparkSession, directories: list[str]) -> DataFrame:
    """Lines of all config files: (persona, precedence, line_no, line).

    Earlier directories win over later ones, and .yaml wins over .yml.
    """
    parts = []
    for rank, directory in enumerate(directories):
        files = (
            spark.read.option("recursiveFileLookup", False)
            .option("pathGlobFilter", "*.{yaml,yml}")
            .text(directory, wholetext=True)
            .select("value", F.col("_metadata.file_name").alias("file"))
        )
        ext = F.when(F.col("file").endswith(EXTENSIONS[0]), 0).otherwise(1)
        parts.append(
            files.select(
                F.regexp_replace("file", r"\.ya?ml$", "").alias("persona"),
                (F.lit(rank * len(EXTENSIONS)) + ext).alias("precedence"),
                F.posexplode(F.split("value", "\n")).alias("line_no", "line"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def resolve_config(lines: DataFrame, unquote: bool = False) -> DataFrame:
    """(persona, key, value): the first file of a persona wins whole, the last line per key.

    ``unquote`` strips double quotes around a value, as the shell reader does.
    """
    winner = lines.groupBy("persona").agg(F.min("precedence").alias("precedence"))
    pattern = r"(?U)^\s{0,2}(\w+):\s*(.+)"
    pairs = (
        lines.join(winner, ["persona", "precedence"], "left_semi")
        .where(F.col("line").rlike(pattern))
        .select(
            "persona",
            "line_no",
            F.regexp_extract("line", pattern, 1).alias("key"),
            F.regexp_replace(F.regexp_extract("line", pattern, 2), r"^\s+|\s+$", "").alias("value"),
        )
    )
    if unquote:
        pairs = pairs.withColumn("value", F.regexp_replace("value", r'^"(.*)"$', "$1"))
    return pairs.groupBy("persona", "key").agg(F.max_by("value", "line_no").alias("value"))
