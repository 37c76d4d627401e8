"""Entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline import schemas


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """Scan one entity table with its fixed schema."""
    return spark.read.schema(schemas.TABLES[table]).parquet(f"{directory}/{table}.parquet")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring an older snapshot to the current schema.

    Missing columns are added with their default, NULLs in defaulted columns
    that were missing are filled, and extra columns are dropped.
    """
    schema = StructType.fromDDL(schemas.TABLES[table])
    defaults = schemas.DEFAULTS.get(table, {})
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def combine(table: str, *snapshots: DataFrame) -> DataFrame:
    """Union of snapshots written under different versions of the schema."""
    conformed = [conform(s, table) for s in snapshots]
    out = conformed[0]
    for part in conformed[1:]:
        out = out.unionByName(part)
    return out
