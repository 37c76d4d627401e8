"""Append-only action logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "ts bigint, action string, detail string"


FILE_ROWS = 5_000_000


def append_actions(df: DataFrame, path: str) -> None:
    """Append rows, laid out by date so that time filters prune folders.

    Rows are ranged over (date, persona, time): a date gets files by its size, as adaptive execution merges small
    ranges, a busy persona is spread over several, and a file holds few personas, which its statistics and a Bloom
    filter on the persona tell a reader. Rows without a time have a folder of their own.
    """
    dated = df.withColumn("date", F.to_date("ts"))
    place = ["date", "persona", "ts", "id"]
    rows = dated.repartitionByRange(*place).sortWithinPartitions(*place)
    writer = rows.write.mode("append").partitionBy("date").option("maxRecordsPerFile", FILE_ROWS)
    writer.option("parquet.bloom.filter.enabled#persona", "true").parquet(path)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_action_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(action rows, rejected lines) of JSON lines in column ``value``.

    ``ts`` is in milliseconds. ``detail`` may be any JSON value and is kept as
    text, with ``detail_json`` as VARIANT and ``duration_ms`` taken from an
    object detail. Blank lines are skipped.
    """
    kept = lines.where(F.trim("value") != "")
    parsed = kept.withColumn("__row", F.from_json("value", LINE, {"mode": "PERMISSIVE"}))
    good = F.col("__row.ts").isNotNull() & F.col("__row.action").isNotNull()
    rows = (
        parsed.where(good)
        .drop("value")
        .withColumn("detail_json", F.try_parse_json("__row.detail"))
        .select(
            *[c for c in kept.columns if c != "value"],
            F.col("__row.ts").alias("ts_ms"),
            F.timestamp_millis("__row.ts").alias("ts"),
            F.col("__row.action").alias("action"),
            F.col("__row.detail").alias("detail"),
            "detail_json",
            _duration("detail_json").alias("duration_ms"),
        )
    )
    return rows, parsed.where(~F.coalesce(good, F.lit(False))).drop("__row")


def _duration(detail: str) -> Column:
    return F.when(
        F.schema_of_variant(detail).startswith("OBJECT"),
        F.coalesce(F.try_variant_get(detail, "$.durationMs", "bigint"), F.lit(0)),
    )


def read_action_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_action_lines(spark.read.text(path))
