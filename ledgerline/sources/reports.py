"""Text sink for report lines: files by size, and an index of the reports in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import ordered
from ledgerline.operators.reports import ORDER

FILE_BYTES = 128 << 20
PLACE = ["bucket", "part"]


def write_reports(lines: DataFrame, path: str, key: str = "persona", file_bytes: int = FILE_BYTES) -> None:
    """Text files of whole reports under ``path/lines``, and ``path/index``: key, bucket, part, first, n_lines.

    The number of buckets follows the bytes of the text, not the number of keys. A bucket's reports follow each other
    by key; a report that is long on its own is cut into parts in reading order, which have files of their own. The
    index tells for each report and file the number of its first line there, from 0, and how many there are. A line
    with line breaks counts as several, a null line as an empty one.
    """
    text = F.coalesce("line", F.lit(""))
    n_bytes = F.octet_length(text)
    breaks = n_bytes - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    n_lines = F.sum(breaks + 1).alias("n_lines")
    sizes = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(n_bytes + 1).alias("bytes"), n_lines).persist()
    total, longest = sizes.agg(F.sum("bytes"), F.max("n")).first()
    buckets = 1 + (total or 0) // file_bytes

    def placed(rows: DataFrame) -> DataFrame:
        part = F.col(ordered.CHUNK) + 1 if ordered.CHUNK in rows.columns else F.lit(0)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        return rows.withColumns({"bucket": bucket, "part": F.coalesce(part, F.lit(0))}).drop(ordered.CHUNK, ordered.WHOLE)

    # No shorter report can have splitters, and only lines of longer ones have to look for their range.
    least = ordered.HOT_ROWS // ordered.SPLITS
    if (longest or 0) < least:
        rows, counts = placed(lines), placed(sizes)
    else:
        long = sizes.where(F.col("n") >= least).select(key)
        cut = placed(ordered.chunked(lines.join(long, key, "left_semi"), [key], ORDER))
        rows = placed(lines.join(long, key, "left_anti")).unionByName(cut)
        counts = placed(sizes.join(long, key, "left_anti")).select(key, *PLACE, "n_lines")
        counts = counts.unionByName(cut.groupBy(key, *PLACE).agg(n_lines))
    # Each bucket has a task of its own: dealt by a hash, some tasks would have several and others none.
    tasks = max(buckets, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(tasks, F.pmod(F.col("bucket") + F.col("part"), F.lit(tasks)).cast("int"))
    sorted_rows = dealt.sortWithinPartitions(*PLACE, key, *ORDER).select(*PLACE, text.alias("value"))
    sorted_rows.write.mode("overwrite").partitionBy(*PLACE).text(f"{path}/lines")
    before = Window.partitionBy(*PLACE).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    index = counts.select(key, *PLACE, "n_lines", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("first"))
    index.write.mode("overwrite").parquet(f"{path}/index")
    sizes.unpersist()


def read_reports(spark: SparkSession, path: str, key: str = "persona") -> DataFrame:
    """``key, line_no, line`` of all reports, line numbers from 1."""
    index = spark.read.parquet(f"{path}/index")
    text = spark.read.schema("value string, bucket int, part int").text(f"{path}/lines", lineSep="\n")
    place = {"block": F.col("_metadata.file_block_start"), "seq": F.monotonically_increasing_id()}
    lines = text.withColumns(place).select(*PLACE, *place, F.col("value").alias("line"))
    parts = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n_lines").over(parts), F.lit(0)) - F.col("first") + 1
    heads = index.select(*PLACE, "first", F.struct(key, shift.alias("shift")).alias("report"))
    # A file's lines and heads meet in one task, as one task wrote it: lines are shuffled once, and a file has a limit.
    of_file, upto = Window.partitionBy(*PLACE), (Window.unboundedPreceding, Window.currentRow)
    nth = F.count("line").over(of_file.orderBy("block", "seq").rowsBetween(*upto)) - 1
    both = lines.unionByName(heads, allowMissingColumns=True).withColumn("n", F.coalesce("first", nth))
    so_far = of_file.orderBy("n", F.col("report").isNull()).rowsBetween(*upto)
    named = both.withColumn("report", F.last("report", ignorenulls=True).over(so_far)).where(F.col("line").isNotNull())
    return named.select(f"report.{key}", (F.col("n") + F.col("report.shift")).alias("line_no"), "line")
