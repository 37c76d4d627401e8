"""Reader of JSON files that hold one array of objects, split into many tasks.

A file of one array has no lines to split at, and a multi-line reader gives the whole file to one task. Here files are
cut at every ``}``, which Spark's text reader does at any byte position of a file. Whether such a cut ends a record
depends on what came before: on whether a string is open, and on the depth. Each fragment is a map of that state: its
unescaped quotes say whether a string is open after it (an escape never crosses a ``}``), and its brackets, counted
for both cases, how the depth changes. The maps are composed over a file by segmented scans, so a large file is
spread over tasks; a record's fragments are then put together.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import ordered
from ledgerline.streaming.folders import work_folder

PLACE = ["block", "seq"]


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _running(df: DataFrame, value: str, name: str, here: bool) -> DataFrame:
    """Sum of a number over the fragments of the file before each one, and of its own if ``here``."""
    w = ordered.so_far(df, ["file"], PLACE) if here else ordered.before(ordered.chunk_window(df, ["file"], PLACE))
    summed = ordered.carry(
        df.withColumn(name, F.sum(value).over(w)),
        ["file"],
        {"__total": F.sum(value)},
        {"__earlier": lambda o: F.sum("__total").over(ordered.before(o))},
    )
    zero = F.lit(0).cast("long")
    total = F.coalesce(F.col(name), zero) + F.coalesce(F.col("__earlier").cast("long"), zero)
    return summed.withColumn(name, total).drop("__earlier")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, seq, value``: the text before every ``}``; block and seq are its place."""
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, value``: the text of every object of an array, or of a file that is one object.

    What is no object, or ends before it is closed, is in the text of the record it stands in or before, so a parser
    sees it; blanks, commas and the brackets of the array are left out. An empty array has no record.
    """
    pieces = fragments(spark, path)
    at = F.struct(*PLACE)
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    strings = lambda text: F.regexp_replace(text, r'"[^"]*("|$)', "")
    depth = lambda text: _count(text, "{[") - _count(text, "]")
    mapped = pieces.select(
        "file", *PLACE, "value", "size",
        F.col("value").rlike(r"^\s*\[").cast("int").alias("starts"),
        (F.octet_length("value") + 1).alias("bytes"),
        _count(clean, '"').cast("long").alias("quotes"),
        depth(strings(clean)).alias("free"),
        depth(strings(F.regexp_replace(clean, r'^[^"]*("|$)', ""))).alias("open"),
    )
    ranged = ordered.chunked(mapped, ["file"], PLACE, sized_by=pieces)
    # The passes below read a few columns each; text is parsed and rows find their range once.
    stored = f"{work_folder(spark)}/fragments-{uuid4().hex}"
    ranged.write.parquet(stored)
    ranged = spark.read.schema(ranged.schema).parquet(stored)
    # Facts of a whole file come by the ranges, too: a join by file would put a file's fragments into one task.
    so_far = ordered.so_far(ranged, ["file"], PLACE)
    local = {
        "level": F.first("starts").over(so_far),
        "through": F.sum("bytes").over(so_far),
        "next": F.lead(F.lit(1)).over(ordered.chunk_window(ranged, ["file"], PLACE)),
    }
    ranged = ordered.carry(
        ranged.withColumns(local),
        ["file"],
        {"__starts": F.min_by("starts", at), "__bytes": F.sum("bytes")},
        {
            "__level": lambda o: F.first("__starts").over(ordered.before(o)),
            "__through": lambda o: F.sum("__bytes").over(ordered.before(o)),
            "__next": lambda o: F.lead(F.lit(1)).over(o),
        },
    )
    through = F.col("through") + F.coalesce(F.col("__through").cast("long"), F.lit(0))
    followed = F.col("next").isNotNull() | F.col("__next").isNotNull()
    ranged = ranged.withColumns(
        {
            "level": F.coalesce(F.col("__level").cast("int"), F.col("level")),
            "cut": followed | (through == F.col("size")),  # a } comes after the fragment
        }
    ).drop("size", "starts", "bytes", "through", "next", "__level", "__through", "__next")
    ranged = _running(ranged, "quotes", "quoted", here=False)
    inside = F.col("quoted") % 2 == 1
    ends_outside = (F.col("quoted") + F.col("quotes")) % 2 == 0
    closes = F.col("cut") & ends_outside
    change = F.when(inside, F.col("open")).otherwise(F.col("free")) - closes.cast("int")
    ranged = _running(ranged.withColumns({"change": change, "closes": closes}), "change", "depth", here=True)
    ranged = ranged.withColumn("ends", (F.col("closes") & (F.col("depth") == F.col("level"))).cast("long"))
    ranged = _running(ranged, "ends", "record", here=False)
    part = F.concat("value", F.when(F.col("cut"), "}").otherwise(""))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"]), "")
    records = ranged.withColumn("p", F.struct(*PLACE, part.alias("part"))).groupBy("file", "record", "level").agg(
        joined.alias("value"), F.max("ends").alias("whole")
    )
    text = F.when(F.col("level") == 1, F.regexp_replace("value", r"^[\s,\[]+", "")).otherwise(F.trim("value"))
    rest = F.regexp_replace(text, r"[\s\]]+$", "")
    return records.select("file", "record", F.when(F.col("whole") == 1, text).otherwise(rest).alias("value")).where("value <> ''")
