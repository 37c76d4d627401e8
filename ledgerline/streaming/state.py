"""State of live operators as a small table of key buckets, advanced once per micro-batch.

A micro-batch touches some buckets. Their rows are read, joined with the new rows by batch operators, and written back;
other buckets stay as they are. Each bucket has two slots: a batch reads the one with the newest earlier batch and
overwrites the other, by Spark's dynamic partition overwrite. A batch that is repeated after a failure reads and
writes the same slots again, a write that breaks off harms nothing that is read, and storage is two copies of the
state, however many batches have passed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKET, PLACE, BATCH = "__bucket", "__place", "__batch"


class BucketedState:
    def __init__(self, path: str, schema: str, keys: Sequence[str], buckets: int):
        self.path, self.keys, self.buckets = path, list(keys), buckets
        self.schema = f"{schema}, {BATCH} bigint, {PLACE} int"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def _started(self, spark: SparkSession) -> bool:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

    def advance(self, batch: int, fresh: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the touched buckets: ``fold`` takes their rows and returns all rows they hold from now on."""
        spark = fresh.sparkSession
        touched = fresh.agg(F.collect_set(self.bucket())).first()[0]  # numbers of buckets
        if not touched:
            return
        newest = {}
        if self._started(spark):
            places = [2 * b + slot for b in touched for slot in (0, 1)]
            last = self._stored(spark).where(F.col(PLACE).isin(places) & (F.col(BATCH) < batch))
            marks = last.groupBy(PLACE).agg(F.max(BATCH).alias("at")).agg(F.collect_list(F.struct("at", PLACE)))
            for at, place in sorted(marks.first()[0]):  # two numbers per touched bucket
                newest[place // 2] = place
            base = self._stored(spark).where(F.col(PLACE).isin(list(newest.values()))).drop(BATCH, PLACE)
        else:
            base = spark.createDataFrame([], self.schema).drop(BATCH, PLACE)
        odd = [b for b in touched if newest.get(b, 1) % 2]  # their last version lies in slot 1, or there is none
        slot = F.when(F.col(BUCKET).isin(odd), 0).otherwise(1)
        rows = (
            fold(base)
            .withColumn(BUCKET, self.bucket())
            .withColumns({BATCH: F.lit(batch).cast("long"), PLACE: F.col(BUCKET) * 2 + slot})
            .drop(BUCKET)
        )
        overwrite_partitions(rows.repartition(PLACE), self.path, PLACE)

    def read(self, spark: SparkSession) -> DataFrame:
        """The current rows of all buckets."""
        if not self._started(spark):
            return spark.createDataFrame([], self.schema).drop(BATCH, PLACE)
        stored = self._stored(spark).withColumn(BUCKET, F.floor(F.col(PLACE) / 2))
        last = stored.groupBy(BUCKET).agg(F.max(BATCH).alias(BATCH))
        return stored.join(last, [BUCKET, BATCH]).drop(BUCKET, BATCH, PLACE)


def overwrite_partitions(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def record(rows: DataFrame, batch: int, path: str) -> None:
    """Keep what a micro-batch has found; a repeated batch replaces what it wrote."""
    overwrite_partitions(rows.withColumn(BATCH, F.lit(batch).cast("long")), path, BATCH)


def recorded(spark: SparkSession, path: str, schema: str, batch: int | None = None) -> DataFrame:
    """What all micro-batches, or one of them, have found."""
    rows = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path)
    return (rows if batch is None else rows.where(F.col(BATCH) == batch)).drop(BATCH)


def start(
    rows: DataFrame, path: str, once: bool, name: str, advance: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Run ``advance`` on every micro-batch, which is held for the time of the call.

    A stream's own plans are not adaptive; the work on a held batch is batch work, and is.
    """

    def each(fresh: DataFrame, batch: int) -> None:
        conf = fresh.sparkSession.conf
        adaptive = conf.get("spark.sql.adaptive.enabled")
        held = fresh.persist()
        conf.set("spark.sql.adaptive.enabled", "true")
        try:
            advance(held, batch)
        finally:
            conf.set("spark.sql.adaptive.enabled", adaptive)
            held.unpersist()

    writer = rows.writeStream.queryName(name).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
