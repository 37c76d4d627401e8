"""One key holds a third of the rows: results stay whole and no task gets the whole key."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import confidence, log, ordered, runs, trim
from tests.helpers import rows

N = 60_000


@pytest.fixture(autouse=True)
def small_limit(monkeypatch):
    """Only the hot key passes the limit: the others have about 40 rows."""
    monkeypatch.setattr(ordered, "HOT_ROWS", 1_000)


@pytest.fixture(scope="module")
def hot(spark):
    """A log of N rows in which 'hot' owns every third row, one row per minute."""
    i = F.col("id")
    return spark.range(N).select(
        "id",
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (i % 997).cast("string"))).alias("persona"),
        F.timestamp_seconds(F.lit(1_700_000_000) + i * 60).alias("ts"),
        F.when(i % 7 == 0, "a").otherwise("b").alias("action"),
    )


def largest_group(df, *keys):
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_chunks_split_the_hot_key(hot):
    chunked = ordered.chunked(hot, ["persona"], ["ts", "id"])
    assert largest_group(hot, "persona") == N // 3
    assert largest_group(chunked, "persona", ordered.CHUNK) <= 1_000
    cut = chunked.where(F.col(ordered.CHUNK).isNotNull()).select("persona").distinct()
    assert rows(cut) == ["hot"]


def test_a_table_partitioned_by_the_key_is_still_spread(spark, hot):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chunked = ordered.chunked(hot.repartition(8, "persona"), ["persona"], ["ts", "id"])
        per_task = chunked.where("persona = 'hot'").groupBy(F.spark_partition_id().alias("p")).count()
        assert per_task.agg(F.max("count")).first()[0] < N // 3 * 0.6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ordinal_and_recent(hot):
    numbered = ordered.ordinal(hot, ["persona"], ["ts", "id"], "n")
    mine = numbered.where("persona = 'hot'")
    assert mine.where(F.col("n") != F.col("id") / 3 + 1).count() == 0
    assert mine.count() == N // 3 and numbered.count() == N
    assert rows(log.newest(hot, ["persona"], ["ts", "id"], 2).where("persona = 'hot'"), "id") == [N - 6, N - 3]
    assert log.newest(hot, ["persona"], ["ts", "id"], 1_500).where("persona = 'hot'").count() == 1_500


def test_stuck_in_a_run_of_twenty_thousand_steps(hot):
    steps = hot.where("persona = 'hot'").select(
        F.lit(1).cast("bigint").alias("run_id"),
        (F.col("id") / 3 + 1).cast("bigint").alias("step"),
        F.when(F.col("id") / 3 + 1 >= 19_000, "same").otherwise((F.col("id") % 2).cast("string")).alias("action_taken"),
        F.lit("x").alias("page_type"),
    )
    assert rows(runs.stuck_points(steps), "stuck_step") == [19_002]


def test_confidence_of_a_busy_recipe(hot):
    outcome = F.when(F.col("id") == 0, "save").when(F.col("id") % 3_000 == 0, "fast_fail").otherwise("success")
    events = hot.select(
        "id", F.col("persona").alias("domain"), F.lit("x").alias("action"),
        F.lit(None).cast("bigint").alias("run_id"), outcome.alias("outcome"), "ts",
    )
    trace = confidence.replay_confidence(events).where("domain = 'hot'")
    since = (F.col("id") % 3_000) / 3
    want = F.least(F.lit(10), 1 + since)
    assert trace.where(F.col("confidence") != want).count() == 0
    assert trace.count() == N // 3


def test_ranges_of_a_long_recording(hot):
    ranges = hot.select(
        F.lit(1).alias("rec_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end")
    )
    merged = trim.merge_ranges(ranges, ["rec_id"])
    assert merged.count() == N
    touching = ranges.withColumn("end", F.col("start") + 9)
    assert rows(trim.merge_ranges(touching, ["rec_id"])) == [(1, 0, N * 10 - 1)]


def test_rows_without_order_values_are_numbered_alike_cut_or_not(spark, monkeypatch):
    data = [("a", None, 3), ("a", None, 1), *[("a", i * 5_000, i) for i in range(5)], ("b", None, 2), ("b", 7, 9)]
    df = spark.createDataFrame(data, "run_id string, step bigint, id bigint")

    def numbered():
        got = ordered.ordinal(df, ["run_id"], ["step", "id"], "n")
        return rows(got, "run_id", "id", "n")

    monkeypatch.setattr(ordered, "HOT_ROWS", 1_000)
    whole = numbered()
    assert [r for r in whole if r[0] == "a"][:1] == [("a", 0, 3)]
    for limit in (0, 3):
        monkeypatch.setattr(ordered, "HOT_ROWS", limit)
        assert numbered() == whole


@pytest.fixture(scope="module")
def burst(spark):
    """Half of a key's rows fall into one minute, most of them into one second, 20 of each millisecond there."""
    i = F.col("id")
    micros = (
        F.when(i < 20_000, i * 600_000_000)
        .when(i < 22_000, F.lit(7_000_000_000) + i * 3_000)
        .otherwise(F.lit(7_200_000_000) + F.floor((i - 22_000) / 20) * 1_000)
    )
    return spark.range(40_000).select(
        "id",
        F.when(i % 40 == 7, F.concat(F.lit("k"), (i % 997).cast("string"))).otherwise("busy").alias("persona"),
        F.when(i % 5_000 == 3, None).otherwise(F.timestamp_micros(micros.cast("bigint"))).alias("ts"),
    )


def test_a_burst_is_cut_to_the_limit(burst):
    chunked = ordered.chunked(burst, ["persona"], ["ts", "id"])
    assert largest_group(chunked.where("persona = 'busy'"), ordered.CHUNK) <= 1_000
    rest = chunked.where("persona <> 'busy'")
    assert rest.where(F.col(ordered.CHUNK).isNotNull()).count() == 0


@pytest.mark.parametrize("ts", ["TIMESTAMP '2026-01-01 00:00:00.001'", "CAST(NULL AS TIMESTAMP)"])
@pytest.mark.parametrize("keys", [["persona"], []])
def test_rows_of_one_instant_or_none_are_spread(spark, ts, keys):
    df = spark.range(0, 100_000, 1, 8).selectExpr("id * 7919 % 100000 AS id", "'busy' AS persona", f"{ts} AS ts")
    chunked = ordered.chunked(df, keys, ["ts", "id"])
    assert largest_group(chunked, *keys, ordered.CHUNK) <= 1_000
    assert chunked.select(ordered.CHUNK).distinct().count() > 100
    numbered = ordered.ordinal(df, keys, ["ts", "id"], "n")
    assert numbered.where("n <> id + 1").count() == 0 and numbered.count() == 100_000


def test_splitters_are_bounded_and_rows_beside_them_stay_whole(hot, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_SPLITTERS", 16)
    chunked = ordered.chunked(hot, ["persona"], ["ts", "id"])
    assert chunked.where("persona = 'hot'").select(ordered.CHUNK).distinct().count() <= 17
    numbered = ordered.ordinal(hot, ["persona"], ["ts", "id"], "n")
    assert numbered.where("persona = 'hot' and n <> id / 3 + 1").count() == 0


def test_ranges_follow_the_order_and_serve_further_steps(burst):
    order = ["ts", "id"]
    chunked = ordered.chunked(burst, ["persona"], order).where("persona = 'busy'")
    ends = chunked.groupBy(ordered.CHUNK).agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b"))
    before = F.lag("b").over(Window.orderBy(ordered.CHUNK))
    assert ends.withColumn("p", before).where("p >= a").count() == 0
    numbered = ordered.ordinal(burst, ["persona"], order, "n", keep_ranges=True)
    seen = ordered.previous_rows(numbered, ["persona"], ["n"], 2, ["n"], "prev").where("persona = 'busy'")
    want = F.filter(F.array(F.col("n") - 2, F.col("n") - 1), lambda x: x > 0)
    assert seen.where(F.transform("prev", lambda p: p["n"]) != want).count() == 0


@pytest.mark.parametrize("keys", [["persona"], []])
def test_numbers_in_a_burst_equal_a_plain_window(burst, keys):
    order = ["ts", "id"]
    plain = burst.withColumn("want", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    got = ordered.ordinal(burst, keys, order, "n").select("id", "n")
    both = plain.join(got, "id")
    assert both.count() == 40_000 and both.where("n <> want").count() == 0


def test_confidence_in_a_burst_is_the_same_uncut(burst, monkeypatch):
    i = F.col("id")
    outcome = F.when(i % 3_000 == 1, "save").when(i % 1_700 == 0, "fast_fail").otherwise("success")
    events = burst.where("ts is not null").select(
        "id", F.col("persona").alias("domain"), F.lit("x").alias("action"),
        F.lit(None).cast("bigint").alias("run_id"), outcome.alias("outcome"), "ts",
    )

    def digest():
        trace = confidence.replay_confidence(events)
        state = F.xxhash64("id", "confidence", "created", "last_verified", "last_failed")
        return trace.agg(F.count(F.lit(1)), F.sum(state.cast("decimal(38,0)"))).first()

    cut = digest()
    monkeypatch.setattr(ordered, "HOT_ROWS", 1_000_000)
    assert digest() == cut


def test_ranges_with_one_start_count_once(hot):
    ranges = hot.select(F.lit(1).alias("rec_id"), (F.col("id") % 3 * 100).alias("start"), (F.col("id") % 150).alias("end"))
    assert rows(trim.merge_ranges(ranges.where("start <= end"), ["rec_id"])) == [(1, 0, 148)]
