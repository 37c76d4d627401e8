"""Frame selection: keep only frames near actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import ordered

BUCKET = 64


def merge_ranges(
    ranges: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Union of closed integer ranges per key; ranges that touch are joined.

    Of ranges with the same start only the longest counts. A range opens a new segment when it starts past every earlier end. Each row
    takes the latest opening start as its segment, so the segments come from two
    running maxima and a grouped maximum.
    """
    order = [start]
    longest = ranges.groupBy(*keys, start).agg(F.max(end).alias(end))
    local = ordered.chunked(longest, keys, order, sized_by=ranges)
    w = ordered.chunk_window(local, keys, order)
    local = local.withColumn("__reach", F.max(end).over(ordered.before(w)))
    local = ordered.carry(
        local,
        keys,
        {"__s_reach": F.max(end)},
        {"__o_reach": lambda o: F.max("__s_reach").over(ordered.before(o))},
    )
    reach = F.greatest("__reach", "__o_reach")
    opens = F.when(reach.isNull() | (F.col(start) > reach + 1), F.col(start))
    local = local.withColumn("__opens", opens).withColumn(
        "__segment", F.max("__opens").over(ordered.so_far(local, keys, order))
    )
    local = ordered.carry(
        local,
        keys,
        {"__s_segment": F.max("__opens")},
        {"__o_segment": lambda o: F.max("__s_segment").over(ordered.before(o))},
    )
    segment = F.coalesce("__segment", "__o_segment")
    return (
        local.groupBy(*keys, segment.alias("__from"))
        .agg(F.max(end).alias(end))
        .select(*keys, F.col("__from").alias(start), end)
    )


def _round_up(x: Column) -> Column:
    """The rule's own rounding: differs from ceil for fractions below 0.01."""
    return F.floor(x + 0.99)


def action_ranges(
    recordings: DataFrame,
    frame_counts: DataFrame,
    actions: DataFrame,
    before_ms: int = 1_000,
    after_ms: int = 3_000,
) -> DataFrame:
    """Frames wanted by each action, clamped to the recording.

    ``recordings``: (rec_id, start_ms, fps). ``actions``: (rec_id, ts_ms, action,
    duration_ms), where duration_ms is NULL unless the detail is an object.
    """
    placed = actions.join(recordings.join(frame_counts, "rec_id"), "rec_id")
    frame_ms = F.lit(1000) / F.col("fps")
    offset = (F.col("ts_ms") - F.col("start_ms")) / frame_ms
    # A cast to integer cuts toward zero, also for actions before the start.
    frame = offset.cast("bigint")
    extra = F.when(F.col("action") == "fill", F.coalesce("duration_ms", F.lit(0))).otherwise(0)
    return placed.select(
        "rec_id",
        F.greatest(F.lit(0), frame - _round_up(F.lit(before_ms) / frame_ms)).alias("start"),
        F.least(
            F.col("n_frames") - 1, frame + _round_up((extra + F.lit(after_ms)) / frame_ms)
        ).alias("end"),
    ).where(F.col("start") <= F.col("end"))


def _wanted(frames, recordings, actions, before_ms, after_ms, keep_ratio):
    """(merged ranges near actions, one gate row per recording).

    Ranges are over positions, 0 to n - 1, so the number of kept frames follows
    from the ranges and the frames themselves are only counted.
    """
    frame_counts = frames.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_frames"))
    merged = merge_ranges(
        action_ranges(recordings, frame_counts, actions, before_ms, after_ms), ["rec_id"]
    )
    # Actions add nothing to the sum but show that the recording has some.
    acted = actions.select("rec_id", F.lit(0).cast("bigint").alias("n_near"))
    near = (
        merged.select("rec_id", (F.col("end") - F.col("start") + 1).alias("n_near"))
        .unionByName(acted)
        .groupBy("rec_id")
        .agg(F.sum("n_near").alias("n_near"))
    )
    gate = frame_counts.join(near, "rec_id", "left").select(
        "rec_id",
        "n_frames",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce(F.col("n_near") < F.col("n_frames") * F.lit(keep_ratio), F.lit(False)).alias("trimmed"),
    )
    return merged, gate


def trim_summary(
    frames: DataFrame,
    recordings: DataFrame,
    actions: DataFrame,
    before_ms: int = 1_000,
    after_ms: int = 3_000,
    keep_ratio: float = 0.8,
) -> DataFrame:
    """Frames, kept frames and whether the trim applies, per recording.

    A recording without actions is never trimmed.
    """
    return _wanted(frames, recordings, actions, before_ms, after_ms, keep_ratio)[1]


def trim_frames(
    frames: DataFrame,
    recordings: DataFrame,
    actions: DataFrame,
    before_ms: int = 1_000,
    after_ms: int = 3_000,
    keep_ratio: float = 0.8,
) -> DataFrame:
    """Frames of each recording after the trim.

    Frames near an action stay. A recording keeps all its frames when fewer
    than one in five would go.

    Frames count by their position in the order of their numbers, which may have
    gaps. The ranges to keep are cut at bucket borders and meet the frames by
    equality on (recording, bucket). They do not overlap, so a frame finds one
    piece at most, and a bucket holds no more pieces than half its frames. A long
    recording is spread over its buckets. Recordings left whole need no ranges.
    """
    merged, gate = _wanted(frames, recordings, actions, before_ms, after_ms, keep_ratio)
    near = merged.join(gate.where("trimmed").select("rec_id"), "rec_id", "left_semi")
    buckets = F.sequence(_bucket("start"), _bucket("end"))
    pieces = near.withColumn("bucket", F.explode(buckets)).alias("p")
    numbered = ordered.ordinal(frames, ["rec_id"], ["frame_idx"], "__position")
    f = (
        numbered.withColumn("__position", F.col("__position") - 1)
        .withColumn("bucket", _bucket("__position"))
        .alias("f")
    )
    hit = (
        (F.col("f.rec_id") == F.col("p.rec_id"))
        & (F.col("f.bucket") == F.col("p.bucket"))
        & F.col("f.__position").between(F.col("p.start"), F.col("p.end"))
    )
    # The planner takes rows made by explode for as few as those they come from, and would broadcast either side.
    trimmed = f.join(pieces.hint("merge"), hit).select(*[F.col(f"f.{c}") for c in frames.columns])
    whole = frames.join(gate.where(~F.col("trimmed")).select("rec_id"), "rec_id", "left_semi")
    return trimmed.withColumn("trimmed", F.lit(True)).unionByName(
        whole.select(*frames.columns).withColumn("trimmed", F.lit(False))
    )


def _bucket(frame: str) -> Column:
    return F.floor(F.col(frame) / BUCKET).cast("bigint")
