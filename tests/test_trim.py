"""Frame trimming and range merging against sets of frame numbers."""

from __future__ import annotations

import random

import pytest

from ledgerline.operators import trim
from tests.helpers import rows


@pytest.mark.parametrize("seed", [1, 3])
def test_merge_ranges_equals_sets(spark, cut_all, seed):
    rng = random.Random(seed)
    data = []
    for key in range(30):
        for _ in range(rng.randrange(1, 40)):
            start = rng.randrange(200)
            data.append((key, start, start + rng.choice([0, 1, 2, 5, 60])))
    want = []
    for key in range(30):
        cells = sorted({i for k, a, b in data if k == key for i in range(a, b + 1)})
        start = cells[0]
        for prev, cur in zip(cells, cells[1:] + [None]):
            if cur != prev + 1:
                want.append((key, start, prev))
                start = cur
    df = spark.createDataFrame(data, "k int, start bigint, end bigint")
    got = trim.merge_ranges(df, ["k"])
    assert sorted(tuple(r) for r in got.collect()) == want


def by_frame(n, start_ms, fps, actions):
    """Kept frames of one recording, action by action."""
    ms = 1000 / fps
    keep = set()
    for ts, action, duration in actions:
        frame = int((ts - start_ms) / ms)
        after = 3000 + ((duration or 0) if action == "fill" else 0)
        first = max(0, frame - int(1000 / ms + 0.99))
        last = min(n - 1, frame + int(after / ms + 0.99))
        keep.update(range(first, last + 1))
    trimmed = bool(actions) and len(keep) < n * 0.8
    return (keep if trimmed else set(range(n))), trimmed


def test_trim_equals_frame_sets(spark):
    rng = random.Random(11)
    recordings, frames, actions, want = [], [], [], []
    for rec in range(40):
        n, fps, start = rng.randrange(1, 480), rng.choice([4.0, 3.0, 7.0]), 1_700_000_000_000 + rec
        mine = [
            (start + rng.randrange(-3_000, 130_000), rng.choice(["click", "fill"]),
             rng.choice([None, 0, 240, 6_000]))
            for _ in range(rng.choice([0, 1, 3, 12, 40]))
        ]
        recordings.append((rec, start, fps))
        frames += [(rec, i, f"f{i}") for i in range(n)]
        actions += [(rec, *a) for a in mine]
        keep, trimmed = by_frame(n, start, fps, mine)
        want += [(rec, i, trimmed) for i in keep]
    f = spark.createDataFrame(frames, "rec_id bigint, frame_idx bigint, file string")
    r = spark.createDataFrame(recordings, "rec_id bigint, start_ms bigint, fps double")
    a = spark.createDataFrame(actions, "rec_id bigint, ts_ms bigint, action string, duration_ms bigint")
    got = trim.trim_frames(f, r, a).select("rec_id", "frame_idx", "trimmed").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert {w[2] for w in want} == {True, False}
    summary = {x.rec_id: x for x in trim.trim_summary(f, r, a).collect()}
    assert len(summary) == 40
    assert all(summary[rec].trimmed == t for rec, _, t in want)


def test_no_action_keeps_everything(spark):
    f = spark.createDataFrame([(1, i, "x") for i in range(5)], "rec_id bigint, frame_idx bigint, file string")
    r = spark.createDataFrame([(1, 0, 4.0)], "rec_id bigint, start_ms bigint, fps double")
    a = spark.createDataFrame([], "rec_id bigint, ts_ms bigint, action string, duration_ms bigint")
    assert rows(trim.trim_frames(f, r, a), "frame_idx") == [0, 1, 2, 3, 4]


def test_gaps_in_frame_numbers(spark):
    recordings = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0)], "rec_id bigint, start_ms bigint, fps double")
    numbers = [0, 1, 2, 5, 6, 7]
    frames = spark.createDataFrame(
        [(rec, i, f"f{i}") for rec in (1, 2) for i in numbers], "rec_id bigint, frame_idx bigint, file string"
    )
    actions = spark.createDataFrame(
        [(1, 3_000, "click", None)], "rec_id bigint, ts_ms bigint, action string, duration_ms bigint"
    )
    got = trim.trim_frames(frames, recordings, actions)
    assert rows(got.where("rec_id = 1"), "file") == ["f2", "f5", "f6", "f7"]
    assert rows(got.where("rec_id = 2"), "file") == [f"f{i}" for i in numbers]
    summary = trim.trim_summary(frames, recordings, actions)
    assert rows(summary, "rec_id", "n_near", "trimmed") == [(1, 4, True), (2, 0, False)]
