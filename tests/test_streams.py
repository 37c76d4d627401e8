"""A stream cut into micro-batches ends where the batch operator ends."""

from __future__ import annotations

import random

from ledgerline.operators import confidence, log, runs
from ledgerline.streaming import folders, live, state
from tests.helpers import at, rows


def feed(spark, path, batches, schema, start, before=None):
    """Run the live operator once per batch; each batch is one new file."""
    source = str(path / "in")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start(stream).awaitTermination()
        if before:
            before(i)


def cut(data, n):
    size = -(-len(data) // n)
    return [data[i : i + size] for i in range(0, len(data), size)]


def test_recent_actions(spark, tmp_path):
    rng = random.Random(1)
    data = [(i, f"p{rng.choice('aab')}", "open", "", at(rng.randrange(500))) for i in range(200)]
    path = str(tmp_path / "state")
    feed(spark, tmp_path, cut(data, 5), live.ACTIONS, lambda s: live.live_recent(s, path, 7, once=True, buckets=3))
    want = log.recent_n(spark.createDataFrame(data, live.ACTIONS), n=7)
    assert rows(live.recent_actions(spark, path, 7, buckets=3)) == rows(want)


def test_stuck_runs_alert_once(spark, tmp_path):
    rng = random.Random(2)
    data = [(run, step, rng.choice("ab"), "x") for step in range(1, 16) for run in range(25)]
    path = str(tmp_path / "state")
    feed(spark, tmp_path, cut(data, 5), live.STEPS, lambda s: live.live_stuck(s, path, once=True, buckets=3))
    want = runs.stuck_points(spark.createDataFrame(data, live.STEPS))
    got = live.stuck_alerts(spark, path)
    assert rows(got) == rows(want.select(got.columns))
    assert got.count() == got.select("run_id").distinct().count() > 10


def test_confidence(spark, tmp_path):
    rng = random.Random(3)
    schema = "id bigint, domain string, action string, run_id bigint, outcome string, ts timestamp"
    names = ["success"] * 5 + ["save", "save", "fast_fail", "delete"]
    data = [(i, f"s{rng.randrange(8)}.com", "login", rng.randrange(60), rng.choice(names), at(i)) for i in range(240)]
    path = str(tmp_path / "state")
    feed(spark, tmp_path, cut(data, 4), schema, lambda s: live.live_confidence(s, path, once=True, buckets=3))
    events = spark.createDataFrame(data, schema)
    want = confidence.confidence_state(
        confidence.replay_confidence(confidence.effective_outcomes(events))
    )
    got = live.current_confidence(spark, path, buckets=3)
    assert rows(got.select(want.columns)) == rows(want)


def test_late_milestones_go_aside_and_come_back(spark, tmp_path):
    batches = [
        [(1, "p", "a", at(0)), (2, "p", "b", at(120))],
        [(3, "p", "c", at(90)), (4, "p", "late", at(30)), (5, "q", "d", at(200))],
        [(6, "q", "late", at(100)), (7, "q", "e", at(150))],
        [(8, "q", "late", at(139)), (9, "p", "f", at(300))],
        [(10, "p", "late", at(239)), (11, "p", "g", at(240))],
    ]
    path = str(tmp_path / "state")
    feed(spark, tmp_path, batches, live.MILESTONES, lambda s: live.live_milestones(s, path, 3_600, once=True))
    assert rows(live.late_milestones(spark, path), "id") == [10, 4, 6, 8]
    back = live.all_milestones(spark, path).collect()
    assert [r.id for r in back if r.persona == "p"] == [1, 4, 3, 2, 10, 11, 9]
    assert {r.id for r in back} == set(range(1, 12))


def test_late_steps_go_aside(spark, tmp_path):
    batches = [
        [(1, 2, "a", "x"), (1, 1, "a", "x"), (2, 1, "b", None)],
        [(1, 1, "late", "x"), (1, 3, "a", "x"), (2, 3, "b", None), (2, 2, "b", None)],
        [(1, 4, "a", "x"), (2, 3, "late", "y")],
    ]
    path = str(tmp_path / "state")
    feed(spark, tmp_path, batches, live.STEPS, lambda s: live.live_stuck(s, path, once=True, buckets=3))
    assert rows(live.stuck_alerts(spark, path)) == [(1, 3, "a", "x"), (2, 3, "b", None)]
    assert rows(live.late_steps(spark, path)) == [(1, 1, "late", "x"), (2, 3, "late", "y")]


def test_late_outcomes_go_aside(spark, tmp_path):
    batches = [
        [(2, "a.com", "login", 1, "success", at(2)), (1, "a.com", "login", 1, "save", at(1))],
        [(4, "a.com", "login", 2, "fast_fail", at(4)), (0, "a.com", "login", 1, "delete", at(0))],
        [(5, "a.com", "login", 2, "success", at(5)), (6, "a.com", "login", 3, "success", at(6))],
    ]
    path = str(tmp_path / "state")
    feed(spark, tmp_path, batches, live.OUTCOMES, lambda s: live.live_confidence(s, path, once=True, buckets=3))
    got = live.current_confidence(spark, path, buckets=3)
    assert rows(got, "confidence", "created", "last_verified", "last_failed") == [(2, at(1), at(6), at(4))]
    assert rows(live.late_outcomes(spark, path), "id") == [0]


def test_repeated_and_missing_values_in_recent_actions(spark, tmp_path):
    row = (1, "p", None, None, at(1))
    batches = [[row, row, (2, "p", "b", "", None)], [(None, None, "c", "d", at(2))]]
    path = str(tmp_path / "state")
    feed(spark, tmp_path, batches, live.ACTIONS, lambda s: live.live_recent(s, path, 2, once=True, buckets=3))
    assert rows(live.recent_actions(spark, path, 2, buckets=3)) == [row, row, (None, None, "c", "d", at(2))]


def test_folder_needs_a_shared_place_on_a_cluster(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = folders.work_folder(spark)
    assert folder == shared.rstrip("/") if shared else folder


def test_state_keeps_two_copies_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    held = state.BucketedState(str(tmp_path / "s"), live.ACTIONS, ["persona"], 2)
    fold = lambda fresh: lambda base: log.recent_n(base.unionByName(fresh), n=2).select(*base.columns)
    for batch in range(6):
        data = [(10 * batch + i, p, "open", "", at(batch)) for i, p in enumerate("abc") if batch < 3 or p == "a"]
        fresh = spark.createDataFrame(data, live.ACTIONS)
        held.advance(batch, fresh, fold(fresh))
        seen = rows(held.read(spark))
        held.advance(batch, fresh, fold(fresh))
        assert rows(held.read(spark)) == seen
    assert [r[0] for r in seen if r[1] == "a"] == [40, 50]
    assert [r[0] for r in seen if r[1] == "b"] == [11, 21]
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() <= 2 * 3 * 2 and stored.select("__place").distinct().count() <= 4


def test_a_run_that_fails_and_ends_three_days_later(spark, tmp_path):
    day = 24 * 60
    data = [(1, "a.com", "x", None, "save", at(0)), (2, "a.com", "x", 7, "fast_fail", at(1))]
    data += [(2 + d, "a.com", "x", 7, "success", at(d * day)) for d in (1, 2, 3)]
    data += [(9, "a.com", "x", 8, "success", at(3 * day + 1))]
    path = str(tmp_path / "state")
    feed(spark, tmp_path, cut(data, 6), live.OUTCOMES, lambda s: live.live_confidence(s, path, once=True, run_ms=2 * live.DAY_MS, buckets=2))
    want = confidence.replay_state(confidence.effective_outcomes(spark.createDataFrame(data, live.OUTCOMES)))
    got = live.current_confidence(spark, path, buckets=2)
    assert rows(got.select(want.columns)) == rows(want)
    kept = live._held_recipes(path, 2).read(spark).where("run_id IS NOT NULL")
    assert rows(kept, "run_id", "last") == [(7, at(3 * day))]


def test_one_file_per_micro_batch_and_a_busy_run(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "state")
    steps = spark.range(1, 3_001).selectExpr(
        "IF(id % 3 = 0, id, 1) AS run_id", "id AS step", "IF(id > 2500, 'same', string(id)) AS action_taken", "'x' AS page_type"
    )
    for part in range(3):
        steps.where(f"(step - 1) div 1000 = {part}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(live.STEPS).option("maxFilesPerTrigger", 1).parquet(source)
    query = live.live_stuck(stream, path, once=True, buckets=2)
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [1_000, 1_000, 1_000]
    want = runs.stuck_points(steps)
    assert rows(live.stuck_alerts(spark, path)) == rows(want.select(live.stuck_alerts(spark, path).columns)) != []


def test_a_span_reads_its_own_events_only(spark, tmp_path, monkeypatch):
    from ledgerline.plans import stream_queries as Q

    n, read = 80, spark.sparkContext.accumulator(0)
    data = [(i, at(i), i % 3, "view", 1.0, "") for i in range(n)]

    def counted(row):
        read.add(1)
        return row

    def source(spark, d, name):
        return spark.createDataFrame(spark.sparkContext.parallelize(data, 4).map(counted), Q.I.SOURCES[name])

    monkeypatch.setattr(Q.I, "source", source)
    monkeypatch.setattr(Q, "PART_ROWS", 20)  # four spans
    path = str(tmp_path / "s")
    Q._arrivals(spark, "", path, lambda e: live.live_recent(Q.I.as_actions(e), path, n=n, once=True, buckets=2))
    assert sorted(r.id for r in live.recent_actions(spark, path, n=n, buckets=2).collect()) == list(range(n))
    assert read.value <= 3 * n  # once for the ends of the table, once to deal it; it was once per span
