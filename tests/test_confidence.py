"""Confidence replay against a plain fold over the rules."""

from __future__ import annotations

import random

import pytest

from ledgerline.operators import confidence, ordered
from tests.helpers import at, rows

EVENTS = "id bigint, domain string, action string, run_id bigint, outcome string, ts timestamp"
BASE = (
    "domain string, action string, confidence int, created timestamp, "
    "last_verified timestamp, last_failed timestamp"
)


def fold(events, base):
    """State after each event id, event by event."""
    states, out = {}, {}
    for domain, action, level, created, verified, failed in base:
        states[domain, action] = [level, created, verified, failed]
    for id_, domain, action, _run, outcome, ts in sorted(events, key=lambda e: (e[5], e[0])):
        key = domain, action
        state = states.get(key)
        if outcome == "save":
            if state is None:
                state = states[key] = [1, ts, ts, None]
            else:
                state[0], state[2] = 1, ts
        elif outcome == "delete":
            states.pop(key, None)
            state = None
        elif state is not None and outcome == "success":
            state[0], state[2] = min(10, state[0] + 1), ts
        elif state is not None and outcome == "fast_fail":
            state[0], state[3] = 1, ts
        out[id_] = tuple(state) if state else (None,) * 4
    return out


@pytest.mark.parametrize("seed", [60, 1_800])
@pytest.mark.parametrize("with_base", [False, True])
@pytest.mark.parametrize("hot_rows", [0, 130, 10**6])
def test_replay_equals_fold(spark, monkeypatch, seed, with_base, hot_rows):
    """hot_rows: every key cut, some of them, none."""
    monkeypatch.setattr(ordered, "HOT_ROWS", hot_rows)
    rng = random.Random(seed + with_base)
    names = ["success"] * 6 + ["save", "fast_fail", "delete"]
    events = [
        (i, f"s{int(rng.random() ** 2 * 20)}.com", "login", None, rng.choice(names), at(rng.randrange(2_000)))
        for i in range(3_000)
    ]
    base = []
    if with_base:
        base = [
            (f"s{i}.com", "login", rng.randrange(11), at(-100 - i), at(-50) if i % 2 else None,
             at(-20) if i % 3 else None)
            for i in range(0, 20, 2)
        ]
    got = confidence.replay_confidence(
        spark.createDataFrame(events, EVENTS),
        spark.createDataFrame(base, BASE) if with_base else None,
    )
    want = fold(events, base)
    seen = {r[0]: tuple(r[1:]) for r in rows(
        got, "id", "confidence", "created", "last_verified", "last_failed")}
    assert seen == want
    state = confidence.replay_state(
        spark.createDataFrame(events, EVENTS), spark.createDataFrame(base, BASE) if with_base else None
    )
    assert rows(state) == rows(confidence.confidence_state(got).select(state.columns))
    assert state.count() > 5


def case(spark, *outcomes):
    events = [
        (i, "a.com", "login", run, outcome, at(i)) for i, (outcome, run) in enumerate(outcomes)
    ]
    effective = confidence.effective_outcomes(spark.createDataFrame(events, EVENTS))
    trace = confidence.replay_confidence(effective)
    return [r.confidence for r in trace.orderBy("id").collect()], trace


def test_success_after_failure_in_the_same_run_does_not_count(spark):
    got, _ = case(spark, ("save", 1), *[("success", i) for i in range(2, 14)], ("fast_fail", 20),
                  ("success", 20), ("success", 21))
    assert got == [1, *range(2, 11), 10, 10, 10, 1, 2]


def test_runs_without_id_all_count(spark):
    got, _ = case(spark, ("save", None), ("fast_fail", None), ("success", None))
    assert got == [1, 1, 2]


def test_upsert_keeps_failure_and_delete_clears_it(spark):
    got, trace = case(spark, ("save", 1), ("fast_fail", 2), ("save", 3), ("delete", 4), ("success", 5),
                      ("save", 6))
    assert got == [1, 1, 1, None, None, 1]
    failures = [r.last_failed for r in trace.orderBy("id").collect()]
    assert failures == [None, at(1), at(1), None, None, None]
    state = confidence.confidence_state(trace).collect()[0]
    assert (state.created, state.tier) == (at(5), "guided")


def test_deleted_recipe_has_no_state(spark):
    _, trace = case(spark, ("save", 1), ("delete", 2))
    assert confidence.confidence_state(trace).count() == 0


def test_marked_outcomes_are_not_marked_again(spark):
    events = [(1, "d", "a", 1, "fast_fail", at(1)), (2, "d", "a", 1, "success", at(2)), (3, "d", "a", 2, "success", at(3)),
              (4, "d", "a", None, "success", at(4)), (5, "e", "a", 7, "success", at(5))]
    outcomes = spark.createDataFrame(events, EVENTS)
    earlier = spark.createDataFrame([("e", "a", 7, at(0), 0)], "domain string, action string, run_id bigint, ts timestamp, id bigint")
    marked = confidence.with_failed(outcomes, earlier)
    assert {r.id: r["__failed"] and r["__failed"].id for r in marked.collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: 0}
    assert "Join" not in confidence.effective_outcomes(marked.localCheckpoint())._jdf.queryExecution().toString()
    assert rows(confidence.effective_outcomes(marked)) == rows(confidence.effective_outcomes(outcomes, earlier))
    assert {r.id for r in confidence.effective_outcomes(marked).collect()} == {1, 3, 4}
