"""Run operators against step-by-step readings of the rules."""

from __future__ import annotations

import random

import pytest

from ledgerline.operators import runs
from tests.helpers import rows

STEPS = (
    "run_id bigint, step int, url string, page_type string, description string, "
    "action_taken string, tier string, confidence double"
)


def make(spark, listed):
    return spark.createDataFrame(
        [
            (run, step, "", page, f"d{step}", action, tier, conf)
            for run, step, action, page, tier, conf in listed
        ],
        STEPS,
    )


def first_stuck(listed, k=3):
    for i in range(k - 1, len(listed)):
        last = listed[i - k + 1 : i + 1]
        if all((s[2], s[3]) == (last[0][2], last[0][3]) for s in last):
            return listed[i][1]
    return None


def outcome(listed, max_steps):
    for i, (_run, step, action, page, tier, conf) in enumerate(listed):
        if action == "done":
            return "done", step
        if first_stuck(listed[max(0, i - 2) : i + 1]) and action not in runs.CONTINUED:
            return "stuck", step
        if conf < 0.5 and tier == "heuristics":
            return "needs_guidance", step
        if action == "abort":
            return "aborted", step
    last = listed[-1][1]
    return ("max_steps" if last >= max_steps else "in_progress"), last


@pytest.mark.parametrize("seed", [2, 3])
def test_stuck_points_equal_scan(spark, cut_all, seed):
    rng = random.Random(seed)
    per_run = {
        run: [(run, s, rng.choice("ab"), rng.choice("xy"), "api", 0.9)
              for s in range(1, rng.randrange(2, 40))]
        for run in range(60)
    }
    want = sorted((r, s) for r, listed in per_run.items() if (s := first_stuck(listed)))
    steps = make(spark, [x for listed in per_run.values() for x in listed])
    assert sorted(rows(runs.stuck_points(steps), "run_id", "stuck_step")) == want


def test_outcomes_equal_scan(spark):
    rng = random.Random(7)
    actions = ["click", "fill", "scroll", "press", "open"] * 4 + [
        "done", "abort", "recaptcha_checkbox_passed", "recaptcha_checkbox_passed",
    ]
    per_run = {
        run: [
            (run, s, rng.choice(actions), rng.choice(["login", "captcha"]),
             rng.choice(["api"] * 9 + ["heuristics"]), rng.random())
            for s in range(1, rng.randrange(2, 19))
        ]
        for run in range(300)
    }
    want = sorted((run, *outcome(listed, 10)) for run, listed in per_run.items())
    steps = make(spark, [x for listed in per_run.values() for x in listed])
    got = runs.classify_runs(steps)
    assert sorted(tuple(r) for r in got.select("run_id", "outcome", "end_step").collect()) == want
    assert {w[1] for w in want} == {
        "done", "stuck", "needs_guidance", "aborted", "max_steps", "in_progress",
    }


def test_precedence(spark):
    page = "login"
    listed = [
        *[(1, s, "done" if s == 3 else "click", page, "api", 0.9) for s in (1, 2, 3)],
        *[(2, s, "click", page, "heuristics" if s == 3 else "api", 0.1) for s in (1, 2, 3)],
        (3, 1, "click", page, "api", 0.1),
        *[(4, s, "click", "abc"[s % 3], "api", 0.9) for s in range(1, 11)],
        *[(5, s, "click", page, "api", 0.9) for s in (1, 2)],
        (5, 3, "recaptcha_checkbox_passed", page, "api", 0.9),
    ]
    got = dict(rows(runs.classify_runs(make(spark, listed)), "run_id", "outcome"))
    assert got == {1: "done", 2: "stuck", 3: "in_progress", 4: "max_steps", 5: "in_progress"}


def test_run_starts_decide_first(spark):
    steps = make(spark, [(1, 1, "done", "x", "api", 0.9), (2, 1, "done", "x", "api", 0.9)])
    starts = spark.createDataFrame(
        [(1, True, False), (2, True, True), (3, False, False)],
        "run_id bigint, navigate_ok boolean, fast_path_ok boolean",
    )
    got = rows(runs.classify_runs(steps, starts), "run_id", "outcome", "end_step")
    assert got == [(1, "done", 1), (2, "fast_path", None), (3, "navigate_failed", None)]


def test_history_crosses_ranges_and_gaps(spark, cut_all):
    steps = make(spark, [(1, s, "go", "p", "api", 0.5) for s in (1, 2, 5, 9, 40)])
    got = {r.step: r.history.split("\n") for r in runs.with_history(steps).collect()}
    assert got[1] == [""]
    assert got[2] == ["  Step 1: d1 -> go (conf: 0.5)"]
    assert [line[:8] for line in got[40]] == ["  Step 2", "  Step 5", "  Step 9"]


def test_replay_summary(spark):
    recipes = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (4, 0)], "run_id bigint, total_steps int")
    results = spark.createDataFrame(
        [
            (1, 0, True, None, None), (1, 1, True, None, None), (1, 2, True, None, None),
            (2, 0, True, None, None), (2, 1, False, "url_mismatch", "other host"),
            (3, 0, True, None, None), (3, 1, False, "selector", "Selector not found: #x"),
            (3, 2, False, "error", "late"),
        ],
        "run_id bigint, step int, ok boolean, cause string, reason string",
    )
    assert rows(runs.replay_summary(recipes, results)) == [
        (1, True, 3, 3, None, ""),
        (2, False, 2, 3, 1, "other host"),
        (3, False, 1, 3, 1, "Selector not found: #x"),
        (4, False, 0, 0, None, "No steps in recipe"),
    ]


def test_checkpoints(spark):
    steps = spark.createDataFrame(
        [(1, 0, "a.com/x"), (1, 1, ""), (1, 2, "b.com"), (2, 0, "a.com"), (3, 0, "a.com")],
        "run_id bigint, step int, expected_url string",
    )
    observed = spark.createDataFrame(
        [(1, 0, "https://www.a.com/other"), (1, 1, "z.com"), (1, 2, "https://c.com"), (2, 0, "")],
        "run_id bigint, step int, url string",
    )
    assert rows(runs.audit_checkpoints(steps, observed)) == [
        (1, 2, "b.com", "c.com", 2),
        (2, 0, "a.com", "", 1),
        (3, None, None, None, 1),
    ]


def test_verified_steps_and_caveats(spark):
    kind = "run_id bigint, action string, selector string, url string"
    claims = spark.createDataFrame(
        [(1, "click", "#a", ""), (1, "click", "#b", ""), (1, "navigate", None, "u"), (2, "click", "#a", "")],
        kind,
    )
    log = spark.createDataFrame([(1, "click", "#a", "u"), (1, "navigate", "", "u")], kind)
    backed, rest = runs.verify_steps(claims, log)
    assert rows(backed, "run_id", "selector") == [(1, "#a"), (1, None)]
    assert rows(rest, "run_id", "selector") == [(1, "#b"), (2, "#a")]
    caveats = spark.createDataFrame([(1, "slow"), (2, "moves")], "run_id bigint, caveat string")
    results = spark.createDataFrame([(1, True), (2, False)], "run_id bigint, ok boolean")
    assert rows(runs.verify_caveats(caveats, results), "caveat") == ["moves"]


def test_limits_per_run_and_long_runs(spark, cut_all):
    calm = lambda run, n: [(run, s, "click", "abcd"[s % 4], "api", 0.9) for s in range(1, n)]
    listed = [*calm(1, 15), (1, 15, "done", "x", "api", 0.9), *calm(2, 6), *calm(3, 6), *calm(4, 31)]
    starts = spark.createDataFrame(
        [(1, True, False, 10), (2, True, False, 5), (3, True, False, 10), (4, True, False, None)],
        "run_id bigint, navigate_ok boolean, fast_path_ok boolean, max_steps int",
    )
    got = rows(runs.classify_runs(make(spark, listed), starts, max_steps=30), "run_id", "outcome", "end_step")
    assert got == [(1, "done", 15), (2, "max_steps", 5), (3, "in_progress", 5), (4, "max_steps", 30)]
