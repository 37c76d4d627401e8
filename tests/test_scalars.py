from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars as X


def values(spark, inputs, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_domains(spark):
    cases = {
        "https://www.example.com/a?b#c": ("example.com", "example.com"),
        "old.example.com/x": ("old.example.com", "example.com"),
        "http://user@Shop.Example.com:8080/": ("shop.example.com", "example.com"),
        "https://my_host.example.com/": ("my_host.example.com", "example.com"),
        "https://www.www.example.com": ("www.example.com", "example.com"),
        "https://a.co.uk": ("a.co.uk", "co.uk"),
        "http://a@b@c.com/": ("c.com", "c.com"),
        "example.com/a?u=http://x": ("example.com", "example.com"),
        "https://[::1]:8024/x": ("::1", "::1"),
        "https://example.com/a b": ("example.com", "example.com"),
        "": ("", ""),
        None: ("", ""),
    }
    assert values(spark, cases, X.extract_domain) == [d for d, _ in cases.values()]
    assert values(spark, cases, lambda c: X.base_domain(X.extract_domain(c))) == [
        b for _, b in cases.values()
    ]


def test_parse_ts(spark):
    ok = {
        "2026-03-07T11:05:09": datetime(2026, 3, 7, 11, 5, 9),
        "2026-03-07T11:05": datetime(2026, 3, 7, 11, 5),
        "2026-03-07": datetime(2026, 3, 7),
        "2026-3-7": datetime(2026, 3, 7),
        "2026-3-7T1:2:3": datetime(2026, 3, 7, 1, 2, 3),
    }
    bad = ["2026-03-07 11:05:09", "2026-03-07T11:05:09Z", "2026-03-07 later", "2026-02-30", "soon"]
    assert values(spark, [*ok, *bad], X.parse_ts) == [*ok.values(), *[None] * len(bad)]


def test_format_ts(spark):
    given = [datetime(2026, 3, 7, 9, 5, 59), datetime(1970, 1, 1), None]
    assert values(spark, given, X.format_ts, "timestamp") == ["2026-03-07 09:05", "never", "never"]


def test_slug_cuts_before_dropping(spark):
    assert values(spark, ["Posted: my first Café!", "a" * 39 + "!b"], X.slug) == [
        "posted-my-first-café",
        "a" * 39,
    ]


def test_previews(spark):
    text = "abcdef\nsecond"
    assert values(spark, [text], lambda c: X.preview(c, 3)) == ["abc"]
    assert values(spark, [text, "ab"], lambda c: X.preview(c, 3, "if_cut")) == ["abc...", "ab"]
    assert values(spark, ["ab"], lambda c: X.preview(c, 3, "always")) == ["ab..."]
    assert values(spark, [text], lambda c: X.first_line(c, 4)) == ["abcd"]


def test_credential_refs(spark):
    cases = {
        "gopass://docker:abc123/ns/p/s": ("docker:abc123", "ns/p/s"),
        "gopass://ns/p/s": ("", "ns/p/s"),
        "local/ns/p": ("local", "ns/p"),
        "docker:abc": (None, None),
        "codespace:x/y": ("codespace:x", "y"),
    }
    assert [tuple(r) for r in values(spark, cases, X.parse_creds_ref)] == list(cases.values())
    assert values(spark, ["ns/p", "gopass://docker:a/b"], lambda c: X.prefix_ref(c, "local")) == [
        "gopass://local/ns/p",
        "gopass://docker:a/b",
    ]


def test_flow_ref(spark):
    got = values(spark, ["a.com/login", "a.com/x/y", "nothing"], X.flow_ref)
    assert [tuple(r) if r else None for r in got] == [("a.com", "login"), ("a.com", "x/y"), None]


def test_tags(spark):
    assert values(spark, [" a , b ", ",", None, "a"], X.split_tags) == [["a", "b"], [], [], ["a"]]
    assert values(spark, [["a", "b"], []], X.render_tags, "array<string>") == [" [a, b]", ""]
    assert values(spark, [["a", "b"]], lambda c: X.render_tags(c, "code"), "array<string>") == [
        "`a` `b`"
    ]


def test_tiers(spark):
    assert values(spark, [0, 2, 3, 5, 6, 10], X.confidence_tier, "int") == [
        "guided", "guided", "fast", "fast", "turbo", "turbo",
    ]
    assert values(spark, [3], lambda c: X.confidence_tier(c, "fast path"), "int") == ["fast path"]


@pytest.mark.parametrize(
    "text, k",
    [
        ('{"k": 1}', 1),
        ('  {"k": 2}\n', 2),
        ('Sure:\n```json\n{"k": 3}\n```\nbye', 3),
        ('```\n{"k": 4}\n```', 4),
        ('```json\n{"k": 5}', 5),
        ('I think {"k": 6} is right', 6),
        ('```json\nbroken\n``` but {"k": 7}', 7),
        ("{broken", None),
        ("no json here", None),
        ("", None),
    ],
)
def test_extract_json(spark, text, k):
    got = values(spark, [text], lambda c: F.try_variant_get(X.extract_json(c), "$.k", "int"))
    assert got == [k]


def test_extract_json_takes_any_type(spark):
    assert values(spark, ["[1, 2]"], lambda c: F.schema_of_variant(X.extract_json(c))) == [
        "ARRAY<BIGINT>"
    ]


def test_step_layouts(spark):
    raw = (
        '[{"action": "navigate", "url": "https://a.com", "expected_url": ""},'
        ' {"action": "click", "selector": "#b", "expected_url": "a.com", "detail": "go"}, {}]'
    )
    assert values(spark, [raw], lambda c: X.step_lines(X.json_steps(c))) == [
        ["    1. navigate", "    2. click selector=#b expect_url=a.com (go)", "    3. ?"]
    ]
    assert values(spark, [raw], lambda c: X.step_lines(X.json_steps(c), "show"))[0][1] == (
        "  2. click | sel=#b | expect=a.com | go"
    )
    assert values(spark, [raw], lambda c: X.step_lines(X.json_steps(c), "detail"))[0][1] == (
        "  2. click selector=#b expect=a.com (go)"
    )
    assert values(spark, ["nope"], X.json_steps) == [None]


def test_seconds_and_durations(spark):
    got = values(spark, [1772366400.5], X.epoch_seconds_to_ts, "double")
    assert got == [datetime(2026, 3, 1, 12, 0, 0, 500000)]
    assert values(spark, ["hello"], X.fill_duration) == [60]
