from __future__ import annotations

import random

import pytest

from ledgerline import schemas
from ledgerline.operators import filters, joins, log
from tests.helpers import at, rows

FLOWS = "domain string, action string, confidence int"


def test_tiered_match(spark):
    flows = spark.createDataFrame(
        [
            ("example.com", "search", 1), ("example.com", "login", 4), ("shop.example.com", "buy", 2),
            ("b.co.uk", "read", 1), ("other.net", "x", 1), ("", "broken", 1),
        ],
        FLOWS,
    )
    urls = spark.createDataFrame(
        [
            (1, "https://www.example.com/a"), (2, "old.example.com"), (3, "https://shop.example.com/"),
            (4, "https://a.co.uk"), (5, "https://nothing.org"), (6, ""),
        ],
        "page_id bigint, url string",
    )
    matches = joins.match_flows(urls, flows)
    got = matches.select("page_id", "match_tier", "match_key", "n_flows", "flow_domain", "flow_action")
    assert rows(got) == [
        (1, "exact", "example.com", 2, "example.com", "login"),
        (2, "base", "example.com", 3, "example.com", "login"),
        (3, "exact", "shop.example.com", 1, "shop.example.com", "buy"),
        (4, "base", "co.uk", 1, "b.co.uk", "read"),
        (5, "none", None, 0, None, None),
        (6, "none", None, 0, None, None),
    ]
    listed = joins.recipe_lists(matches, flows)
    assert rows(listed, "match_tier", "match_key", "domain", "action") == [
        ("base", "co.uk", "b.co.uk", "read"),
        ("base", "example.com", "example.com", "login"),
        ("base", "example.com", "example.com", "search"),
        ("base", "example.com", "shop.example.com", "buy"),
        ("exact", "example.com", "example.com", "login"),
        ("exact", "example.com", "example.com", "search"),
        ("exact", "shop.example.com", "shop.example.com", "buy"),
    ]


def test_login_urls(spark):
    steps = schemas.STEPS
    flows = spark.sql(
        f"""SELECT domain, action, from_json(steps, '{steps}') AS steps FROM VALUES
        ('a.com', 'login', '[{{"action":"click"}},{{"action":"navigate","url":""}},{{"action":"navigate","url":"https://a.com/in"}}]'),
        ('b.com', 'login', '[{{"action":"click","url":"https://no"}}]'),
        ('c.com', 'read', '[{{"action":"navigate","url":"https://c.com/in"}}]') AS t(domain, action, steps)"""
    )
    accounts = spark.createDataFrame(
        [(1, "a.com"), (2, "b.com"), (3, "c.com"), (4, "forum")], "id bigint, service string"
    )
    assert rows(joins.login_urls(accounts, flows), "id", "login_url", "status_code") == [
        (1, "https://a.com/in", "flow"),
        (2, "https://b.com", "service"),
        (3, "https://c.com", "service"),
        (4, None, "no_tld"),
    ]


def test_find_account_equals_scan(spark):
    rng = random.Random(5)
    parts = ["mail", "gmail.com", "GitHub.com", "hub", "x", "news.ycombo", "outlook"]
    accounts = [
        (i, f"p{rng.randrange(6)}", rng.choice(parts) + rng.choice(["", ".org"]), at(rng.randrange(50)))
        for i in range(120)
    ]
    asked = [(i, f"p{rng.randrange(7)}", rng.choice(["Mail", "hub", "HUB.com", "", "o", "zz", "outlook.org"]))
             for i in range(200)]
    want = []
    for req, persona, name in asked:
        hits = [a for a in accounts if a[1] == persona and name.lower() in a[2].lower()]
        best = min(hits, key=lambda a: (a[3], a[0]), default=None)
        want.append((req, best[0] if best else None, best[2] if best else None))
    a = spark.createDataFrame(accounts, "id bigint, persona string, service string, created_at timestamp")
    r = spark.createDataFrame(asked, "req_id bigint, persona string, service string")
    got = joins.find_account(r, a).select("req_id", "account_id", "account_service")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_summary_orphans_and_conflicts(spark):
    people = spark.createDataFrame([("a",), ("b",)], "name string")
    accounts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "gone")], "id bigint, persona string")
    assert rows(joins.persona_summary(people, accounts)) == [("a", 2), ("b", 0)]
    assert rows(joins.orphans(accounts, people, ("persona", "name")), "id") == [3]
    free, taken = joins.split_conflicts(spark.createDataFrame([("a",), ("c",)], "name string"), people, ["name"])
    assert (rows(free), rows(taken)) == (["c"], ["a"])


def test_primary_email(spark):
    accounts = spark.createDataFrame(
        [
            (1, "p", "Gmail", "old@x", "blocked", at(0)), (2, "p", "OUTLOOK.com", "first@x", "active", at(1)),
            (3, "p", "gmail", "second@x", "active", at(2)), (4, "q", "gmail.com", "no@x", "active", at(0)),
        ],
        "id bigint, persona string, service string, email string, status string, created_at timestamp",
    )
    assert rows(joins.primary_email(accounts)) == [("p", "first@x")]


def test_recent_n(spark):
    data = [(i, p, at(i if p != "tie" else 0)) for p, n in (("three", 3), ("twenty", 20), ("more", 21), ("tie", 25))
            for i in range(n)]
    actions = spark.createDataFrame(data, "id bigint, persona string, ts timestamp")
    got = log.recent_n(actions).collect()
    per = {p: [r.id for r in got if r.persona == p] for p in ("three", "twenty", "more", "tie")}
    assert per == {
        "three": [0, 1, 2], "twenty": list(range(20)), "more": list(range(1, 21)), "tie": list(range(5, 25)),
    }
    many = log.newest(actions, ["persona"], ["ts", "id"], 5_000)
    assert many.count() == len(data)
    assert log.last_n(actions, n=0).count() == len(data)


def test_log_slice_takes_the_cap_first(spark):
    actions = spark.createDataFrame([(i, "p", at(i)) for i in range(10)], "id bigint, persona string, ts timestamp")
    since = spark.createDataFrame([("p", at(2))], "persona string, since timestamp")
    assert rows(log.log_slice(actions, since, cap=5), "id") == [5, 6, 7, 8, 9]
    assert rows(log.log_slice(actions, since, cap=100), "id") == list(range(2, 10))


def test_date_breaks(spark):
    data = [(1, "p", at(0)), (2, "p", at(0)), (3, "p", at(60 * 24)), (4, "q", at(5)), (5, "p", at(60 * 24 + 1))]
    got = log.with_date_breaks(spark.createDataFrame(data, "id bigint, persona string, ts timestamp"))
    assert rows(got, "id", "new_date") == [(1, True), (2, False), (3, True), (4, True), (5, False)]


def entries(spark, *data):
    return spark.createDataFrame(
        [(i, "p", text, None if tags is None else tags, None if live else at(9)) for i, (text, tags, live) in enumerate(data)],
        "id bigint, persona string, summary string, tags string, deleted_at timestamp",
    )


def test_search(spark):
    df = entries(
        spark, ("Has 100% a_b", "x", True), ("has axb", None, True), ("back\\slash", "x", True), ("HAS gone", "x", False)
    )
    assert rows(filters.search_context(df, "has"), "id") == [0, 1]
    assert rows(filters.search_context(df, "a_b"), "id") == [0]
    assert rows(filters.search_context(df, "A_B", wildcards=True), "id") == [0, 1]
    assert rows(filters.search_context(df, "%", wildcards=False), "id") == [0]
    assert rows(filters.search_context(df, "k\\s", wildcards=True), "id") == [2]
    assert rows(filters.search_context(df, "has", tags="x"), "id") == [0]


def test_tags(spark):
    df = entries(spark, ("a", " a , b ", True), ("b", None, True), ("c", "ab", True))
    assert rows(filters.with_any_tag(df, "b,c"), "id") == [0]
    assert rows(filters.with_any_tag(df, ","), "id") == []
    assert rows(filters.with_any_tag(df, ""), "id") == [0, 1, 2]
    tagged = spark.createDataFrame([(1, ["post"]), (2, ["posts"]), (3, ["café"])], "id int, tags array<string>")
    assert rows(filters.with_tag(tagged, "post"), "id") == [1]
    assert rows(filters.with_tag(tagged, "café"), "id") == [3]


def test_redaction(spark):
    df = spark.createDataFrame([("u", "pw", "local/x", "")], "username string, Password string, creds_ref string, token string")
    assert rows(filters.redact(df)) == [("u", "***", "***", "")]
    assert filters.redact(df, "drop").columns == ["username"]
    fields = spark.createDataFrame([("e", "Recovery", "v"), ("e", "url", "v")], "entry string, field string, value string")
    assert rows(filters.redact_fields(fields), "value") == ["***", "v"]
    assert rows(filters.redact_fields(fields, mode="drop"), "field") == ["url"]


def test_entries_for(spark):
    listed = spark.createDataFrame(
        [("ns/a/mail",), ("ns/a/x/y",), ("ns/ab/mail",), ("other/a/z",), ("ns/a",), ("ns/t/u/v",)], "entry string"
    )
    people = spark.createDataFrame([("a",), ("none",), ("t/u",)], "name string")
    assert rows(filters.entries_for(listed, people, "ns")) == [
        ("a", "ns/a/mail", "mail", False),
        ("a", "ns/a/x/y", "x/y", False),
        ("none", None, None, True),
        ("t/u", "ns/t/u/v", "v", False),
    ]


def test_latest_recording(spark):
    files = spark.createDataFrame([("d", "a.mp4"), ("d", "c.txt"), ("d", "b.mov")], "directory string, name string")
    assert rows(log.latest_recording(files)) == [("d", "b.mov")]


def test_long_service_names_have_a_linear_index(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("abc") for _ in range(10_000)) for _ in range(6)] + ["ab", "a", "É" * 50]
    accounts = [(i, "p", n, at(i)) for i, n in enumerate(names)]
    asked = [names[3][7_000:7_020], names[1][:9_000].upper(), names[2], "abcabcx", "é" * 50, "a", "ab", "", None]
    a = spark.createDataFrame(accounts, "id bigint, persona string, service string, created_at timestamp")
    r = spark.createDataFrame([(i, "p", q) for i, q in enumerate(asked)], "req_id bigint, persona string, service string")
    got = {x.req_id: x.account_id for x in joins.find_account(r, a).collect()}
    want = {}
    for i, q in enumerate(asked):
        want[i] = next((k for k, n in enumerate(names) if q is not None and q.lower() in n.lower()), None)
    assert got == want


def test_words_in_a_text_by_the_automaton():
    rng = random.Random(2)
    for _ in range(200):
        words = list({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(8)})
        text = "".join(rng.choice("abé ") for _ in range(rng.randrange(40)))
        assert joins.Automaton(words).words_in(text) == {w for w in words if w in text}


@pytest.mark.parametrize("pairs", [0, 1 << 40])
def test_a_page_with_many_elements_and_descriptions(spark, monkeypatch, pairs):
    monkeypatch.setattr(joins, "BLOCK", 300)
    monkeypatch.setattr(joins, "PAGE_PAIRS", pairs)
    elements = spark.range(3_000).selectExpr(
        "1L AS page_id", "int(id) AS pos", "concat('Item', id % 700, 'x') AS text", "CAST(NULL AS STRING) AS ariaLabel",
        "'' AS placeholder", "'' AS name",
    )
    targets = spark.range(1_500).selectExpr("id AS req_id", "1L AS page_id", "concat('  nothing iTem', id, 'X ') AS description")
    odd = spark.createDataFrame([(9_000, 1, None), (9_001, 1, " "), (9_002, 2, "item1x")], "req_id long, page_id long, description string")
    got = {r.req_id: r.pos for r in joins.match_elements(targets.unionByName(odd), elements).collect()}
    want = {i: (i if i < 700 else None) for i in range(1_500)} | {9_000: None, 9_001: None, 9_002: None}
    assert got == want
