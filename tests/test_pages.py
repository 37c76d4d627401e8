"""Page rules: one page per type, the quirks, and a plain reading of the rules."""

from __future__ import annotations

import random

from ledgerline import schemas
from ledgerline.operators import joins, pages
from tests.helpers import rows

FIELDS = [f.split()[0] for f in schemas.TABLES["elements"].split(", ")]


def element_rows(spark, per_page):
    data = []
    for page_id, listed in per_page.items():
        for pos, el in enumerate(listed):
            row = dict.fromkeys(FIELDS, "")
            row.update(el, page_id=page_id, pos=pos, visible=True)
            data.append(tuple(row[f] for f in FIELDS))
    return spark.createDataFrame(data, schemas.TABLES["elements"])


def classify(spark, per_page, titles=None):
    meta = spark.createDataFrame(
        [(p, (titles or {}).get(p, "")) for p in per_page], "page_id bigint, title string"
    )
    got = pages.classify_pages(element_rows(spark, per_page), meta).collect()
    return {r.page_id: r for r in got}


PASSWORD = {"tag": "INPUT", "type": "password"}
EMAIL = {"tag": "input", "type": "email"}
TEXT = {"tag": "input", "type": "text"}
TERMS = {"tag": "input", "type": "checkbox", "name": "tos"}
LINK = {"tag": "a", "text": "About"}


def frame(src):
    return {"tag": "iframe", "src": src}


def test_each_type(spark):
    per_page = {
        1: [frame("https://www.google.com/reCAPTCHA/x"), {"tag": "button", "text": "Accept cookies"}],
        2: [frame("https://client-api.arkoselabs.com/"), LINK],
        3: [frame("https://hcaptcha.com/x")],
        4: [frame("https://captcha.example/x")],
        5: [{"tag": "button", "text": "OK", "id": "cookie-yes"}, PASSWORD],
        6: [LINK],
        7: [PASSWORD, EMAIL, TEXT, TERMS],
        8: [PASSWORD, EMAIL, TEXT, TEXT],
        9: [PASSWORD, EMAIL],
        10: [{"tag": "input", "name": "q", "type": "text"}],
        11: [LINK],
        12: [],
    }
    got = classify(spark, per_page, {6: "Page Not Found", 5: "error"})
    assert {p: (r.page_type, r.captcha_type) for p, r in got.items()} == {
        1: ("captcha", "recaptcha"),
        2: ("captcha", "arkose"),
        3: ("captcha", "hcaptcha"),
        4: ("captcha", "unknown"),
        5: ("cookie_banner", None),
        6: ("error", None),
        7: ("signup", None),
        8: ("signup", None),
        9: ("login", None),
        10: ("search", None),
        11: ("content", None),
        12: ("unknown", None),
    }
    assert [got[p].confidence for p in (1, 5, 6, 7, 9, 10, 11, 12)] == [
        0.9, 0.8, 0.85, 0.7, 0.8, 0.7, 0.4, 0.1,
    ]
    assert [got[p].action_type for p in (1, 5, 6, 9, 11)] == ["abort", "dismiss", "abort", "fill", "none"]
    assert got[7].detected.signup_form and got[7].detected.login_form


def test_quirks(spark):
    got = classify(
        spark,
        {
            1: [{"tag": "a", "text": "Cookie policy", "id": "c1"}],
            2: [LINK],
            3: [
                {"tag": "input", "name": "q", "id": "s1", "type": "text"},
                {"tag": "input", "placeholder": "Search", "type": "text", "name": "find"},
            ],
            4: [
                {"tag": "button", "text": "Accept", "id": "First"},
                {"tag": "button", "text": "Accept", "id": "second"},
            ],
            5: [{"tag": "textarea", "text": "accept cookies"}],
        },
        {2: "Top 500 songs"},
    )
    # The word cookie contains ok, so a link to the policy is a cookie button.
    assert (got[1].page_type, got[1].selector_hint, got[1].target) == ("cookie_banner", "#c1", "Cookie policy")
    assert (got[2].page_type, got[2].target) == ("error", "Top 500 songs")
    assert (got[3].page_type, got[3].selector_hint) == ("search", 'input[name="find"]')
    assert got[4].selector_hint == "#First"
    assert got[5].page_type == "content"


def plain(listed, title):
    """The rules, element by element."""

    def has(value, words):
        return any(w in value for w in words)

    cookie = search = captcha = terms = False
    passwords = inputs = 0
    for el in listed:
        e = {f: str(el.get(f, "")).lower() for f in FIELDS}
        tagged = has(e["text"], pages.COOKIE_TEXT) or any(
            has(e[f], pages.COOKIE_ATTRIBUTE) for f in ("class", "id")
        )
        if tagged and e["tag"] in pages.COOKIE_TAGS and has(e["text"], pages.COOKIE_CONFIRM):
            cookie = True
        passwords += e["type"] == "password"
        inputs += e["tag"] == "input" and e["type"] in pages.TEXT_INPUT_TYPES
        if e["tag"] == "input" and e["type"] == "checkbox":
            terms |= any(has(e[f], pages.TERMS_WORDS) for f in ("text", "ariaLabel", "name"))
        search |= e["role"] == "search" or e["name"] in pages.SEARCH_NAMES
        search |= e["tag"] == "input" and ("search" in e["type"] or "search" in e["placeholder"])
        captcha |= e["tag"] == "iframe" and has(e["src"], pages.CAPTCHA_HOSTS)
    if captcha:
        return "captcha"
    if cookie:
        return "cookie_banner"
    if has(title.lower(), pages.ERROR_TITLE):
        return "error"
    if passwords and inputs >= 2 and (terms or inputs >= 3):
        return "signup"
    if passwords and inputs <= 2:
        return "login"
    if search:
        return "search"
    return "content" if listed else "unknown"


def test_random_pages_equal_plain_reading(spark):
    rng = random.Random(3)
    options = {
        "tag": ["a", "INPUT", "input", "input", "button", "iframe", "select"],
        "type": ["", "text", "text", "password", "checkbox", "email", "Search"],
        "text": ["", "", "", "Accept", "Allow cookies", "I agree", "Buy", "OK"],
        "name": ["", "q", "terms", "email"],
        "class": ["", "gdpr-box", "x"],
        "src": ["", "", "https://recaptcha.net", "https://x.com"],
        "role": ["", "search", "button", "link", ""],
        "placeholder": ["", "", "", "Search"],
    }
    per_page = {
        p: [{k: rng.choice(v) for k, v in options.items()} for _ in range(rng.randrange(7))]
        for p in range(600)
    }
    titles = {p: rng.choice(["Home", "Home", "Error 1", "404"]) for p in per_page}
    got = classify(spark, per_page, titles)
    want = {p: plain(listed, titles[p]) for p, listed in per_page.items()}
    assert {p: r.page_type for p, r in got.items()} == want
    assert len(set(want.values())) == 8


def test_missing_columns_read_as_blank(spark):
    meta = spark.createDataFrame([(1, "")], "page_id bigint, title string")
    few = spark.createDataFrame([(1, 0, "input", "password")], "page_id bigint, pos int, tag string, type string")
    assert rows(pages.classify_pages(few, meta), "page_type") == ["login"]


def test_html_elements(spark):
    html = (
        '<html><title>T</title><script>var a = "<a>no</a>";</script><p>text</p>'
        '<a href="/x" class="nav">  One <b>two</b> </a><input name="q" placeholder="Search">'
        '<div role="button" aria-label="Go" id="g">Press</div><button>Send</button>'
        '<textarea name="t">abc</textarea></html>'
    )
    source = spark.createDataFrame([(1, html), (2, ""), (3, "<a>x</a>" * 60)], "page_id bigint, html string")
    got = pages.explode_elements(source)
    first = got.where("page_id = 1").orderBy("pos").collect()
    assert [(r.tag, r.text, r.type) for r in first] == [
        ("a", "One two", ""),
        ("input", "", "text"),
        ("div", "Press", ""),
        ("button", "Send", "submit"),
        ("textarea", "abc", ""),
    ]
    assert (first[2].ariaLabel, first[2].role, first[2].visible) == ("Go", "button", None)
    assert rows(got.groupBy("page_id").count()) == [(1, 5), (3, 60)]


def test_tiers(spark):
    kind = "page_id bigint, page_type string, confidence double, action_type string"
    meta = spark.createDataFrame([(1,), (2,), (3,)], "page_id bigint")
    api = spark.createDataFrame([(1, "login", 0.9, "fill"), (2, "", 0.9, "fill")], kind)
    cli = spark.createDataFrame([(1, "search", 0.8, "fill"), (2, "signup", 0.8, "fill")], kind)
    rules = spark.createDataFrame([(i, "content", 0.4, "none") for i in (1, 2, 3)], kind)
    got = pages.coalesce_tiers(meta, api, cli, rules)
    assert rows(got, "page_id", "page_type", "tier_used") == [
        (1, "login", "api"), (2, "signup", "cli"), (3, "content", "heuristics"),
    ]


def test_element_match(spark):
    per_page = {
        1: [{"text": "Sign in"}, {"ariaLabel": "Sign up now"}, {"placeholder": "Your EMAIL"}],
        2: [{"name": "login"}],
    }
    targets = spark.createDataFrame(
        [(1, 1, "the up button"), (2, 1, "Email"), (3, 2, "zzz"), (4, 9, "x"), (5, 1, "  ")],
        "target_id bigint, page_id bigint, description string",
    )
    got = joins.match_elements(targets, element_rows(spark, per_page))
    assert rows(got, "target_id", "pos") == [(1, 1), (2, 2), (3, None), (4, None), (5, None)]


def test_match_beyond_the_fiftieth_element(spark):
    listed = [{"text": "no"}] * 60 + [{"text": "Buy now"}, {"text": "buy later"}]
    targets = spark.createDataFrame([(1, 1, "buy"), (2, 1, "buy")], "target_id bigint, page_id bigint, description string")
    got = joins.match_elements(targets, element_rows(spark, {1: listed}))
    assert rows(got, "target_id", "pos") == [(1, 60), (2, 60)]


def test_unclosed_tags_take_linear_time():
    import time

    for html in ("<a href=x>text " * 100_000, "<p>a<li>b" * 50_000, "<div><p>x</li>" * 50_000):
        start = time.perf_counter()
        pages._list_elements(html)
        assert time.perf_counter() - start < 5


def test_long_texts_stay_whole(spark):
    html = f"<a>{'word ' * 50}</a><p>one<p><a>two<a>three"
    got = pages.explode_elements(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    assert [r.text for r in got.orderBy("pos").collect()] == [("word " * 50).strip(), "two", "three"]
