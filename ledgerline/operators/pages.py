"""Rule-based page classification from element tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions import scalars as X

# --- fixed values: the word lists the rules test for ---
COOKIE_TEXT = ("accept", "cookie", "consent")
COOKIE_ATTRIBUTE = ("cookie", "consent", "banner", "gdpr")
COOKIE_TAGS = ("button", "a", "div", "span")
COOKIE_CONFIRM = ("accept", "agree", "ok", "got it", "dismiss", "allow")
TEXT_INPUT_TYPES = ("text", "email", "tel", "")
TERMS_WORDS = ("terms", "agree", "accept", "privacy", "policy", "tos")
SEARCH_NAMES = ("q", "query", "search")
CAPTCHA_HOSTS = ("captcha", "recaptcha", "hcaptcha", "funcaptcha", "arkoselabs")
ERROR_TITLE = ("404", "500", "error", "not found", "page not found", "server error")

_TEXTS = ("tag", "id", "name", "type", "role", "text", "placeholder", "ariaLabel", "class", "src")


def _has_any(value: Column, words: Sequence[str]) -> Column:
    found = value.contains(words[0])
    for word in words[1:]:
        found = found | value.contains(word)
    return found


def element_flags(elements: DataFrame) -> DataFrame:
    """One boolean per rule and element; attributes are compared in lower case."""
    known = set(elements.columns)
    low = {c: F.lower(F.coalesce(c, F.lit(""))) if c in known else F.lit("") for c in _TEXTS}
    is_input = low["tag"] == "input"
    cookie = (
        (
            _has_any(low["text"], COOKIE_TEXT)
            | _has_any(low["class"], COOKIE_ATTRIBUTE)
            | _has_any(low["id"], COOKIE_ATTRIBUTE)
        )
        & low["tag"].isin(*COOKIE_TAGS)
        & _has_any(low["text"], COOKIE_CONFIRM)
    )
    terms = (
        is_input
        & (low["type"] == "checkbox")
        & (
            _has_any(low["text"], TERMS_WORDS)
            | _has_any(low["ariaLabel"], TERMS_WORDS)
            | _has_any(low["name"], TERMS_WORDS)
        )
    )
    search = (
        (low["role"] == "search")
        | low["name"].isin(*SEARCH_NAMES)
        | (is_input & (low["type"].contains("search") | low["placeholder"].contains("search")))
    )
    return elements.withColumns(
        {
            "is_cookie": cookie,
            "is_password": low["type"] == "password",
            "is_text_input": is_input & low["type"].isin(*TEXT_INPUT_TYPES),
            "is_terms": terms,
            "is_search": search,
            "is_captcha": (low["tag"] == "iframe") & _has_any(low["src"], CAPTCHA_HOSTS),
        }
    )


def page_features(elements: DataFrame) -> DataFrame:
    """One row per page: counts, flags and the picked elements.

    Only counts and min_by/max_by picks are kept, so the aggregate is partial on
    the map side and no element list is built.
    """
    flagged = element_flags(elements)

    def pos_if(flag):
        return F.when(F.col(flag), F.col("pos"))

    def text(name):
        return F.coalesce(name, F.lit("")) if name in elements.columns else F.lit("")

    picked = F.struct(text("id").alias("id"), text("name").alias("name"), text("text").alias("text"))
    return flagged.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.count_if("is_password").alias("n_password"),
        F.count_if("is_text_input").alias("n_text_inputs"),
        F.max("is_terms").alias("has_terms"),
        F.max("is_cookie").alias("has_cookie"),
        F.max("is_search").alias("has_search"),
        F.max("is_captcha").alias("has_captcha"),
        F.min_by(picked, pos_if("is_cookie")).alias("cookie_element"),
        F.max_by(picked, pos_if("is_search")).alias("search_element"),
        F.max_by(F.lower(text("src")), pos_if("is_captcha")).alias("captcha_src"),
    )


def classify_pages(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Page type, confidence and suggested action per page; pages without elements included."""
    seen = pages.select("page_id", "title").join(page_features(elements), "page_id", "left")
    no, zero = F.lit(False), F.lit(0)
    title = F.coalesce("title", F.lit(""))
    passwords = F.coalesce("n_password", zero)
    inputs = F.coalesce("n_text_inputs", zero)
    flags = {
        "login_form": (passwords > 0) & (inputs <= 2),
        "signup_form": (passwords > 0)
        & (inputs >= 2)
        & (F.coalesce("has_terms", no) | (inputs >= 3)),
        "cookie_banner": F.coalesce("has_cookie", no),
        "captcha": F.coalesce("has_captcha", no),
        "search_input": F.coalesce("has_search", no),
        "error_page": _has_any(F.lower(title), ERROR_TITLE),
    }
    detected = F.struct(*[c.alias(n) for n, c in flags.items()])
    page_type = (
        F.when(flags["captcha"], "captcha")
        .when(flags["cookie_banner"], "cookie_banner")
        .when(flags["error_page"], "error")
        .when(flags["signup_form"], "signup")
        .when(flags["login_form"], "login")
        .when(flags["search_input"], "search")
        .when(F.col("n_elements") > 0, "content")
        .otherwise("unknown")
    )
    src = F.col("captcha_src")
    captcha_type = F.when(
        F.col("page_type") == "captcha",
        F.when(src.contains("recaptcha"), "recaptcha")
        .when(src.contains("arkoselabs") | src.contains("funcaptcha"), "arkose")
        .when(src.contains("hcaptcha"), "hcaptcha")
        .otherwise("unknown"),
    )

    def by_type(values, otherwise=None):
        chain = F
        for name, value in values.items():
            value = value if isinstance(value, Column) else F.lit(value)
            chain = chain.when(F.col("page_type") == name, value)
        return chain.otherwise(F.lit(otherwise))

    cookie, search = F.col("cookie_element"), F.col("search_element")
    by_id = lambda el: F.concat(F.lit("#"), el["id"])
    return (
        seen.withColumns({"detected": detected, "page_type": page_type})
        .withColumn("captcha_type", captcha_type)
        .select(
            "page_id",
            "page_type",
            by_type(
                {
                    "captcha": 0.9,
                    "cookie_banner": 0.8,
                    "error": 0.85,
                    "signup": 0.7,
                    "login": 0.8,
                    "search": 0.7,
                    "content": 0.4,
                },
                0.1,
            ).alias("confidence"),
            by_type(
                {
                    "captcha": "abort",
                    "cookie_banner": "dismiss",
                    "error": "abort",
                    "signup": "fill",
                    "login": "fill",
                    "search": "fill",
                },
                "none",
            ).alias("action_type"),
            by_type(
                {
                    "captcha": F.concat(F.lit("captcha: "), F.col("captcha_type")),
                    "cookie_banner": cookie["text"],
                    "error": title,
                    "signup": "signup form",
                    "login": "login form",
                    "search": "search input",
                }
            ).alias("target"),
            by_type(
                {
                    "cookie_banner": F.when(cookie["id"] != "", by_id(cookie)).otherwise(""),
                    "search": F.when(search["id"] != "", by_id(search))
                    .when(
                        search["name"] != "",
                        F.concat(F.lit('input[name="'), search["name"], F.lit('"]')),
                    )
                    .otherwise(""),
                }
            ).alias("selector_hint"),
            "captcha_type",
            "detected",
        )
    )


# What the element listing selects.
LISTED_TAGS = ("a", "button", "input", "select", "textarea")
LISTED_ROLES = ("button", "link")
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
# Tags that end an open one of their own kind where the page leaves the end out.
ENDS_ITSELF = ("a", "button", "option", "p")
PAGES_AT_ONCE = 200


class _Lister(HTMLParser):
    """Listed elements of one page in document order.

    Text is kept once, and an element knows the stretch it spans, so the parse
    takes time in proportion to the page and what it lists.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.listed: list[dict] = []
        self.open_tags: list[tuple[str, dict | None]] = []
        self.n_open: dict[str, int] = {}
        self.texts: list[str] = []

    def handle_starttag(self, tag, attrs):
        top = self.open_tags[-1][0] if self.open_tags else None
        if tag in ENDS_ITSELF or tag == top == "li":
            self.handle_endtag(tag)
        a = {k: v or "" for k, v in reversed(attrs)}
        row = None
        if tag in LISTED_TAGS or a.get("role", "").lower() in LISTED_ROLES:
            default_type = {"input": "text", "button": "submit"}.get(tag, "")
            row = {
                "tag": tag,
                "id": a.get("id", ""),
                "name": a.get("name", ""),
                "type": a.get("type", default_type).lower(),
                "role": a.get("role", ""),
                "value": a.get("value", ""),
                "placeholder": a.get("placeholder", ""),
                "ariaLabel": a.get("aria-label", ""),
                "class": a.get("class", ""),
                "src": a.get("src", ""),
                "text": (len(self.texts), len(self.texts) if tag in VOID_TAGS else None),
            }
            self.listed.append(row)
        if tag not in VOID_TAGS:
            self.open_tags.append((tag, row))
            self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        while self.n_open.get(tag):
            closed, row = self.open_tags.pop()
            self.n_open[closed] -= 1
            if row is not None:
                row["text"] = (row["text"][0], len(self.texts))
            if closed == tag:
                break

    def handle_data(self, data):
        self.texts.append(data)


def _list_elements(html: str | None) -> list[dict]:
    lister = _Lister()
    lister.feed(html or "")
    lister.close()
    for row in lister.listed:
        begin, end = row["text"]
        row["text"] = "".join(lister.texts[begin:end]).strip()
    return lister.listed


def explode_elements(pages: DataFrame) -> DataFrame:
    """Element rows of stored HTML: all of a page, with their whole text.

    Stored HTML has no layout, so ``visible`` is NULL. HTML cannot be parsed
    with column expressions; this is the one operator that runs Python on the
    workers, a few hundred pages at a time.
    """
    schema = schemas.TABLES["elements"]
    names = [field.split()[0] for field in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), PAGES_AT_ONCE):
                some = batch.iloc[begin : begin + PAGES_AT_ONCE]
                rows = [
                    {"page_id": page_id, "pos": pos, "visible": None, **element}
                    for page_id, html in zip(some["page_id"], some["html"])
                    for pos, element in enumerate(_list_elements(html))
                ]
                yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "html").mapInPandas(parse, schema)


def coalesce_tiers(pages: DataFrame, api: DataFrame, cli: DataFrame, heuristics: DataFrame) -> DataFrame:
    """First tier with a non-empty page_type per page, with the tier that answered.

    Each tier table has one row (page_id, page_type, confidence, action_type)
    per page at most; the heuristics answer is taken whatever it says.
    """
    answer = ["page_type", "confidence", "action_type"]
    out = pages.select("page_id")
    for name, tier in (("api", api), ("cli", cli), ("heuristics", heuristics)):
        rows = tier if name == "heuristics" else tier.where(~X.blank("page_type"))
        out = out.join(
            rows.select("page_id", F.struct(*answer).alias(f"__{name}")), "page_id", "left"
        )
    return out.select(
        "page_id",
        F.coalesce("__api", "__cli", "__heuristics").alias("__answer"),
        F.when(F.col("__api").isNotNull(), "api")
        .when(F.col("__cli").isNotNull(), "cli")
        .when(F.col("__heuristics").isNotNull(), "heuristics")
        .alias("tier_used"),
    ).select("page_id", "__answer.*", "tier_used")
