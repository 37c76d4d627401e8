"""Scalar functions, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import schemas


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank(value: Column | str) -> Column:
    """True where the text is missing or empty."""
    c = as_column(value)
    return c.isNull() | (c == "")


def labelled(prefix: str, value: Column, suffix: str = "") -> Column:
    """prefix + value + suffix, or NULL for blank text so that concat_ws skips it."""
    return F.when(~blank(value), F.concat(F.lit(prefix), value, F.lit(suffix)))


# --- URLs and domains ---


def extract_domain(url: Column | str) -> Column:
    """Host in lower case without user, port and one leading ``www.``; '' for none.

    ``try_parse_url`` is not used: it gives NULL for hosts with ``_`` and for
    paths with spaces.
    """
    host = F.regexp_extract(
        as_column(url), r"^(?:[^/?#]*://)?(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1
    )
    host = F.lower(F.translate(host, "[]", ""))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def base_domain(domain: Column | str) -> Column:
    """Last two labels. There is no public-suffix list: ``a.co.uk`` gives ``co.uk``."""
    return F.substring_index(as_column(domain), ".", -2)


def has_tld(service: Column | str) -> Column:
    return as_column(service).contains(".")


def flow_ref(ref: Column | str) -> Column:
    """``domain/action`` -> struct; NULL when there is no slash."""
    c = as_column(ref)
    pattern = r"(?s)^([^/]*)/(.*)$"
    return F.when(
        c.contains("/"),
        F.struct(
            F.regexp_extract(c, pattern, 1).alias("domain"),
            F.regexp_extract(c, pattern, 2).alias("action"),
        ),
    )


# --- confidence ---


def confidence_tier(confidence: Column | str, fast_label: str = "fast") -> Column:
    c = as_column(confidence)
    return F.when(c >= 6, "turbo").when(c >= 3, fast_label).otherwise("guided")


# --- time ---


def format_ts(ts: Column | str) -> Column:
    """Minute precision in the session zone; NULL and the epoch itself read 'never'."""
    c = as_column(ts)
    return F.when(c.isNull() | (F.unix_micros(c) == 0), "never").otherwise(
        F.date_format(c, "yyyy-MM-dd HH:mm")
    )


def parse_ts(text: Column | str) -> Column:
    """Three accepted layouts, tried in order; NULL when none fits the whole text."""
    c = as_column(text)
    layouts = ("yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m", "yyyy-M-d")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(layout)) for layout in layouts])


def epoch_seconds_to_ts(seconds: Column | str) -> Column:
    return F.timestamp_micros((as_column(seconds) * 1_000_000).cast("bigint"))


def fill_duration(value: Column | str, delay: int = 12) -> Column:
    """Typing time in ms."""
    return F.length(as_column(value)) * delay


# --- text ---


def slug(event: Column | str) -> Column:
    """File-name part: cut to 40 characters before other characters are dropped."""
    dashed = F.replace(F.lower(as_column(event)), F.lit(" "), F.lit("-"))
    return F.regexp_replace(F.substring(dashed, 1, 40), r"[^\p{L}\p{N}-]", "")


def preview(text: Column | str, n: int, ellipsis: str = "none") -> Column:
    """First n characters. ellipsis: 'none', 'if_cut' or 'always'."""
    c = as_column(text)
    cut = F.substring(c, 1, n)
    if ellipsis == "always":
        return F.concat(cut, F.lit("..."))
    if ellipsis == "if_cut":
        return F.when(F.length(c) > n, F.concat(cut, F.lit("..."))).otherwise(c)
    return cut


def first_line(text: Column | str, n: int) -> Column:
    return F.substring(F.substring_index(as_column(text), "\n", 1), 1, n)


def strip_prefix(entry: Column | str, prefix: Column | str) -> Column:
    """Removes every occurrence of the prefix, as the display rule does."""
    return F.replace(as_column(entry), as_column(prefix), F.lit(""))


# --- tags ---


def split_tags(csv: Column | str) -> Column:
    """CSV text -> trimmed, non-blank tags; NULL gives an empty array."""
    parts = F.split(F.coalesce(as_column(csv), F.lit("")), ",")
    trimmed = F.transform(parts, lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda t: t != "")


def render_tags(tags: Column | str, style: str = "brackets") -> Column:
    """``[a, b]`` with a leading space, or code-quoted words; '' for no tags."""
    c = as_column(tags)
    if style == "code":
        text = F.array_join(F.transform(c, lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " ")
    else:
        text = F.concat(F.lit(" ["), F.array_join(c, ", "), F.lit("]"))
    return F.when(F.size(c) > 0, text).otherwise("")


# --- credential references (pointers, never secrets) ---

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_CONTAINER = r"(?s)^((?:docker|codespace):[^/]*)/(.*)$"


def parse_creds_ref(ref: Column | str) -> Column:
    """struct(env, path); both NULL when a container reference has no path."""
    bare = F.regexp_replace(as_column(ref), _SCHEME, "")
    in_container = bare.startswith("docker:") | bare.startswith("codespace:")
    local = bare.startswith("local/")
    whole = bare.rlike(_CONTAINER)
    env = (
        F.when(in_container, F.when(whole, F.regexp_extract(bare, _CONTAINER, 1)))
        .when(local, "local")
        .when(bare.isNotNull(), "")
    )
    path = (
        F.when(in_container, F.when(whole, F.regexp_extract(bare, _CONTAINER, 2)))
        .when(local, F.substring(bare, 7, 2_147_483_647))
        .otherwise(bare)
    )
    return F.struct(env.alias("env"), path.alias("path"))


def prefix_ref(ref: Column | str, env: str, scheme: str = "gopass") -> Column:
    """Add the environment unless the reference already has one."""
    bare = F.regexp_replace(as_column(ref), f"^{scheme}://", "")
    has_env = bare.rlike(r"^(docker:|codespace:|local/)")
    return F.when(has_env, F.concat(F.lit(f"{scheme}://"), bare)).otherwise(
        F.concat(F.lit(f"{scheme}://{env}/"), bare)
    )


# --- JSON ---


def json_strings(text: Column | str) -> Column:
    """JSON array of strings; NULL for bad JSON."""
    return F.from_json(as_column(text), schemas.STRINGS)


def json_steps(text: Column | str) -> Column:
    """JSON array of step objects; NULL for bad JSON."""
    return F.from_json(as_column(text), schemas.STEPS)


def extract_json(text: Column | str) -> Column:
    """JSON value inside free text, as VARIANT; NULL when there is none.

    Tried in order: the whole text, a json fence, a bare fence, the span from
    the first opening to the last closing brace. An unclosed fence runs to the
    end of the text.
    """
    c = F.regexp_replace(as_column(text), r"^\s+|\s+$", "")
    candidates = [
        c,
        F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*(?:```|\z)", 1),
        F.regexp_extract(c, r"(?s)```\s*(.*?)\s*(?:```|\z)", 1),
        F.regexp_extract(c, r"(?s)\{.*\}", 0),
    ]
    # Text that cannot start a JSON value is not parsed: a failed parse is slow.
    return F.coalesce(
        *[
            F.when(candidate.rlike(r'^\s*[\[{"\-0-9tfn]'), F.try_parse_json(candidate))
            for candidate in candidates
        ]
    )


# --- recipe steps ---


def step_lines(steps: Column | str, layout: str = "recipe") -> Column:
    """One text line per step; blank parts are left out.

    layout: 'recipe' (4 spaces, expect_url=), 'detail' (2 spaces, expect=) or
    'show' (2 spaces, parts joined with ' | ').
    """
    indent, sep, sel, expect, before, after = {
        "recipe": ("    ", " ", "selector=", "expect_url=", "(", ")"),
        "detail": ("  ", " ", "selector=", "expect=", "(", ")"),
        "show": ("  ", " | ", "sel=", "expect=", "", ""),
    }[layout]
    return F.transform(
        as_column(steps),
        lambda s, i: F.concat(
            F.lit(indent),
            (i + 1).cast("string"),
            F.lit(". "),
            F.concat_ws(
                sep,
                F.coalesce(s["action"], F.lit("?")),
                labelled(sel, s["selector"]),
                labelled(expect, s["expected_url"]),
                labelled(before, s["detail"], after),
            ),
        ),
    )
