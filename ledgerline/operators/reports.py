"""Text reports, one per key, as ordered line rows.

A report is a table of lines (key, section, at, by, seq, sub, line); sorted by
those columns it is the document. Lines are never gathered into one value per
key unless a limit bounds their number (``assemble``), so a key with a very
long history is written by many tasks. ``sources.reports`` writes line tables
as one folder of ordered text parts per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import changes, filters, joins, log

ORDER = ["section", "at", "by", "seq", "sub"]
POST_TAGS = ("comment", "post", "reply")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def emit(
    df: DataFrame,
    keys: Sequence[str],
    sections: dict[int, Sequence[Column | str]],
    at: str | Column | None = None,
    by: str | Column | None = None,
    seq: str | Column | None = None,
) -> DataFrame:
    """Each input row gives the listed lines of each section; NULL lines are left out."""

    def column(value, kind):
        value = F.lit(None) if value is None else X.as_column(value)
        return value.cast(kind)

    listed = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(sub).alias("sub"),
            (F.lit(line) if isinstance(line, str) else line).alias("line"),
        )
        for section, lines in sections.items()
        for sub, line in enumerate(lines)
    ]
    return (
        df.select(
            *keys,
            column(at, "timestamp").alias("at"),
            column(by, "string").alias("by"),
            column(seq, "bigint").alias("seq"),
            F.inline(F.array(*listed)),
        )
        .where(F.col("line").isNotNull())
        .select(*keys, *ORDER, "line")
    )


def _if(condition: Column, *lines: Column | str) -> list[Column]:
    """Lines that appear only under a condition."""
    return [F.when(condition, F.lit(x) if isinstance(x, str) else x) for x in lines]


def _with_counts(people: DataFrame, rows: DataFrame, **counts: Column) -> DataFrame:
    """Add per-persona aggregates of a child table; rows without any give NULL."""
    per = rows.groupBy("persona").agg(*[c.alias(name) for name, c in counts.items()])
    return people.join(per, "persona", "left")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def document(lines: DataFrame, keys: Sequence[str] = ("persona",)) -> DataFrame:
    """Lines in reading order."""
    return lines.orderBy(*keys, *ORDER)


def assemble(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One text per key. Only for reports whose number of lines is limited."""
    gathered = F.array_sort(F.collect_list(F.struct(*ORDER, "line")))
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(gathered, lambda x: x["line"]), "\n").alias("text")
    )


def _named(personas: DataFrame) -> DataFrame:
    return personas.withColumnRenamed("name", "persona")


def not_found(requests: DataFrame, personas: DataFrame) -> DataFrame:
    """Message line for each requested persona that does not exist."""
    known = personas.select(F.col("name").alias("persona")).distinct()
    gone = requests.join(known, "persona", "left_anti")
    return emit(gone, ["persona"], {0: [_text("Persona '", F.col("persona"), "' not found.")]})


# --- timeline, brief, state ---


def timeline(personas: DataFrame, milestones: DataFrame, tag: str | None = None) -> DataFrame:
    people = _named(personas)
    rows = milestones if tag is None else filters.with_tag(milestones, tag)
    rows = rows.join(people.select("persona"), "persona", "left_semi")
    described = F.when(X.blank("description"), "").otherwise(_text(" — ", F.col("description")))
    people = _with_counts(people, rows, n=F.count(F.lit(1)))
    some = F.col("n").isNotNull()
    heads = emit(
        people,
        ["persona"],
        {
            0: [
                F.when(some, _text("# ", F.col("persona"), described, " — Timeline")).otherwise(
                    _text("No milestones recorded for '", F.col("persona"), "'.")
                ),
                *_if(some, ""),
            ]
        },
    )
    # One heading per date, placed before the first moment of that date.
    dates = rows.groupBy("persona", F.to_date("ts").alias("date")).agg(F.lit(-1).alias("seq"))
    headings = emit(
        dates,
        ["persona"],
        {1: [_text("## ", F.date_format("date", "yyyy-MM-dd")), ""]},
        at="date",
        seq="seq",
    )
    entries = emit(
        rows,
        ["persona"],
        {
            1: [
                _text("### ", F.date_format("ts", "HH:mm"), " — ", F.col("event")),
                F.when(F.size("tags") > 0, _text("Tags: ", X.render_tags("tags", "code"))),
                X.labelled("URL: ", F.col("url")),
                X.labelled("\n", F.col("detail")),
                F.when(
                    ~X.blank("screenshot_path"),
                    _text("\n![", F.col("event"), "](", F.col("screenshot_path"), ")"),
                ),
                "",
            ]
        },
        at="ts",
        seq="id",
    )
    return _union([heads, headings, entries])


def _status_mark(prefix: str, suffix: str) -> Column:
    return F.when(F.col("status") == "active", "").otherwise(
        _text(prefix, F.col("status"), suffix)
    )


def brief(personas: DataFrame, accounts: DataFrame, milestones: DataFrame) -> DataFrame:
    people = _named(personas)
    key = ["persona"]
    known = people.select("persona")
    accounts = accounts.join(known, "persona", "left_semi")
    milestones = milestones.join(known, "persona", "left_semi")
    notes = F.when(X.blank("notes"), "").otherwise(_text(" — ", F.col("notes")))
    is_post = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in POST_TAGS]))
    people = _with_counts(
        people,
        accounts,
        n_accounts=F.count(F.lit(1)),
        mail=F.min(F.when(joins.is_mail(), F.struct("created_at", "id", "email"))),
    )
    people = _with_counts(
        people, milestones, n_milestones=F.count(F.lit(1)), n_posts=F.count_if(is_post)
    )
    has_accounts = F.col("n_accounts").isNotNull()
    has_milestones = F.col("n_milestones").isNotNull()
    has_posts = F.col("n_posts") > 0
    has_profile = ~X.blank("profile")
    knows = ~X.blank("context_summary")
    mail = F.col("mail.email")
    fixed = emit(
        people,
        key,
        {
            0: [_text("# ", F.col("persona"), " — Persona Brief"), ""],
            1: _if(has_profile, "## Voice & Writing Style", "", F.col("profile"), ""),
            2: [
                X.labelled("**Who I am:** ", F.col("description")),
                X.labelled("**Purpose:** ", F.col("purpose")),
                _text("**Location:** ", F.col("locale"), " / ", F.col("timezone")),
                "",
            ],
            3: _if(has_accounts, "## My Accounts", ""),
            5: _if(has_accounts, ""),
            6: _if(
                mail.isNotNull(),
                _text(
                    "**⚡ My primary email: `",
                    mail,
                    "`** — use this when signing up for new services.",
                ),
                "",
            ),
            7: _if(has_milestones, "## What I've Done", ""),
            9: _if(has_milestones, ""),
            10: _if(
                has_posts,
                "## My Writing Style",
                "",
                "Here are things I've written before — match this tone and style:",
                "",
            ),
            12: _if(knows, "## What I Know", "", F.col("context_summary"), ""),
            13: [
                "## Rules",
                "",
                "- Always use my primary email when signing up for new services",
                "- Match my writing style from previous posts",
                "- Record milestones for significant actions",
                "- Check my account list before creating duplicate accounts",
            ],
        },
    )
    account_line = _text(
        "- **", F.col("service"), "**: ", F.col("email"), _status_mark(" ⚠️ ", ""), notes
    )
    done = _text(
        "- **", F.date_format("ts", "yyyy-MM-dd"), "** — ", F.col("event"), X.render_tags("tags")
    )
    detail = F.when(~X.blank("detail"), _text("  ", X.first_line("detail", 200)))
    # Blank details are skipped after the last three posts are taken.
    posts = log.newest(milestones.where(is_post), key, ["ts", "id"], 3).where(~X.blank("detail"))
    quoted = [_text("**", F.col("event"), ":**"), _text("> ", X.preview("detail", 500)), ""]
    return _union(
        [
            fixed,
            emit(accounts, key, {4: [account_line]}, at="created_at", seq="id"),
            emit(milestones, key, {8: [done, detail]}, at="ts", seq="id"),
            emit(posts, key, {11: quoted}, at="ts", seq="id"),
        ]
    )


def state(
    personas: DataFrame, accounts: DataFrame, milestones: DataFrame, actions: DataFrame
) -> DataFrame:
    """Fields, accounts, the last 5 milestones and the last 10 actions. Pointers are masked."""
    people = _named(personas)
    key = ["persona"]
    known = people.select("persona")
    accounts = filters.redact(accounts.join(known, "persona", "left_semi"))
    milestones = milestones.join(known, "persona", "left_semi")
    actions = actions.join(known, "persona", "left_semi")
    fields = [
        _text("persona: ", F.col("persona")),
        X.labelled("description: ", F.col("description")),
        X.labelled("purpose: ", F.col("purpose")),
        _text("locale: ", F.col("locale")),
        _text("timezone: ", F.col("timezone")),
        F.when(~X.blank("profile"), _text("profile: ", X.preview("profile", 80, "always"))),
        _text("created: ", X.format_ts("created_at")),
        F.when(F.col("last_used_at").isNotNull(), _text("last_used: ", X.format_ts("last_used_at"))),
    ]
    creds = F.when(X.blank("creds_ref"), "").otherwise(_text(" creds=", F.col("creds_ref")))
    for name, rows in (("accounts", accounts), ("milestones", milestones), ("actions", actions)):
        people = _with_counts(people, rows, **{f"n_{name}": F.count(F.lit(1))})
    n_milestones = F.col("n_milestones")
    fixed = emit(
        people,
        key,
        {
            0: fields,
            1: _if(F.col("n_accounts").isNotNull(), "", "accounts:"),
            3: _if(
                n_milestones.isNotNull(),
                "",
                _text("milestones: ", n_milestones.cast("string"), " recorded"),
            ),
            5: _if(F.col("n_actions").isNotNull(), "", "recent_actions:"),
        },
    )
    account_line = _text(
        "  - ", F.col("service"), ": ", F.col("email"), creds, _status_mark(" (", ")")
    )
    milestone_line = _text(
        "  - ", X.format_ts("ts"), " — ", F.col("event"), X.render_tags("tags")
    )
    action_line = _text(
        "  - ", X.format_ts("ts"), " — ", F.col("action"), ": ", _or_empty("detail")
    )
    last5 = log.newest(milestones, key, ["ts", "id"], 5)
    last10 = log.newest(actions, key, ["ts", "id"], 10)
    return _union(
        [
            fixed,
            emit(accounts, key, {2: [account_line]}, at="created_at", seq="id"),
            emit(last5, key, {4: [milestone_line]}, at="ts", seq="id"),
            emit(last10, key, {6: [action_line]}, at="ts", seq="id"),
        ]
    )


def persona_list(personas: DataFrame, accounts: DataFrame) -> DataFrame:
    """One line per persona, in order of creation."""
    described = F.when(X.blank("description"), "").otherwise(_text(" — ", F.col("description")))
    return (
        joins.persona_summary(personas, accounts)
        .select(
            "name",
            "created_at",
            _text(
                "- ",
                F.col("name"),
                described,
                " (",
                F.col("account_count").cast("string"),
                " accounts, last used: ",
                X.format_ts("last_used_at"),
                ")",
            ).alias("line"),
        )
        .orderBy("created_at", "name")
    )


def audit_log(actions: DataFrame, n: int = 20) -> DataFrame:
    """The newest n actions per persona, oldest first."""
    return emit(
        log.newest(actions, ["persona"], ["ts", "id"], n),
        ["persona"],
        {0: [_text(X.format_ts("ts"), " — ", F.col("action"), ": ", _or_empty("detail"))]},
        at="ts",
        seq="id",
    )


# --- recipes ---


def _mode() -> Column:
    return X.confidence_tier("confidence")


def _confidence() -> Column:
    return F.col("confidence").cast("string")


def flow_list(flows: DataFrame, compact: bool = False) -> DataFrame:
    """All recipes under a heading per domain, in one of the two listing styles."""
    domains = flows.select("domain").distinct()
    if compact:
        head, line = (
            _text(F.col("domain"), ":"),
            _text(
                "  ",
                F.col("action"),
                " — ",
                _or_empty("description"),
                " (confidence: ",
                _confidence(),
                ", ",
                _mode(),
                ")",
            ),
        )
    else:
        head, line = (
            _text("## ", F.col("domain")),
            _text(
                "  - ",
                F.col("action"),
                " (confidence: ",
                _confidence(),
                ", mode: ",
                _mode(),
                ") — ",
                _or_empty("description"),
            ),
        )
    return _union(
        [
            emit(domains, ["domain"], {0: [head], 2: [""]}),
            emit(flows, ["domain"], {1: [line]}, by="action"),
        ]
    )


def _when_or_never(name: str) -> Column:
    return F.coalesce(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("never"))


def flow_domains(flows: DataFrame) -> DataFrame:
    """Recipes of each domain with counts of steps, caveats and references."""
    domains = flows.select("domain").distinct()
    lines = [
        _text("### ", F.col("action"), " (confidence: ", _confidence(), ", mode: ", _mode(), ")"),
        _text("  ", _or_empty("description")),
        F.when(F.size("steps") > 0, _text("  Steps: ", F.size("steps").cast("string"))),
        F.when(F.size("caveats") > 0, _text("  Caveats: ", F.array_join("caveats", ", "))),
        F.when(F.size("refs") > 0, _text("  Refs: ", F.array_join("refs", ", "))),
        _text("  Last verified: ", _when_or_never("last_verified")),
        "",
    ]
    return _union(
        [
            emit(domains, ["domain"], {0: [_text("## ", F.col("domain"), " flows"), ""]}),
            emit(flows, ["domain"], {1: lines}, by="action"),
        ]
    )


def _joined(items: str, prefix: str) -> Column:
    """One text of prefixed array items; NULL for an empty array."""
    return F.when(
        F.size(items) > 0,
        F.array_join(F.transform(items, lambda c: F.concat(F.lit(prefix), c)), "\n"),
    )


def _steps(layout: str) -> Column:
    return F.when(F.size("steps") > 0, F.array_join(X.step_lines("steps", layout), "\n"))


def flow_details(flows: DataFrame, compact: bool = False) -> DataFrame:
    """Full text of each recipe in one of the two detail styles."""
    keys = ["domain", "action"]
    has_steps = F.size("steps") > 0
    has_caveats = F.size("caveats") > 0
    refs = F.when(F.size("refs") > 0, _text("Refs: ", F.array_join("refs", ", ")))
    caveats = [F.when(has_caveats, F.lit("Caveats:")), _joined("caveats", "  - ")]
    dates = [
        _text("Description: ", _or_empty("description")),
        _text("Created: ", _when_or_never("created")),
        _text("Last verified: ", _when_or_never("last_verified")),
        _text("Last failed: ", _when_or_never("last_failed")),
    ]
    name = _text(F.col("domain"), "/", F.col("action"))
    if compact:
        count = F.size("steps").cast("string")
        lines = [
            _text(name, " (confidence: ", _confidence(), ", ", _mode(), ")"),
            *dates,
            F.when(has_steps, _text("Steps (", count, "):")),
            _steps("show"),
            *caveats,
            refs,
        ]
    else:
        lines = [
            _text("# ", name),
            _text("Mode: ", _mode(), " (confidence: ", _confidence(), ")"),
            *dates,
            *caveats,
            refs,
            F.when(has_steps, F.lit("")),
            F.when(has_steps, F.lit("Steps:")),
            _steps("detail"),
        ]
    return emit(flows, keys, {0: lines})


def recipe_context(matches: DataFrame, flows: DataFrame) -> DataFrame:
    """Recipe text for each used (match_tier, match_key) of ``joins.match_flows``."""
    keys = ["match_tier", "match_key"]
    listed = joins.recipe_lists(matches, flows)
    heads = listed.select(*keys).distinct()
    lines = [
        _text(
            "### ",
            F.col("domain"),
            "/",
            F.col("action"),
            " (confidence: ",
            _confidence(),
            ", mode: ",
            _mode(),
            ")",
        ),
        X.labelled("  ", F.col("description")),
        F.when(F.size("caveats") > 0, F.lit("  Caveats:")),
        _joined("caveats", "    - "),
        F.when(F.size("refs") > 0, _text("  References: ", F.array_join("refs", ", "))),
        F.when(F.size("steps") > 0, F.lit("  Steps:")),
        _steps("recipe"),
        "",
    ]
    title = ["## Stored Flow Recipes for this domain", ""]
    return _union(
        [
            emit(heads, keys, {0: title}),
            emit(listed, keys, {1: lines}, by=_text(F.col("domain"), "\t", F.col("action"))),
        ]
    )


# --- lists ---


def account_list(accounts: DataFrame) -> DataFrame:
    shown = filters.redact(accounts)
    creds = F.when(X.blank("creds_ref"), "none").otherwise(F.col("creds_ref"))
    line = _text(
        "[",
        F.col("id").cast("string"),
        "] ",
        F.col("service"),
        ": ",
        F.col("email"),
        " (status: ",
        F.col("status"),
        ", creds: ",
        creds,
        ")",
    )
    return emit(shown, ["persona"], {0: [line]}, at="created_at", seq="id")


def milestone_list(milestones: DataFrame) -> DataFrame:
    shot = F.when(X.blank("screenshot_path"), "").otherwise(" 📸")
    lines = [
        _text(
            "[",
            F.col("id").cast("string"),
            "] ",
            X.format_ts("ts"),
            " — ",
            F.col("event"),
            X.render_tags("tags"),
            shot,
        ),
        F.when(~X.blank("detail"), _text("    ", X.preview("detail", 100, "if_cut"))),
    ]
    return emit(milestones, ["persona"], {0: lines}, at="ts", seq="id")


def _entry(text: Column, mark: Column | str = "", with_source: bool = True) -> Column:
    tags = F.when(X.blank("tags"), "").otherwise(_text(" [", F.col("tags"), "]"))
    source = F.when(X.blank("source"), "").otherwise(_text(" (", F.col("source"), ")"))
    parts = ["[", F.col("id").cast("string"), "]", mark, " ", text, tags]
    return _text(*parts, *([source] if with_source else []))


def context_list(context: DataFrame) -> DataFrame:
    """Live knowledge entries; a tick marks digested ones."""
    mark = F.when(F.col("digested_at").isNotNull(), " ✓").otherwise(" •")
    line = _entry(X.preview("summary", 120), mark)
    return emit(filters.live(context), ["persona"], {0: [line]}, at="created_at", seq="id")


def digest_worksheet(personas: DataFrame, context: DataFrame) -> DataFrame:
    """Current summary and the entries that the next digest must take in."""
    people = _named(personas)
    key = ["persona"]
    pending = changes.digest_classes(context).join(
        people.select("persona"), "persona", "left_semi"
    )
    blocks = ("new", "updated", "deleted")
    counts = {f"n_{b}": F.count_if(F.col("digest_class") == b) for b in blocks}
    people = _with_counts(people, pending, **counts)
    summarised = ~X.blank("context_summary")
    shown = summarised | F.col("n_new").isNotNull()
    nothing = _text("No context to digest for '", F.col("persona"), "'. Add entries first.")
    sections = {
        0: [
            F.when(summarised, F.lit("## Current Summary")).when(~shown, nothing),
            *_if(summarised, F.col("context_summary"), ""),
        ],
        10: _if(shown, "---"),
    }
    for i, block in enumerate(blocks):
        n = F.col(f"n_{block}")
        head = _text(f"## {block.title()} Entries (", n.cast("string"), ")")
        sections[3 * i + 1] = _if(n > 0, head)
        sections[3 * i + 3] = _if(n > 0, "")
    entry = _text("- ", _entry(F.col("summary"), with_source=False))
    bare = _text("- [", F.col("id").cast("string"), "] ", F.col("summary"))
    source = F.when(X.blank("source"), "").otherwise(_text("\n  Source: ", F.col("source")))

    def only(block: str, line: Column) -> list[Column]:
        return _if(F.col("digest_class") == block, line)

    rows = {
        2: only("new", _text(entry, source)),
        5: only("updated", entry),
        8: only("deleted", bare),
    }
    return _union(
        [emit(people, key, sections), emit(pending, key, rows, at="created_at", seq="id")]
    )


# --- runs ---


def step_log(steps: DataFrame) -> DataFrame:
    line = _text(
        "  Step ",
        F.col("step").cast("string"),
        ": [",
        F.col("page_type"),
        "] ",
        _or_empty("description"),
        " -> ",
        F.col("action_taken"),
        " (tier: ",
        F.col("tier"),
        ", conf: ",
        F.format_string("%.1f", F.coalesce("confidence", F.lit(0.0))),
        ")",
    )
    return emit(steps, ["run_id"], {0: [line]}, seq="step")


def run_footer(runs: DataFrame) -> DataFrame:
    """Closing line of each run.

    ``runs``: (run_id, domain, flow_domain, flow_action, confidence,
    steps_completed, total_steps); flow columns are NULL without a recipe.
    """
    used = F.col("flow_action").isNotNull()
    flow = _text(
        "📋 Flow: ",
        F.col("flow_domain"),
        "/",
        F.col("flow_action"),
        " (confidence ",
        _confidence(),
        ", ",
        X.confidence_tier("confidence", "fast path"),
        ", ",
        F.col("steps_completed").cast("string"),
        "/",
        F.col("total_steps").cast("string"),
        " steps OK)",
    )
    none = _text("📋 No stored flow for ", _or_empty("domain"), ".")
    return emit(runs, ["run_id"], {1: [F.when(used, flow).otherwise(none)]})
