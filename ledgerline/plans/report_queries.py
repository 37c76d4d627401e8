"""Queries over the text reports, as line tables."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from ledgerline.operators import joins, reports, runs
from ledgerline.plans import derived as D
from ledgerline.plans import inputs as I
from ledgerline.plans.registry import CHECKS, query
from ledgerline.plans.run_queries import _LABELS
from ledgerline.sources import reports as sink
from ledgerline.streaming.folders import work_folder

AT0 = "TIMESTAMP '1970-01-01 00:00:00'"
STAMP = "'%Y-%m-%d %H:%M'"


def _shown(lines, *keys):
    """Line rows without NULLs in the position columns."""
    return lines.select(
        *keys,
        "section",
        F.coalesce("at", F.lit(datetime(1970, 1, 1))).alias("line_at"),
        F.coalesce("by", F.lit("")).alias("line_by"),
        F.coalesce("seq", F.lit(-2)).alias("seq"),
        "sub",
        "line",
    )


def _lines(source: str, section: int, lines: list[str], keys: str = "persona", at: str = AT0,
           by: str = "''", seq: str = "-2") -> str:
    """SQL twin of ``reports.emit``: one SELECT per listed line."""
    return " UNION ALL ".join(
        f"SELECT {keys}, CAST({section} AS INTEGER) AS section, {at} AS line_at, {by} AS line_by,"
        f" CAST({seq} AS BIGINT) AS seq, CAST({i} AS INTEGER) AS sub, {text} AS line"
        f" FROM {source} AS src_{i} WHERE ({text}) IS NOT NULL"
        for i, text in enumerate(lines)
    )


def _doc(ctes: str, *parts: str) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


_TAGS = "CASE WHEN len(tags) > 0 THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END"
_PEOPLE = f"{D.PERSONAS}, people AS (SELECT * RENAME (name AS persona) FROM personas)"
_WITH = "(SELECT * FROM people WHERE persona IN (SELECT persona FROM {0}))"
_WITHOUT = "(SELECT * FROM people WHERE persona NOT IN (SELECT persona FROM {0}))"


@query(
    "timeline_lines",
    _doc(
        f"{_PEOPLE}, {D.MILESTONES}, dates AS (SELECT DISTINCT persona, date_trunc('day', ts) AS day FROM milestones)",
        _lines(
            _WITH.format("milestones"),
            0,
            ["'# ' || persona || CASE WHEN description <> '' THEN ' — ' || description ELSE '' END || ' — Timeline'", "''"],
        ),
        _lines(_WITHOUT.format("milestones"), 0, ["'No milestones recorded for ''' || persona || '''.'"]),
        _lines("dates", 1, ["'## ' || strftime(day, '%Y-%m-%d')", "''"], at="CAST(day AS TIMESTAMP)", seq="-1"),
        _lines(
            "milestones",
            1,
            [
                "'### ' || strftime(ts, '%H:%M') || ' — ' || event",
                "CASE WHEN len(tags) > 0 THEN 'Tags: `' || array_to_string(tags, '` `') || '`' END",
                "CASE WHEN url <> '' THEN 'URL: ' || url END",
                "CASE WHEN detail <> '' THEN chr(10) || detail END",
                "CASE WHEN screenshot_path <> '' THEN chr(10) || '![' || event || '](' || screenshot_path || ')' END",
                "''",
            ],
            at="ts",
            seq="id",
        ),
    ),
)
def timeline_lines(spark, d):
    return _shown(reports.timeline(I.personas(spark, d), I.milestones(spark, d)), "persona")


_BRIEF = f"""{_PEOPLE}, {D.ACCOUNTS}, {D.MILESTONES},
posts AS (
  SELECT * FROM milestones WHERE len(list_intersect(tags, ['comment', 'post', 'reply'])) > 0
  QUALIFY row_number() OVER (PARTITION BY persona ORDER BY ts DESC, id DESC) <= 3),
mail AS (
  SELECT persona, email FROM accounts WHERE status = 'active' AND lower(service) IN
    ('outlook', 'outlook.com', 'gmail', 'tutanota', 'protonmail', 'hotmail')
  QUALIFY row_number() OVER (PARTITION BY persona ORDER BY created_at, id) = 1)"""


@query(
    "brief_lines",
    _doc(
        _BRIEF,
        _lines("people", 0, ["'# ' || persona || ' — Persona Brief'", "''"]),
        _lines(
            "(SELECT * FROM people WHERE profile <> '')",
            1,
            ["'## Voice & Writing Style'", "''", "profile", "''"],
        ),
        _lines(
            "people",
            2,
            [
                "CASE WHEN description <> '' THEN '**Who I am:** ' || description END",
                "CASE WHEN purpose <> '' THEN '**Purpose:** ' || purpose END",
                "'**Location:** en-US / UTC'",
                "''",
            ],
        ),
        _lines(_WITH.format("accounts"), 3, ["'## My Accounts'", "''"]),
        _lines(
            "accounts",
            4,
            [
                "'- **' || service || '**: ' || email || CASE WHEN status <> 'active' THEN ' ⚠️ ' || status ELSE '' END"
                " || CASE WHEN notes <> '' THEN ' — ' || notes ELSE '' END"
            ],
            at="created_at",
            seq="id",
        ),
        _lines(_WITH.format("accounts"), 5, ["''"]),
        _lines(
            "mail",
            6,
            ["'**⚡ My primary email: `' || email || '`** — use this when signing up for new services.'", "''"],
        ),
        _lines(_WITH.format("milestones"), 7, ["'## What I''ve Done'", "''"]),
        _lines(
            "milestones",
            8,
            [
                f"'- **' || strftime(ts, '%Y-%m-%d') || '** — ' || event || {_TAGS}",
                "CASE WHEN detail <> '' THEN '  ' || detail END",
            ],
            at="ts",
            seq="id",
        ),
        _lines(_WITH.format("milestones"), 9, ["''"]),
        _lines(
            _WITH.format("posts"),
            10,
            [
                "'## My Writing Style'",
                "''",
                "'Here are things I''ve written before — match this tone and style:'",
                "''",
            ],
        ),
        _lines(
            "(SELECT * FROM posts WHERE detail <> '')",
            11,
            ["'**' || event || ':**'", "'> ' || detail", "''"],
            at="ts",
            seq="id",
        ),
        _lines(
            "(SELECT * FROM people WHERE context_summary <> '')",
            12,
            ["'## What I Know'", "''", "context_summary", "''"],
        ),
        _lines(
            "people",
            13,
            [
                "'## Rules'",
                "''",
                "'- Always use my primary email when signing up for new services'",
                "'- Match my writing style from previous posts'",
                "'- Record milestones for significant actions'",
                "'- Check my account list before creating duplicate accounts'",
            ],
        ),
    ),
)
def brief_lines(spark, d):
    lines = reports.brief(I.personas(spark, d), I.accounts(spark, d), I.milestones(spark, d))
    return _shown(lines, "persona")


@query(
    "state_lines",
    _doc(
        f"""{_PEOPLE}, {D.ACCOUNTS}, {D.MILESTONES}, {D.ACTIONS},
        per AS (SELECT persona, count(*) AS n FROM milestones GROUP BY persona),
        m5 AS (SELECT * FROM milestones QUALIFY row_number() OVER (PARTITION BY persona ORDER BY ts DESC, id DESC) <= 5),
        a10 AS (SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY persona ORDER BY ts DESC, id DESC) <= 10)""",
        _lines(
            "people",
            0,
            [
                "'persona: ' || persona",
                "CASE WHEN description <> '' THEN 'description: ' || description END",
                "CASE WHEN purpose <> '' THEN 'purpose: ' || purpose END",
                "'locale: en-US'",
                "'timezone: UTC'",
                "CASE WHEN profile <> '' THEN 'profile: ' || left(profile, 80) || '...' END",
                f"'created: ' || strftime(created_at, {STAMP})",
                f"'last_used: ' || strftime(last_used_at, {STAMP})",
            ],
        ),
        _lines(_WITH.format("accounts"), 1, ["''", "'accounts:'"]),
        _lines(
            "accounts",
            2,
            [
                "'  - ' || service || ': ' || email || CASE WHEN creds_ref = '' THEN '' ELSE ' creds=***' END"
                " || CASE WHEN status <> 'active' THEN ' (' || status || ')' ELSE '' END"
            ],
            at="created_at",
            seq="id",
        ),
        _lines("per", 3, ["''", "'milestones: ' || n || ' recorded'"]),
        _lines(
            "m5", 4, [f"'  - ' || strftime(ts, {STAMP}) || ' — ' || event || {_TAGS}"], at="ts", seq="id"
        ),
        _lines(_WITH.format("actions"), 5, ["''", "'recent_actions:'"]),
        _lines(
            "a10",
            6,
            [f"'  - ' || strftime(ts, {STAMP}) || ' — ' || action || ': ' || detail"],
            at="ts",
            seq="id",
        ),
    ),
)
def _(spark, d):
    lines = reports.state(
        I.personas(spark, d), I.accounts(spark, d), I.milestones(spark, d), I.actions(spark, d)
    )
    return _shown(lines, "persona")


@query(
    "persona_list",
    f"""WITH {D.PERSONAS}, {D.ACCOUNTS}, n AS (SELECT persona, count(*) AS c FROM accounts GROUP BY persona)
    SELECT name, created_at, '- ' || name || CASE WHEN description <> '' THEN ' — ' || description ELSE '' END
      || ' (' || coalesce(c, 0) || ' accounts, last used: ' || coalesce(strftime(last_used_at, {STAMP}), 'never')
      || ')' AS line
    FROM personas LEFT JOIN n ON n.persona = name""",
)
def _(spark, d):
    return reports.persona_list(I.personas(spark, d), I.accounts(spark, d))


@query(
    "audit_log",
    f"""WITH {D.ACTIONS}, n AS (
      SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY persona ORDER BY ts DESC, id DESC) <= 20)
    SELECT persona, string_agg(strftime(ts, {STAMP}) || ' — ' || action || ': ' || detail, chr(10) ORDER BY ts, id) AS text
    FROM n GROUP BY persona""",
)
def audit_log(spark, d):
    return reports.assemble(reports.audit_log(I.actions(spark, d)), ["persona"])


_MODE = "CASE WHEN confidence >= 6 THEN 'turbo' WHEN confidence >= 3 THEN 'fast' ELSE 'guided' END"
_DOMAINS = f"{D.FLOWS}, domains AS (SELECT DISTINCT domain FROM flows)"


@query(
    "flow_list_lines",
    _doc(
        _DOMAINS,
        _lines("domains", 0, ["'## ' || domain"], "domain"),
        _lines(
            "flows",
            1,
            [f"'  - ' || action || ' (confidence: ' || confidence || ', mode: ' || {_MODE} || ') — ' || description"],
            "domain",
            by="action",
        ),
        _lines("domains", 2, ["''"], "domain"),
    ),
)
def _(spark, d):
    return _shown(reports.flow_list(I.flows(spark, d)), "domain")


@query(
    "flow_list_compact_lines",
    _doc(
        _DOMAINS,
        _lines("domains", 0, ["domain || ':'"], "domain"),
        _lines(
            "flows",
            1,
            [f"'  ' || action || ' — ' || description || ' (confidence: ' || confidence || ', ' || {_MODE} || ')'"],
            "domain",
            by="action",
        ),
        _lines("domains", 2, ["''"], "domain"),
    ),
)
def _(spark, d):
    return _shown(reports.flow_list(I.flows(spark, d), compact=True), "domain")


def _iso(column: str) -> str:
    return f"coalesce(strftime({column}, '%Y-%m-%dT%H:%M:%S.%f'), 'never')"


@query(
    "flow_domain_lines",
    _doc(
        _DOMAINS,
        _lines("domains", 0, ["'## ' || domain || ' flows'", "''"], "domain"),
        _lines(
            "flows",
            1,
            [
                f"'### ' || action || ' (confidence: ' || confidence || ', mode: ' || {_MODE} || ')'",
                "'  ' || description",
                "'  Steps: 2'",
                "CASE WHEN n > 1 THEN '  Caveats: slow, moves' END",
                "CASE WHEN n > 2 THEN '  Refs: ' || domain || '/login' END",
                f"'  Last verified: ' || {_iso('last_verified')}",
                "''",
            ],
            "domain",
            by="action",
        ),
    ),
)
def _(spark, d):
    return _shown(reports.flow_domains(I.flows(spark, d)), "domain")


def _step_text(indent: str, sep: str, sel: str, expect: str, detail: str) -> str:
    return (
        f"'{indent}1. navigate' || chr(10) || '{indent}2. click{sep}{sel}=#main{sep}{expect}=' || first_url"
        f" || '{sep}{detail}'"
    )


_DATES = [
    "'Description: ' || description",
    f"'Created: ' || {_iso('created')}",
    f"'Last verified: ' || {_iso('last_verified')}",
    f"'Last failed: ' || {_iso('last_failed')}",
]
_CAVEATS = [
    "CASE WHEN n > 1 THEN 'Caveats:' END",
    "CASE WHEN n > 1 THEN '  - slow' || chr(10) || '  - moves' END",
]
_REFS = "CASE WHEN n > 2 THEN 'Refs: ' || domain || '/login' END"


@query(
    "flow_detail_lines",
    _doc(
        D.FLOWS,
        _lines(
            "flows",
            0,
            [
                "'# ' || domain || '/' || action",
                f"'Mode: ' || {_MODE} || ' (confidence: ' || confidence || ')'",
                *_DATES,
                *_CAVEATS,
                _REFS,
                "''",
                "'Steps:'",
                _step_text("  ", " ", "selector", "expect", "(open)"),
            ],
            "domain, action",
        ),
    ),
)
def _(spark, d):
    return _shown(reports.flow_details(I.flows(spark, d)), "domain", "action")


@query(
    "flow_detail_compact_lines",
    _doc(
        D.FLOWS,
        _lines(
            "flows",
            0,
            [
                f"domain || '/' || action || ' (confidence: ' || confidence || ', ' || {_MODE} || ')'",
                *_DATES,
                "'Steps (2):'",
                _step_text("  ", " | ", "sel", "expect", "open"),
                *_CAVEATS,
                _REFS,
            ],
            "domain, action",
        ),
    ),
)
def _(spark, d):
    return _shown(reports.flow_details(I.flows(spark, d), compact=True), "domain", "action")


@query(
    "recipe_context_lines",
    _doc(
        f"""{D.FLOWS}, u AS (SELECT DISTINCT domain FROM sites),
        used AS (
          SELECT DISTINCT CASE WHEN domain IN (SELECT domain FROM flows) THEN 'exact' ELSE 'base' END AS match_tier,
            CASE WHEN domain IN (SELECT domain FROM flows) THEN domain ELSE {D.base('domain')} END AS match_key
          FROM u WHERE {D.base('domain')} IN (SELECT {D.base('domain')} FROM flows)),
        listed AS (
          SELECT used.*, f.* FROM used JOIN flows f ON match_key = CASE match_tier WHEN 'exact' THEN f.domain
            ELSE {D.base('f.domain')} END)""",
        _lines("used", 0, ["'## Stored Flow Recipes for this domain'", "''"], "match_tier, match_key"),
        _lines(
            "listed",
            1,
            [
                f"'### ' || domain || '/' || action || ' (confidence: ' || confidence || ', mode: ' || {_MODE} || ')'",
                "'  ' || description",
                "CASE WHEN n > 1 THEN '  Caveats:' END",
                "CASE WHEN n > 1 THEN '    - slow' || chr(10) || '    - moves' END",
                "CASE WHEN n > 2 THEN '  References: ' || domain || '/login' END",
                "'  Steps:'",
                _step_text("    ", " ", "selector", "expect_url", "(open)"),
                "''",
            ],
            "match_tier, match_key",
            by="domain || chr(9) || action",
        ),
    ),
)
def _(spark, d):
    flows = I.flows(spark, d)
    matches = joins.match_flows(I.urls(spark, d), flows)
    return _shown(reports.recipe_context(matches, flows), "match_tier", "match_key")


@query(
    "account_list_lines",
    _doc(
        D.ACCOUNTS,
        _lines(
            "accounts",
            0,
            [
                "'[' || id || '] ' || service || ': ' || email || ' (status: ' || status || ', creds: '"
                " || CASE WHEN creds_ref = '' THEN 'none' ELSE '***' END || ')'"
            ],
            at="created_at",
            seq="id",
        ),
    ),
)
def _(spark, d):
    return _shown(reports.account_list(I.accounts(spark, d)), "persona")


@query(
    "milestone_list_lines",
    _doc(
        D.MILESTONES,
        _lines(
            "milestones",
            0,
            [
                f"'[' || id || '] ' || strftime(ts, {STAMP}) || ' — ' || event || {_TAGS}"
                " || CASE WHEN screenshot_path <> '' THEN ' 📸' ELSE '' END",
                "CASE WHEN detail <> '' THEN '    ' || detail END",
            ],
            at="ts",
            seq="id",
        ),
    ),
)
def _(spark, d):
    return _shown(reports.milestone_list(I.milestones(spark, d)), "persona")


_SOURCE = "CASE WHEN source IS NOT NULL THEN '{0}' || source || '{1}' ELSE '' END"


@query(
    "context_list_lines",
    _doc(
        D.CONTEXT,
        _lines(
            "(SELECT * FROM context WHERE deleted_at IS NULL)",
            0,
            [
                "'[' || id || ']' || CASE WHEN digested_at IS NOT NULL THEN ' ✓' ELSE ' •' END || ' '"
                f" || left(summary, 120) || ' [' || tags || ']' || {_SOURCE.format(' (', ')')}"
            ],
            at="created_at",
            seq="id",
        ),
    ),
)
def _(spark, d):
    return _shown(reports.context_list(I.context(spark, d)), "persona")


def _block(section: int, name: str, title: str, line: str) -> list[str]:
    one = f"(SELECT * FROM {{0}} WHERE digest_class = '{name}')"
    return [
        _lines(one.format("per"), section, [f"'## {title} Entries (' || n || ')'"]),
        _lines(one.format("pending"), section + 1, [line], at="created_at", seq="id"),
        _lines(one.format("per"), section + 2, ["''"]),
    ]


_ENTRY = "'- [' || id || '] ' || summary || ' [' || tags || ']'"


@query(
    "digest_worksheet_lines",
    _doc(
        f"""{D.CONTEXT}, {D.DIGEST_PERSONAS}, people AS (SELECT name AS persona, context_summary FROM digest_personas),
        classed AS (SELECT *, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN digested_at IS NULL THEN 'new'
          WHEN updated_at > digested_at THEN 'updated' END AS digest_class FROM context),
        pending AS (SELECT * FROM classed WHERE digest_class IS NOT NULL),
        per AS (SELECT persona, digest_class, count(*) AS n FROM pending GROUP BY ALL),
        shown AS (SELECT persona FROM per UNION SELECT persona FROM people WHERE context_summary <> '')""",
        _lines(
            "(SELECT * FROM people WHERE context_summary <> '')",
            0,
            ["'## Current Summary'", "context_summary", "''"],
        ),
        _lines(
            "(SELECT * FROM people WHERE persona NOT IN (SELECT persona FROM shown))",
            0,
            ["'No context to digest for ''' || persona || '''. Add entries first.'"],
        ),
        *_block(1, "new", "New", f"{_ENTRY} || {_SOURCE.format('\n  Source: ', '')}"),
        *_block(4, "updated", "Updated", _ENTRY),
        *_block(7, "deleted", "Deleted", "'- [' || id || '] ' || summary"),
        _lines("shown", 10, ["'---'"]),
    ),
)
def digest_worksheet_lines(spark, d):
    return _shown(
        reports.digest_worksheet(I.digest_personas(spark, d), I.context(spark, d)), "persona"
    )


@query(
    "step_log_lines",
    _doc(
        D.steps(D.DAY),
        _lines(
            "steps",
            0,
            [
                "'  Step ' || step || ': [' || page_type || '] ' || description || ' -> ' || action_taken"
                " || ' (tier: ' || tier || ', conf: ' || printf('%.1f', floor(confidence * 2) / 2) || ')'"
            ],
            "run_id",
            seq="step",
        ),
    ),
)
def _(spark, d):
    # Engines round halves differently; halves of one need no rounding.
    steps = I.day_steps(spark, d).withColumn("confidence", F.floor(F.col("confidence") * 2) / 2)
    return _shown(reports.step_log(steps), "run_id")


@query(
    "run_footer_lines",
    f"""{_LABELS}, {D.STORED_FLOWS}, r AS (
      SELECT run_id, coalesce(end_step, last) AS done, 'site' || (run_id // 1000) || '.example.com' AS domain FROM ended)
    SELECT run_id, CASE WHEN b_confidence IS NULL THEN '📋 No stored flow for ' || r.domain || '.'
      ELSE '📋 Flow: ' || r.domain || '/visit (confidence ' || b_confidence || ', ' || CASE WHEN b_confidence >= 6
        THEN 'turbo' WHEN b_confidence >= 3 THEN 'fast path' ELSE 'guided' END || ', ' || done || '/6 steps OK)' END AS line
    FROM r LEFT JOIN stored ON stored.domain = r.domain""",
)
def _(spark, d):
    ended = runs.classify_runs(I.day_steps(spark, d), max_steps=6)
    site = F.concat(F.lit("site"), F.floor(F.col("run_id") / 1000).cast("string"), F.lit(".example.com"))
    stored = I.stored_flows(spark, d).select(
        "domain",
        F.col("domain").alias("flow_domain"),
        F.col("action").alias("flow_action"),
        "confidence",
    )
    footed = (
        ended.withColumn("domain", site)
        .join(stored, "domain", "left")
        .withColumns({"steps_completed": F.col("end_step"), "total_steps": F.lit(6)})
    )
    return reports.run_footer(footed).select("run_id", "line")


@query(
    "stored_timelines",
    f"""WITH shown AS ({CHECKS["timeline_lines"]}),
    pieces AS (SELECT *, string_split(coalesce(line, ''), chr(10)) AS list FROM shown),
    cut AS (SELECT * EXCLUDE (list, line), unnest(list) AS line, generate_subscripts(list, 1) AS nth FROM pieces)
    SELECT persona, row_number() OVER (PARTITION BY persona ORDER BY section, line_at, line_by, seq, sub, nth)
      AS line_no, line FROM cut""",
)
def _(spark, d):
    path = f"{work_folder(spark)}/timelines-{uuid4().hex}"
    sink.write_reports(reports.timeline(I.personas(spark, d), I.milestones(spark, d)), path)
    return sink.read_reports(spark, path)
