"""Queries over run logs, recipe confidence, pages and frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerline.operators import confidence, joins, pages, runs, trim
from ledgerline.plans import derived as D
from ledgerline.plans import inputs as I
from ledgerline.plans.registry import query

NEVER = datetime(1970, 1, 1)
NEVER_SQL = "TIMESTAMP '1970-01-01 00:00:00'"

# --- confidence ---

_EFFECTIVE = f"""{D.OUTCOMES}, failed AS (
  SELECT run_id AS fr, min(ts) AS fts FROM outcomes WHERE outcome = 'fast_fail' GROUP BY run_id),
eff AS (
  SELECT o.* FROM outcomes o LEFT JOIN failed ON fr = o.run_id
  WHERE NOT coalesce(outcome = 'success' AND ts > fts, false))"""

# Generations end at a delete; within one, segments start at a reset.
_TRACE = f"""WITH {_EFFECTIVE}, {D.STORED_FLOWS},
g AS (
  SELECT eff.*, stored.* EXCLUDE (domain, action), count(*) FILTER (outcome = 'delete') OVER (
    PARTITION BY eff.domain ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gen
  FROM eff LEFT JOIN stored ON stored.domain = eff.domain),
h AS (
  SELECT *, gen = 0 AND b_confidence IS NOT NULL AS on_base, outcome <> 'delete' AND (
    (gen = 0 AND b_confidence IS NOT NULL) OR count(*) FILTER (outcome = 'save') OVER w > 0) AS alive
  FROM g WINDOW w AS (PARTITION BY domain, gen ORDER BY ts, id)),
s AS (
  SELECT *, count(*) FILTER (alive AND outcome IN ('save', 'fast_fail')) OVER (
    PARTITION BY domain, gen ORDER BY ts, id) AS seg FROM h),
trace AS (
  SELECT id, domain, outcome, ts, CASE WHEN alive THEN CAST(least(10, CASE WHEN seg = 0 THEN b_confidence ELSE 1 END
      + count(*) FILTER (alive AND outcome = 'success') OVER (PARTITION BY domain, gen, seg ORDER BY ts, id))
      AS INTEGER) END AS confidence,
    CASE WHEN alive THEN CASE WHEN on_base THEN b_created ELSE min(ts) FILTER (outcome = 'save') OVER v END END AS created,
    CASE WHEN alive THEN coalesce(max(ts) FILTER (alive AND outcome IN ('save', 'success')) OVER v,
      CASE WHEN on_base THEN b_verified END) END AS last_verified,
    CASE WHEN alive THEN coalesce(max(ts) FILTER (alive AND outcome = 'fast_fail') OVER v,
      CASE WHEN on_base THEN b_failed END) END AS last_failed
  FROM s WINDOW v AS (PARTITION BY domain, gen ORDER BY ts, id))"""

_SHOWN = f"""coalesce(confidence, -1) AS confidence, coalesce(created, {NEVER_SQL}) AS created,
  coalesce(last_verified, {NEVER_SQL}) AS last_verified, coalesce(last_failed, {NEVER_SQL}) AS last_failed"""


def _shown(df, *keys):
    return df.select(
        *keys,
        F.coalesce("confidence", F.lit(-1)).alias("confidence"),
        *[F.coalesce(c, F.lit(NEVER)).alias(c) for c in ("created", "last_verified", "last_failed")],
    )


def _trace(spark, d):
    log = I.flow_outcomes(spark, d)
    return confidence.replay_confidence(
        confidence.effective_outcomes(log), I.stored_flows(spark, d), sized_by=log
    )


@query("effective_outcomes", f"WITH {_EFFECTIVE} SELECT id, run_id, outcome FROM eff")
def _(spark, d):
    return confidence.effective_outcomes(I.flow_outcomes(spark, d)).select("id", "run_id", "outcome")


@query("confidence_trace", f"{_TRACE} SELECT id, domain, {_SHOWN} FROM trace")
def confidence_trace(spark, d):
    return _shown(_trace(spark, d), "id", "domain")


@query(
    "confidence_state",
    f"""{_TRACE}, last AS (
      SELECT * FROM trace QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) = 1)
    SELECT domain, CASE WHEN confidence >= 6 THEN 'turbo' WHEN confidence >= 3 THEN 'fast'
      ELSE 'guided' END AS tier, {_SHOWN} FROM last WHERE confidence IS NOT NULL""",
)
def _(spark, d):
    events = confidence.effective_outcomes(I.flow_outcomes(spark, d))
    return _shown(confidence.replay_state(events, I.stored_flows(spark, d)), "domain", "tier")


# --- runs ---

_LAGS = ", ".join(
    f"lag({c}, {k}) OVER w AS {c[0]}{k}" for c in ("action_taken", "page_type") for k in (1, 2)
)
_REPEATS = "coalesce(action_taken = a1 AND a1 = a2 AND page_type = p1 AND p1 = p2, false)"


@query(
    "stuck_runs",
    f"""WITH {D.steps('user_id')}, l AS (
      SELECT *, {_LAGS} FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step))
    SELECT run_id, min(step) AS stuck_step, arg_min(action_taken, step) AS action_taken,
      arg_min(page_type, step) AS page_type FROM l WHERE {_REPEATS} GROUP BY run_id""",
)
def stuck_runs(spark, d):
    return runs.stuck_points(I.user_steps(spark, d))


@query(
    "step_history",
    f"""WITH {D.steps('user_id')}, t AS (
      SELECT run_id, step, '  Step ' || step || ': ' || description || ' -> ' || action_taken
        || ' (conf: ' || floor(confidence * 64) / 64 || ')' AS line FROM steps)
    SELECT run_id, step, concat_ws(chr(10), lag(line, 3) OVER w, lag(line, 2) OVER w, lag(line, 1) OVER w) AS history
    FROM t WINDOW w AS (PARTITION BY run_id ORDER BY step)""",
)
def _(spark, d):
    # 64ths are written alike by both engines.
    steps = I.user_steps(spark, d).withColumn("confidence", F.floor(F.col("confidence") * 64) / 64)
    return runs.with_history(steps).select("run_id", "step", "history")


_LABELS = f"""WITH {D.steps(D.DAY)}, l AS (
  SELECT *, {_LAGS} FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step)),
labelled AS (
  SELECT *, CASE WHEN action_taken = 'done' THEN 'done'
    WHEN {_REPEATS} AND action_taken <> 'recaptcha_checkbox_passed' THEN 'stuck'
    WHEN confidence < 0.5 AND tier = 'heuristics' THEN 'needs_guidance'
    WHEN action_taken = 'abort' THEN 'aborted' END AS label FROM l),
ended AS (
  SELECT run_id, arg_min(label, step) FILTER (label IS NOT NULL) AS label,
    min(step) FILTER (label IS NOT NULL) AS end_step, max(step) AS last FROM labelled GROUP BY run_id)"""


@query(
    "run_outcomes",
    f"""{_LABELS} SELECT run_id, coalesce(label, CASE WHEN last >= 6 THEN 'max_steps' ELSE 'in_progress' END)
      AS outcome, coalesce(end_step, last) AS end_step FROM ended""",
)
def run_outcomes(spark, d):
    return runs.classify_runs(I.day_steps(spark, d), max_steps=6).select("run_id", "outcome", "end_step")


_RUNS = f"""runs AS (SELECT {D.DAY} AS run_id, min(value) >= 2 AS navigate_ok, max(value) > 120 AS fast_path_ok
  FROM events GROUP BY 1)"""


@query(
    "run_outcomes_with_starts",
    f"""{_LABELS}, {_RUNS} SELECT run_id, CASE WHEN NOT navigate_ok THEN 'navigate_failed'
      WHEN fast_path_ok THEN 'fast_path' WHEN label IS NOT NULL THEN label
      WHEN last >= 6 THEN 'max_steps' ELSE 'in_progress' END AS outcome FROM runs LEFT JOIN ended USING (run_id)""",
)
def _(spark, d):
    starts = (
        I.source(spark, d, "events")
        .groupBy(I.user_day().alias("run_id"))
        .agg(
            (F.min("value") >= 2).alias("navigate_ok"), (F.max("value") > 120).alias("fast_path_ok")
        )
    )
    return runs.classify_runs(I.day_steps(spark, d), starts, max_steps=6).select("run_id", "outcome")


def _recipes(spark, d):
    """Steps recorded per run; the stored pages stand for recipes without steps."""
    visited = I.source(spark, d, "events").groupBy(I.user_day().alias("run_id")).agg(
        F.count(F.lit(1)).alias("total_steps")
    )
    empty = I.urls(spark, d).select((-1 - F.col("page_id")).alias("run_id"), F.lit(0).alias("total_steps"))
    return visited.unionByName(empty)


@query(
    "replay_results",
    f"""WITH r AS (
      SELECT {D.DAY} AS run_id, row_number() OVER (PARTITION BY {D.DAY} ORDER BY ts, event_id) - 1 AS step,
        event_type <> 'error' AS ok, value, props FROM events),
    f AS (
      SELECT run_id, count(*) AS total, min(step) FILTER (NOT ok) AS failed_at,
        arg_min(value, step) FILTER (NOT ok) AS v, arg_min(props, step) FILTER (NOT ok) AS reason FROM r GROUP BY run_id)
    SELECT run_id, failed_at IS NULL AS success, CASE WHEN failed_at IS NULL THEN total
        WHEN v < 50 THEN failed_at + 1 ELSE failed_at END AS steps_completed,
      total AS total_steps, coalesce(failed_at, -1) AS failed_at, coalesce(reason, '') AS reason FROM f
    UNION ALL SELECT -1 - page_id, false, 0, 0, -1, 'No steps in recipe' FROM pages""",
)
def _(spark, d):
    results = I.day_steps(spark, d, "event_type", "value")
    results = results.select(
        "run_id",
        (F.col("step") - 1).alias("step"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("value") < 50, "url_mismatch").otherwise("selector").alias("cause"),
        F.col("description").alias("reason"),
    )
    return runs.replay_summary(_recipes(spark, d), results).withColumn(
        "failed_at", F.coalesce("failed_at", F.lit(-1))
    )


def _claims(spark, d):
    """Claimed steps name every event; the log lost the selectors of small ones."""
    v = F.col("value")
    events = I.source(spark, d, "events").select(
        I.user_day().alias("run_id"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("selector"),
        F.concat(F.lit("https://example.com/"), F.col("user_id").cast("string")).alias("url"),
        v.alias("value"),
    )
    log = events.select(
        "run_id", "action", F.when(v >= 20, F.col("selector")).otherwise("").alias("selector"), "url"
    )
    return events.drop("value"), log


@query(
    "verified_steps",
    f"""WITH c AS (
      SELECT {D.DAY} AS run_id, event_id AS step, event_type AS action, value,
        CASE WHEN event_type <> 'view' THEN props ELSE 'https://example.com/' || user_id END AS target,
        CASE WHEN event_type <> 'view' AND value >= 20 THEN props ELSE 'https://example.com/' || user_id END AS logged
      FROM events)
    SELECT run_id, step, EXISTS (SELECT 1 FROM c l WHERE l.run_id = c.run_id AND l.action = c.action
      AND l.logged = c.target) AS backed FROM c""",
)
def _(spark, d):
    claims, log = _claims(spark, d)
    return runs.flag_steps(claims, log).select("run_id", "step", "backed")


@query(
    "verified_caveats",
    f"""SELECT {D.DAY} AS run_id, props AS caveat FROM events WHERE {D.DAY} IN
      (SELECT {D.DAY} FROM events WHERE event_type = 'error')""",
)
def _(spark, d):
    events = I.source(spark, d, "events")
    caveats = events.select(I.user_day().alias("run_id"), F.col("props").alias("caveat"))
    log = events.select(I.user_day().alias("run_id"), (F.col("event_type") != "error").alias("ok"))
    return runs.verify_caveats(caveats, log)


@query(
    "checkpoint_audit",
    f"""WITH s AS (
      SELECT {D.DAY} AS run_id, row_number() OVER (PARTITION BY {D.DAY} ORDER BY ts, event_id) AS step,
        CASE event_type WHEN 'click' THEN 'example.com' WHEN 'view' THEN '' ELSE 'shop.example.net' END AS e,
        CASE WHEN value < 60 THEN 'example.com' WHEN value < 150 THEN 'shop.example.net' END AS o FROM events)
    SELECT run_id, coalesce(min(step) FILTER (bad), -1) AS failed_step,
      arg_min(e, step) FILTER (bad) AS expected_domain, arg_min(o, step) FILTER (bad) AS observed_domain,
      count(*) FILTER (e <> '') AS checkpoints
    FROM (SELECT *, coalesce(e <> '' AND o IS NOT NULL AND e <> o, false) AS bad FROM s) GROUP BY run_id""",
)
def _(spark, d):
    rows = I.day_steps(spark, d, "event_type", "value")
    t, v = F.col("event_type"), F.col("value")
    steps = rows.select(
        "run_id",
        "step",
        F.when(t == "click", "https://www.example.com/a")
        .when(t == "view", "")
        .otherwise("shop.example.net/x?y=1")
        .alias("expected_url"),
    )
    observed = rows.where(v < 150).select(
        "run_id",
        "step",
        F.when(v < 60, "http://example.com:8080/").otherwise("https://me@shop.example.net").alias("url"),
    )
    return runs.audit_checkpoints(steps, observed).withColumn(
        "failed_step", F.coalesce("failed_step", F.lit(-1))
    )


# --- pages ---

_FLAGS = f"""{D.ELEMENTS}, flagged AS (
  SELECT *, lower(tag) IN ('button', 'a', 'div', 'span') AND regexp_matches(lower(text), 'accept|cookie|consent')
      AND regexp_matches(lower(text), 'accept|agree|ok|got it|dismiss|allow') AS c,
    type = 'password' AS pw, tag = 'input' AND type IN ('text', 'email', 'tel', '') AS ti,
    tag = 'input' AND type = 'checkbox' AND regexp_matches(lower(name || ' ' || aria || ' ' || text),
      'terms|agree|accept|privacy|policy|tos') AS tc,
    lower(name) IN ('q', 'query', 'search') OR (tag = 'input' AND contains(lower(placeholder), 'search')) AS s,
    tag = 'iframe' AND regexp_matches(src, 'captcha|arkoselabs') AS cap FROM elements),
feat AS (
  SELECT page_id, count(*) AS n_elements, count(*) FILTER (pw) AS n_password, count(*) FILTER (ti) AS n_text_inputs,
    bool_or(tc) AS has_terms, bool_or(c) AS has_cookie, bool_or(s) AS has_search, bool_or(cap) AS has_captcha,
    arg_min(id, pos) FILTER (c) AS cid, arg_min(text, pos) FILTER (c) AS ctext,
    arg_max(id, pos) FILTER (s) AS sid, arg_max(name, pos) FILTER (s) AS sname,
    arg_max(src, pos) FILTER (cap) AS csrc FROM flagged GROUP BY page_id)"""

_CLASSED = f"""WITH {_FLAGS}, {D.PAGE_META}, t AS (
  SELECT p.page_id, p.title, feat.* EXCLUDE (page_id), CASE WHEN has_captcha THEN 'captcha'
    WHEN has_cookie THEN 'cookie_banner'
    WHEN regexp_matches(lower(title), '404|500|error|not found') THEN 'error'
    WHEN n_password > 0 AND n_text_inputs >= 2 AND (has_terms OR n_text_inputs >= 3) THEN 'signup'
    WHEN n_password > 0 AND n_text_inputs <= 2 THEN 'login' WHEN has_search THEN 'search'
    WHEN n_elements > 0 THEN 'content' ELSE 'unknown' END AS page_type
  FROM page_meta p LEFT JOIN feat ON feat.page_id = p.page_id),
classed AS (
  SELECT page_id, page_type, CAST(CASE page_type WHEN 'captcha' THEN 0.9 WHEN 'cookie_banner' THEN 0.8
      WHEN 'error' THEN 0.85 WHEN 'signup' THEN 0.7 WHEN 'login' THEN 0.8 WHEN 'search' THEN 0.7
      WHEN 'content' THEN 0.4 ELSE 0.1 END AS DOUBLE) AS confidence,
    CASE page_type WHEN 'captcha' THEN 'abort' WHEN 'cookie_banner' THEN 'dismiss' WHEN 'error' THEN 'abort'
      WHEN 'signup' THEN 'fill' WHEN 'login' THEN 'fill' WHEN 'search' THEN 'fill' ELSE 'none' END AS action_type,
    CASE WHEN page_type = 'captcha' THEN CASE WHEN contains(csrc, 'recaptcha') THEN 'recaptcha'
      WHEN contains(csrc, 'arkoselabs') THEN 'arkose' WHEN contains(csrc, 'hcaptcha') THEN 'hcaptcha' END END AS captcha_type,
    CASE page_type WHEN 'cookie_banner' THEN ctext WHEN 'error' THEN title WHEN 'signup' THEN 'signup form'
      WHEN 'login' THEN 'login form' WHEN 'search' THEN 'search input' END AS target,
    CASE page_type WHEN 'cookie_banner' THEN CASE WHEN cid <> '' THEN '#' || cid ELSE '' END
      WHEN 'search' THEN CASE WHEN sid <> '' THEN '#' || sid WHEN sname <> '' THEN 'input[name="' || sname || '"]'
        ELSE '' END END AS selector_hint
  FROM t)"""


def _classified(spark, d):
    return pages.classify_pages(I.elements(spark, d), I.page_meta(spark, d))


@query(
    "page_features",
    f"""WITH {_FLAGS} SELECT page_id, n_elements, n_password, n_text_inputs, has_terms, has_cookie,
      has_search, has_captcha FROM feat""",
)
def _(spark, d):
    return pages.page_features(I.elements(spark, d)).select(
        "page_id", "n_elements", "n_password", "n_text_inputs", "has_terms", "has_cookie",
        "has_search", "has_captcha",
    )


@query(
    "page_classes",
    f"""{_CLASSED} SELECT page_id, page_type, confidence, action_type, captcha_type, selector_hint,
      CASE WHEN page_type = 'captcha' THEN 'captcha: ' || captcha_type ELSE target END AS target FROM classed""",
)
def page_classes(spark, d):
    return _classified(spark, d).drop("detected")


@query(
    "page_class_counts",
    f"{_CLASSED} SELECT page_type, count(*) AS n FROM classed GROUP BY page_type",
)
def _(spark, d):
    return _classified(spark, d).groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))


# The stored pages list anchors only, with plain text inside.
_ANCHORS = r"""clean AS (
  SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'),
    '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
found AS (SELECT page_id, regexp_extract_all(h, '(?is)<a\b[^>]*>([^<]*)</a>', 1) AS texts FROM clean),
anchors AS (
  SELECT page_id, unnest(range(0, len(texts))) AS pos, unnest(texts) AS text FROM found)"""


@query(
    "page_elements",
    f"""WITH {_ANCHORS} SELECT page_id, CAST(pos AS INTEGER) AS pos, 'a' AS tag, '' AS id, '' AS name,
      '' AS type, trim(text) AS text FROM anchors""",
)
def _(spark, d):
    return pages.explode_elements(I.source(spark, d, "pages")).select(
        "page_id", "pos", "tag", "id", "name", "type", "text"
    )


@query(
    "stored_page_classes",
    f"""WITH {_ANCHORS}, f AS (
      SELECT page_id, count(*) AS n, bool_or(regexp_matches(lower(text), 'accept|cookie|consent')
        AND regexp_matches(lower(text), 'accept|agree|ok|got it|dismiss|allow')) AS cookie
      FROM anchors GROUP BY page_id)
    SELECT p.page_id, CASE WHEN cookie THEN 'cookie_banner'
      WHEN regexp_matches(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '404|500|error|not found')
        THEN 'error' WHEN n > 0 THEN 'content' ELSE 'unknown' END AS page_type
    FROM pages p LEFT JOIN f ON f.page_id = p.page_id""",
)
def _(spark, d):
    stored = I.source(spark, d, "pages")
    titles = stored.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    )
    classed = pages.classify_pages(pages.explode_elements(stored), titles)
    return classed.select("page_id", "page_type")


@query(
    "tier_answers",
    f"""{_CLASSED}, a AS (
      SELECT {D.DAY} AS page_id, CASE WHEN max(value) > 150 THEN 'login' WHEN max(value) > 100 THEN '' END AS api,
        CASE WHEN min(value) < 3 THEN 'search' END AS cli FROM events GROUP BY 1)
    SELECT c.page_id, coalesce(nullif(api, ''), cli, page_type) AS page_type,
      CASE WHEN coalesce(api, '') <> '' THEN 'api' WHEN cli IS NOT NULL THEN 'cli' ELSE 'heuristics' END AS tier_used
    FROM classed c LEFT JOIN a ON a.page_id = c.page_id""",
)
def _(spark, d):
    per_page = I.source(spark, d, "events").groupBy(I.user_day().alias("page_id")).agg(
        F.max("value").alias("hi"), F.min("value").alias("lo")
    )

    def answers(page_type):
        return per_page.select(
            "page_id",
            page_type.alias("page_type"),
            F.lit(0.95).alias("confidence"),
            F.lit("fill").alias("action_type"),
        ).where(F.col("page_type").isNotNull())

    api = answers(F.when(F.col("hi") > 150, "login").when(F.col("hi") > 100, ""))
    cli = answers(F.when(F.col("lo") < 3, "search"))
    meta = I.page_meta(spark, d)
    tiers = pages.coalesce_tiers(meta, api, cli, _classified(spark, d))
    return tiers.select("page_id", "page_type", "tier_used")


_TARGETS = {
    "click": "BUY something",
    "view": "the  article",
    "error": "q",
    "purchase": "search terms",
}


@query(
    "element_matches",
    f"""WITH {D.ELEMENTS}, w AS (
      SELECT event_id AS target_id, {D.DAY} AS page_id, unnest(CASE event_type WHEN 'click' THEN ['buy', 'something']
        WHEN 'view' THEN ['the', 'article'] WHEN 'error' THEN ['q'] WHEN 'purchase' THEN ['search', 'terms']
        ELSE ['nowhere'] END) AS word FROM events),
    m AS (
      SELECT w.target_id, min(pos) AS pos FROM w JOIN elements e ON e.page_id = w.page_id AND (
        contains(lower(text), word) OR contains(lower(aria), word) OR contains(lower(placeholder), word)
        OR contains(lower(name), word)) GROUP BY w.target_id)
    SELECT event_id AS target_id, coalesce(pos, -1) AS pos FROM events LEFT JOIN m ON target_id = event_id""",
)
def _(spark, d):
    chain = F
    for name, text in _TARGETS.items():
        chain = chain.when(F.col("event_type") == name, text)
    targets = I.source(spark, d, "events").select(
        F.col("event_id").alias("target_id"),
        I.user_day().alias("page_id"),
        chain.otherwise("nowhere").alias("description"),
    )
    return joins.match_elements(targets, I.elements(spark, d)).select(
        "target_id", F.coalesce("pos", F.lit(-1)).alias("pos")
    )


# --- frames ---

BEFORE_MS, AFTER_MS = 1_800_000, 5_400_000


def _trim_inputs(spark, d):
    return (
        I.frames(spark, d),
        I.recordings(spark, d).select("rec_id", "start_ms", "fps"),
        I.frame_actions(spark, d),
        BEFORE_MS,
        AFTER_MS,
    )


@query(
    "trim_summary",
    f"WITH {D.FRAMES} SELECT rec_id, n_frames, n_near, trimmed FROM gate",
)
def _(spark, d):
    return trim.trim_summary(*_trim_inputs(spark, d))


@query(
    "trimmed_frames",
    f"""WITH {D.FRAMES} SELECT f.rec_id, f.frame_idx, 'frame-' || f.frame_idx || '.png' AS file, g.trimmed
    FROM frames f JOIN gate g ON g.rec_id = f.rec_id
    LEFT JOIN near n ON n.rec_id = f.rec_id AND n.frame_idx = f.frame_idx
    WHERE n.rec_id IS NOT NULL OR NOT g.trimmed""",
)
def trimmed_frames(spark, d):
    return trim.trim_frames(*_trim_inputs(spark, d))


@query(
    "merged_ranges",
    f"""WITH {D.FRAMES}, cells AS (SELECT rec_id, frame_idx, frame_idx - row_number() OVER (
        PARTITION BY rec_id ORDER BY frame_idx) AS island FROM near)
    SELECT rec_id, min(frame_idx) AS start, max(frame_idx) AS "end" FROM cells GROUP BY rec_id, island""",
)
def _(spark, d):
    frames, recordings, actions, before, after = _trim_inputs(spark, d)
    counts = frames.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_frames"))
    ranges = trim.action_ranges(recordings, counts, actions, before, after)
    return trim.merge_ranges(ranges, ["rec_id"])
