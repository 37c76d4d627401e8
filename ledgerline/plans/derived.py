"""SQL twins of ``inputs``: the same derived tables for the checking engine."""

from __future__ import annotations

DAY = "(user_id * 1000 + dayofyear(ts))"


def minutes(expr: str) -> str:
    return f"make_timestamp(CAST((1672531200 + ({expr}) * 60) AS BIGINT) * 1000000)"


# Written another way than the library's expression; every page URL has a scheme.
DOMAIN = (
    "regexp_replace(lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1),"
    " '?', 1), '#', 1)), '^www\\.', '')"
)


def base(domain: str) -> str:
    return f"regexp_extract({domain}, '([^.]+\\.[^.]+)$', 1)"


ACTIONS = """actions AS (
  SELECT event_id AS id, 'u' || user_id AS persona, event_type AS action, props AS detail, ts
  FROM events)"""

PERSONAS = f"""personas AS (
  SELECT 'u' || c_custkey AS name, lower(c_mktsegment) AS description,
         CASE WHEN c_acctbal > 5000 THEN 'ordering' ELSE '' END AS purpose,
         'en-US' AS locale, 'UTC' AS timezone,
         CASE WHEN c_acctbal < 0 THEN 'Short sentences for u' || c_custkey ELSE '' END AS profile,
         CASE WHEN c_nationkey = 7 THEN 'Knows nation seven.' ELSE '' END AS context_summary,
         {minutes('c_custkey')} AS created_at,
         CASE WHEN c_nationkey >= 10 THEN {minutes('c_custkey + c_nationkey * 1440')} END AS last_used_at
  FROM customer
  UNION ALL
  SELECT 's' || s_suppkey, '', CASE WHEN s_acctbal > 5000 THEN 'ordering' ELSE '' END,
         'en-US', 'UTC',
         CASE WHEN s_acctbal < 0 THEN 'Short sentences for s' || s_suppkey ELSE '' END,
         CASE WHEN s_nationkey = 7 THEN 'Knows nation seven.' ELSE '' END,
         {minutes('s_suppkey')},
         CASE WHEN s_nationkey >= 10 THEN {minutes('s_suppkey + s_nationkey * 1440')} END
  FROM supplier)"""

ACCOUNTS = """accounts AS (
  SELECT o_orderkey AS id, 'u' || o_custkey AS persona,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Gmail' WHEN '2-HIGH' THEN 'outlook.com'
           WHEN '3-MEDIUM' THEN 'code.example.com' WHEN '4-NOT SPECIFIED' THEN 'newsboard'
           ELSE 'protonmail' END AS service,
         'm' || o_orderkey || '@example.com' AS email,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'local/ns/' || o_orderkey END AS creds_ref,
         CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'pending' ELSE 'blocked' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS created_at,
         CASE WHEN o_totalprice > 400000 THEN 'large' ELSE '' END AS notes
  FROM orders)"""

MILESTONES = """milestones AS (
  SELECT event_id AS id, 'u' || user_id AS persona, event_type AS event,
         CASE WHEN event_type = 'view' THEN '' ELSE props END AS detail,
         CASE WHEN event_type = 'click' THEN 'https://www.example.com/item/' || user_id ELSE '' END AS url,
         CASE event_type WHEN 'purchase' THEN ['post', 'shop'] WHEN 'signup' THEN ['account']
           WHEN 'error' THEN ['reply', 'error'] WHEN 'click' THEN ['comment'] ELSE [] END AS tags,
         CASE WHEN event_type = 'signup' THEN 'shots/' || event_id || '.png' ELSE '' END AS screenshot_path,
         'manual' AS source, ts
  FROM events)"""

CONTEXT = f"""context AS (
  SELECT d.doc_id AS id, d.source AS persona, d.text AS summary,
         CASE WHEN lang = 'en' THEN 'https://example.com/' || d.doc_id END AS source,
         lang || ' , ' || d.source || ',' AS tags,
         {minutes('d.doc_id * 60')} AS created_at,
         CASE WHEN quality = 1 THEN {minutes('d.doc_id * 60 + d.n_chars')} END AS updated_at,
         CASE WHEN quality IS NOT NULL THEN {minutes('d.doc_id * 60')} + INTERVAL 1 DAY END AS digested_at,
         CASE WHEN toxic = 1 THEN {minutes('d.doc_id * 60')} + INTERVAL 3 DAY END AS deleted_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

DIGEST_PERSONAS = """digest_personas AS (
  SELECT source AS name, CASE WHEN count(*) > 50 THEN 'Summary of ' || source ELSE '' END AS context_summary
  FROM documents GROUP BY source)"""

FLOWS = f"""sites AS (
  SELECT page_id, url, {DOMAIN} AS domain, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS action FROM pages),
recipe_sites AS (
  SELECT page_id, url, action, CASE WHEN url LIKE 'https://%' THEN replace(domain, 'example.org', 'example.invalid')
    ELSE 'old.' || domain END AS domain FROM sites),
flows AS (
  SELECT min(page_id) AS id, domain, action, 'Read ' || action AS description,
         CAST(least(10, count(*)) AS INTEGER) AS confidence, min(url) AS first_url, count(*) AS n,
         {minutes('min(page_id)')} AS created,
         CASE WHEN count(*) > 1 THEN {minutes('min(page_id) + 60')} END AS last_verified,
         CASE WHEN count(*) > 3 THEN {minutes('min(page_id) + 30')} END AS last_failed
  FROM recipe_sites GROUP BY domain, action)"""

ELEMENTS = f"""elements AS (
  SELECT {DAY} AS page_id, event_id AS pos,
    CASE event_type WHEN 'click' THEN 'BUTTON' WHEN 'view' THEN 'a' WHEN 'purchase' THEN 'input'
      WHEN 'signup' THEN 'input' ELSE CASE WHEN value > 150 THEN 'iframe' ELSE 'div' END END AS tag,
    CASE WHEN value > 30 THEN 'el' || event_id ELSE '' END AS id,
    CASE WHEN event_type = 'purchase' THEN
      CASE WHEN value < 20 THEN 'Terms' WHEN value > 120 THEN 'q' ELSE 'email' END ELSE '' END AS name,
    CASE event_type WHEN 'signup' THEN 'password' WHEN 'purchase' THEN
      CASE WHEN value < 20 THEN 'checkbox' WHEN value < 70 THEN 'email' ELSE 'text' END ELSE '' END AS type,
    CASE event_type WHEN 'click' THEN CASE WHEN value < 10 THEN 'Accept all cookies' ELSE 'Buy now' END
      WHEN 'view' THEN 'Read more' WHEN 'error' THEN 'Something failed' ELSE '' END AS text,
    CASE WHEN event_type = 'purchase' AND value > 70 AND value < 75 THEN 'Search here' ELSE '' END AS placeholder,
    CASE WHEN event_type = 'view' THEN 'Open the article' ELSE '' END AS aria,
    CASE WHEN event_type = 'error' AND value > 150 THEN
      CASE WHEN value > 250 THEN 'https://hcaptcha.example/x' WHEN value > 200 THEN 'https://arkoselabs.example/x'
      ELSE 'https://recaptcha.example/x' END ELSE '' END AS src,
    value >= 1 AS visible
  FROM events)"""

PAGE_META = f"""page_meta AS (
  SELECT {DAY} AS page_id, CASE WHEN min(value) < 1 THEN 'Top 500 pages' ELSE 'Visit' END AS title
  FROM events GROUP BY 1
  UNION ALL
  SELECT -1 - page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages)"""


def steps(run: str, name: str = "steps") -> str:
    return f"""{name} AS (
  SELECT {run} AS run_id, row_number() OVER (PARTITION BY {run} ORDER BY ts, event_id) AS step,
    event_id, ts, value,
    CASE WHEN value < 50 THEN 'content' ELSE 'search' END AS page_type, props AS description,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'fill'
      WHEN 'purchase' THEN CASE WHEN value > 100 THEN 'done' ELSE 'click' END
      ELSE CASE WHEN value > 80 THEN 'abort' WHEN value < 10 THEN 'recaptcha_checkbox_passed'
        ELSE 'click' END END AS action_taken,
    CASE WHEN value < 15 OR event_type = 'view' THEN 'heuristics' ELSE 'api' END AS tier,
    least(1.0, value / 100) AS confidence
  FROM events)"""


OUTCOMES = f"""outcomes AS (
  SELECT event_id AS id, 'site' || user_id || '.example.com' AS domain, 'visit' AS action, {DAY} AS run_id,
    CASE event_type WHEN 'signup' THEN 'save'
      WHEN 'error' THEN CASE WHEN value < 100 THEN 'fast_fail' ELSE 'delete' END
      ELSE 'success' END AS outcome, ts
  FROM events)"""

STORED_FLOWS = f"""stored AS (
  SELECT 'site' || c_custkey || '.example.com' AS domain, 'visit' AS action,
    CAST(least(10, c_nationkey) AS INTEGER) AS b_confidence, {minutes('c_custkey')} AS b_created,
    CASE WHEN c_nationkey > 5 THEN {minutes('c_custkey + 10')} END AS b_verified,
    CASE WHEN c_nationkey > 15 THEN {minutes('c_custkey + 5')} END AS b_failed
  FROM customer)"""

FRAMES = """recordings AS (
  SELECT user_id AS rec_id, epoch_us(min(ts)) // 1000 + 7200000 AS start_ms, epoch_us(max(ts)) // 1000 AS last_ms,
    CASE WHEN arg_min(event_type, ts) IN ('error', 'view') THEN pow(2.0, -14) ELSE pow(2.0, -11) END AS fps
  FROM events GROUP BY user_id),
frames AS (
  SELECT rec_id, unnest(range(0, CAST(greatest(0, floor((last_ms - start_ms) * fps / 1000)) AS BIGINT))) AS frame_idx
  FROM recordings),
counted AS (SELECT rec_id, count(*) AS n_frames FROM frames GROUP BY rec_id),
wanted AS (
  SELECT e.user_id AS rec_id,
    greatest(0, CAST(trunc((epoch_us(ts) // 1000 - start_ms) / (1000 / fps)) AS BIGINT)
      - CAST(floor(1800000 / (1000 / fps) + 0.99) AS BIGINT)) AS start_f,
    least(n_frames - 1, CAST(trunc((epoch_us(ts) // 1000 - start_ms) / (1000 / fps)) AS BIGINT)
      + CAST(floor((5400000 + CASE WHEN event_type = 'signup' THEN floor(value) * 60000 ELSE 0 END)
        / (1000 / fps) + 0.99) AS BIGINT)) AS end_f
  FROM events e JOIN recordings r ON e.user_id = r.rec_id JOIN counted c ON c.rec_id = r.rec_id),
near AS (
  SELECT DISTINCT rec_id, unnest(range(start_f, end_f + 1)) AS frame_idx FROM wanted WHERE start_f <= end_f),
gate AS (
  SELECT c.rec_id, c.n_frames, count(n.frame_idx) AS n_near,
    count(n.frame_idx) < c.n_frames * 0.8 AS trimmed
  FROM counted c LEFT JOIN near n ON n.rec_id = c.rec_id GROUP BY c.rec_id, c.n_frames)"""
