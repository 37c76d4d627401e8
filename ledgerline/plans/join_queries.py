"""Queries over joins, aggregates and table changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import changes, joins
from ledgerline.plans import derived as D
from ledgerline.plans import inputs as I
from ledgerline.plans.registry import query

AS_OF = datetime(2023, 2, 1)
AS_OF_SQL = "TIMESTAMP '2023-02-01 00:00:00'"
NEVER = datetime(1970, 1, 1)
NEVER_SQL = "TIMESTAMP '1970-01-01 00:00:00'"


# --- joins ---


@query(
    "persona_account_counts",
    f"""WITH {D.PERSONAS}, {D.ACCOUNTS} SELECT name, description,
      (SELECT count(*) FROM accounts a WHERE a.persona = p.name) AS account_count FROM personas p""",
)
def _(spark, d):
    return joins.persona_summary(I.personas(spark, d), I.accounts(spark, d)).select(
        "name", "description", "account_count"
    )


@query(
    "primary_emails",
    f"""WITH {D.ACCOUNTS} SELECT persona, email AS primary_email FROM accounts
    WHERE status = 'active' AND lower(service) IN
      ('outlook', 'outlook.com', 'gmail', 'tutanota', 'protonmail', 'hotmail')
    QUALIFY row_number() OVER (PARTITION BY persona ORDER BY created_at, id) = 1""",
)
def _(spark, d):
    return joins.primary_email(I.accounts(spark, d))


@query(
    "orphan_accounts",
    f"""WITH {D.ACCOUNTS} SELECT id, persona FROM accounts a
    WHERE NOT EXISTS (SELECT 1 FROM events e WHERE 'u' || e.user_id = a.persona)""",
)
def _(spark, d):
    return joins.orphans(I.accounts(spark, d), I.actions(spark, d), ("persona", "persona")).select(
        "id", "persona"
    )


@query(
    "insert_conflicts",
    f"""WITH {D.PERSONAS} SELECT name,
      name IN (SELECT 'u' || user_id FROM events) AS conflict FROM personas""",
)
def _(spark, d):
    base = I.actions(spark, d).select(F.col("persona").alias("name"))
    return joins.flag_known(I.personas(spark, d).select("name"), base, ["name"], "conflict")


_MATCH = f"""WITH {D.FLOWS}, u AS (SELECT page_id, {D.DOMAIN} AS domain FROM pages),
m AS (
  SELECT u.page_id, u.domain,
    CASE WHEN EXISTS (SELECT 1 FROM flows f WHERE f.domain = u.domain) THEN 'exact'
      WHEN EXISTS (SELECT 1 FROM flows f WHERE {D.base('f.domain')} = {D.base('u.domain')}) THEN 'base'
      ELSE 'none' END AS match_tier
  FROM u),
pairs AS (
  SELECT m.*, f.domain AS fd, f.action AS fa FROM m JOIN flows f
    ON CASE match_tier WHEN 'exact' THEN f.domain = m.domain
      WHEN 'base' THEN {D.base('f.domain')} = {D.base('m.domain')} END)"""


@query(
    "url_flow_matches",
    f"""{_MATCH} SELECT m.page_id, m.domain, m.match_tier, count(fd) AS n_flows,
      arg_min(fd, (fd, fa)) AS flow_domain, arg_min(fa, (fd, fa)) AS flow_action
    FROM m LEFT JOIN pairs p ON p.page_id = m.page_id GROUP BY ALL""",
)
def url_flow_matches(spark, d):
    return joins.match_flows(I.urls(spark, d), I.flows(spark, d)).select(
        "page_id", "domain", "match_tier", "n_flows", "flow_domain", "flow_action"
    )


@query(
    "matched_recipe_lists",
    f"""{_MATCH} SELECT DISTINCT match_tier,
      CASE match_tier WHEN 'exact' THEN domain ELSE {D.base('domain')} END AS match_key,
      fd AS domain, fa AS action FROM pairs""",
)
def _(spark, d):
    flows = I.flows(spark, d)
    matches = joins.match_flows(I.urls(spark, d), flows)
    return joins.recipe_lists(matches, flows).select("match_tier", "match_key", "domain", "action")


@query(
    "flows_by_domain",
    f"""WITH {D.FLOWS} SELECT domain, action, confidence,
      CASE WHEN confidence >= 6 THEN 'turbo' WHEN confidence >= 3 THEN 'fast' ELSE 'guided' END AS tier,
      count(*) OVER (PARTITION BY domain) AS domain_flows FROM flows""",
)
def _(spark, d):
    return joins.flows_by_domain(I.flows(spark, d)).select(
        "domain", "action", "confidence", X.confidence_tier("confidence").alias("tier"), "domain_flows"
    )


@query(
    "login_urls",
    f"""WITH {D.FLOWS}, a AS (
      SELECT page_id AS id, CASE WHEN url LIKE '%.html%' THEN split_part(domain, '.', 1) ELSE domain END AS service
      FROM sites), l AS (SELECT domain, CASE WHEN n > 1 THEN first_url END AS u FROM flows WHERE action = 'en')
    SELECT id, service, coalesce(u, CASE WHEN contains(service, '.') THEN 'https://' || service END) AS login_url,
      CASE WHEN u IS NOT NULL THEN 'flow' WHEN contains(service, '.') THEN 'service' ELSE 'no_tld' END AS status_code
    FROM a LEFT JOIN l ON l.domain = a.service""",
)
def _(spark, d):
    domain = X.extract_domain("url")
    accounts = I.urls(spark, d).select(
        F.col("page_id").alias("id"),
        F.when(F.col("url").contains(".html"), F.substring_index(domain, ".", 1))
        .otherwise(domain)
        .alias("service"),
    )
    # The English recipe of a site stands in for its login; seen once, its step has no URL.
    first = F.get("steps", F.lit(0))
    repeated = F.when(F.size("caveats") > 0, first["url"]).otherwise("")
    steps = F.array(F.struct(first["action"].alias("action"), repeated.alias("url")))
    login = I.flows(spark, d).select(
        "domain",
        F.when(F.col("action") == "en", "login").otherwise(F.col("action")).alias("action"),
        steps.alias("steps"),
    )
    return joins.login_urls(accounts, login)


@query(
    "found_accounts",
    f"""WITH {D.ACCOUNTS}, r AS (
      SELECT event_id AS req_id, 'u' || user_id AS persona, CASE event_type WHEN 'click' THEN 'GMAIL'
        WHEN 'view' THEN 'mail' WHEN 'error' THEN 'out' WHEN 'purchase' THEN 'zzz' ELSE 'o' END AS service
      FROM events)
    SELECT r.req_id, coalesce(arg_min(a.id, (a.created_at, a.id)), -1) AS account_id,
      arg_min(a.service, (a.created_at, a.id)) AS account_service
    FROM r LEFT JOIN accounts a ON a.persona = r.persona AND contains(lower(a.service), lower(r.service))
    GROUP BY r.req_id""",
)
def _(spark, d):
    t = F.col("event_type")
    requests = I.source(spark, d, "events").select(
        F.col("event_id").alias("req_id"),
        I.user("user_id").alias("persona"),
        F.when(t == "click", "GMAIL")
        .when(t == "view", "mail")
        .when(t == "error", "out")
        .when(t == "purchase", "zzz")
        .otherwise("o")
        .alias("service"),
    )
    return joins.find_account(requests, I.accounts(spark, d)).select(
        "req_id", F.coalesce("account_id", F.lit(-1)).alias("account_id"), "account_service"
    )


# --- changes ---


def _new_personas(spark, d):
    """One candidate per event, named after its user; most names repeat in the batch."""
    return I.source(spark, d, "events").select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("user_id").cast("string")))
        .otherwise(I.user("user_id"))
        .alias("name"),
        F.col("props").alias("description"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


_NEW = f"""WITH {D.PERSONAS}, fresh AS (
  SELECT CASE WHEN event_type = 'error' THEN 'e' ELSE 'u' END || user_id AS name, props AS description,
    ts AS created_at, event_id AS seq FROM events)"""


@query(
    "inserted_personas",
    f"""{_NEW} SELECT name, description, created_at FROM personas
    UNION ALL SELECT name, description, created_at FROM fresh WHERE name NOT IN (SELECT name FROM personas)
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1
    UNION ALL SELECT 'default', 'Default browser persona', {AS_OF_SQL}""",
)
def _(spark, d):
    base, _rejects = changes.insert_new(I.personas(spark, d), _new_personas(spark, d), "name", "seq")
    return changes.ensure_default(base, AS_OF).select("name", "description", "created_at")


@query(
    "insert_rejects",
    f"""{_NEW}, n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS r FROM fresh)
    SELECT seq, name, CASE WHEN name IN (SELECT name FROM personas) THEN 'already exists'
      ELSE 'repeated in batch' END AS reject_reason FROM n
    WHERE name IN (SELECT name FROM personas) OR r > 1""",
)
def _(spark, d):
    _base, rejects = changes.insert_new(I.personas(spark, d), _new_personas(spark, d), "name", "seq")
    return rejects.select("seq", "name", "reject_reason")


@query(
    "patched_accounts",
    f"""WITH {D.ACCOUNTS}, p AS (
      SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'click' THEN 'st' || event_id END AS status,
        CASE WHEN event_type = 'view' THEN props END AS notes FROM events),
    m AS (SELECT id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status,
      arg_max(notes, seq) FILTER (notes IS NOT NULL) AS notes FROM p GROUP BY id)
    SELECT a.id, service, coalesce(m.status, a.status) AS status, coalesce(m.notes, a.notes) AS notes
    FROM accounts a LEFT JOIN m ON m.id = a.id""",
)
def _(spark, d):
    t = F.col("event_type")
    patches = I.source(spark, d, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.when(t == "click", F.concat(F.lit("st"), F.col("event_id").cast("string"))).alias("status"),
        F.when(t == "view", F.col("props")).alias("notes"),
    )
    base, _rejects = changes.patch(
        I.accounts(spark, d), patches, "id", changes.PATCHABLE["accounts"], "seq"
    )
    return base.select("id", "service", "status", "notes")


@query(
    "upserted_flows",
    f"""WITH {D.STORED_FLOWS}, s AS (
      SELECT 'site' || user_id || '.example.com' AS domain, arg_max(props, ts) AS description,
        min(ts) AS first, max(ts) AS last FROM events
      GROUP BY user_id)
    SELECT domain, coalesce(s.description, '') AS description,
      CASE WHEN s.last IS NOT NULL THEN 1 ELSE b_confidence END AS confidence,
      coalesce(b_created, s.first) AS created, coalesce(s.last, b_verified, {NEVER_SQL}) AS last_verified,
      coalesce(b_failed, {NEVER_SQL}) AS last_failed
    FROM stored FULL JOIN s USING (domain)""",
)
def _(spark, d):
    base = I.stored_flows(spark, d).withColumn("description", F.lit(""))
    saves = I.source(spark, d, "events").select(
        F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain"),
        F.lit("visit").alias("action"),
        F.col("props").alias("description"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    return changes.upsert_flows(base, saves).select(
        "domain",
        "description",
        "confidence",
        "created",
        F.coalesce("last_verified", F.lit(NEVER)).alias("last_verified"),
        F.coalesce("last_failed", F.lit(NEVER)).alias("last_failed"),
    )


@query(
    "soft_deleted_context",
    f"""WITH {D.CONTEXT} SELECT c.id, coalesce(deleted_at,
      CASE WHEN quality = 0 THEN {AS_OF_SQL} END, {NEVER_SQL}) AS deleted_at
    FROM context c LEFT JOIN labels l ON l.doc_id = c.id""",
)
def _(spark, d):
    doomed = I.source(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return changes.soft_delete(I.context(spark, d), doomed, AS_OF).select(
        "id", F.coalesce("deleted_at", F.lit(NEVER)).alias("deleted_at")
    )


_CLASSES = f"""WITH {D.CONTEXT}, classed AS (
  SELECT *, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN digested_at IS NULL THEN 'new'
    WHEN updated_at > digested_at THEN 'updated' END AS digest_class FROM context)"""


@query(
    "digest_classes",
    f"{_CLASSES} SELECT id, persona, digest_class FROM classed WHERE digest_class IS NOT NULL",
)
def digest_classes(spark, d):
    return changes.digest_classes(I.context(spark, d)).select("id", "persona", "digest_class")


@query(
    "digest_counts",
    f"""{_CLASSES} SELECT persona, digest_class, count(*) AS n FROM classed
    WHERE digest_class IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    return changes.digest_counts(I.context(spark, d))


def _summaries(spark, d):
    """New summaries for the personas that have a German entry."""
    return (
        I.source(spark, d, "documents")
        .where("lang = 'de'")
        .groupBy(F.col("source").alias("persona"))
        .agg(F.concat(F.lit("German: "), F.count(F.lit(1)).cast("string")).alias("summary"))
    )


@query(
    "committed_context",
    f"""WITH {D.CONTEXT}, s AS (SELECT DISTINCT source AS persona FROM documents WHERE lang = 'de'),
    c AS (SELECT context.*, s.persona IS NOT NULL AS hit FROM context LEFT JOIN s USING (persona))
    SELECT id, coalesce(CASE WHEN hit AND created_at <= {AS_OF_SQL}
        AND (digested_at IS NULL OR updated_at > digested_at) THEN {AS_OF_SQL} ELSE digested_at END,
      {NEVER_SQL}) AS digested_at
    FROM c WHERE NOT (hit AND coalesce(deleted_at <= {AS_OF_SQL}, false))""",
)
def _(spark, d):
    _personas, context = changes.commit_digest(
        I.digest_personas(spark, d), I.context(spark, d), _summaries(spark, d), AS_OF
    )
    return context.select("id", F.coalesce("digested_at", F.lit(NEVER)).alias("digested_at"))


@query(
    "committed_summaries",
    f"""WITH {D.DIGEST_PERSONAS}, s AS (
      SELECT source AS name, 'German: ' || count(*) AS summary FROM documents WHERE lang = 'de' GROUP BY source)
    SELECT name, coalesce(summary, context_summary) AS context_summary
    FROM digest_personas LEFT JOIN s USING (name)""",
)
def _(spark, d):
    personas, _context = changes.commit_digest(
        I.digest_personas(spark, d), I.context(spark, d), _summaries(spark, d), AS_OF
    )
    return personas


@query(
    "edited_context",
    f"""WITH {D.CONTEXT} SELECT c.id, CASE WHEN l.quality = 1 THEN 'seen' ELSE c.tags END AS tags,
      coalesce(CASE WHEN l.quality = 1 THEN {AS_OF_SQL} ELSE updated_at END, {NEVER_SQL}) AS updated_at,
      coalesce(digested_at, {NEVER_SQL}) AS digested_at
    FROM context c LEFT JOIN labels l ON l.doc_id = c.id""",
)
def _(spark, d):
    edits = I.source(spark, d, "labels").select(
        F.col("doc_id").alias("id"),
        F.lit(1).alias("seq"),
        F.lit(None).cast("string").alias("summary"),
        F.when(F.col("quality") == 1, "seen").alias("tags"),
    )
    base, _rejects = changes.update_context(I.context(spark, d), edits, AS_OF, "seq")
    return base.select(
        "id",
        "tags",
        F.coalesce("updated_at", F.lit(NEVER)).alias("updated_at"),
        F.coalesce("digested_at", F.lit(NEVER)).alias("digested_at"),
    )


@query(
    "cascade_deleted",
    f"""WITH {D.PERSONAS}, {D.ACCOUNTS}, {D.ACTIONS}, gone AS (
      SELECT DISTINCT 'u' || user_id AS name FROM events WHERE value > 400)
    SELECT 'personas' AS "table", name AS id FROM personas WHERE name NOT IN (SELECT name FROM gone)
    UNION ALL SELECT 'accounts', CAST(id AS VARCHAR) FROM accounts WHERE persona NOT IN (SELECT name FROM gone)
    UNION ALL SELECT 'actions', CAST(id AS VARCHAR) FROM actions WHERE persona NOT IN (SELECT name FROM gone)""",
)
def _(spark, d):
    doomed = I.source(spark, d, "events").where("value > 400").select(I.user("user_id").alias("name"))
    tables = {
        "personas": I.personas(spark, d),
        "accounts": I.accounts(spark, d),
        "actions": I.actions(spark, d),
    }
    kept, _refused = changes.cascade_delete(tables, doomed)
    parts = [
        kept[name].select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"))
        for name, key in (("personas", "name"), ("accounts", "id"), ("actions", "id"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "hard_deleted",
    """SELECT event_id AS id, event_type AS event,
      event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AS removed FROM events""",
)
def _(spark, d):
    doomed = I.accounts(spark, d).where("status = 'blocked'").select("id")
    return joins.flag_known(I.milestones(spark, d).select("id", "event"), doomed, ["id"], "removed")


@query(
    "assigned_ids",
    """SELECT event_id AS seq, (SELECT max(o_orderkey) FROM orders)
      + row_number() OVER (ORDER BY ts, event_id) AS id FROM events""",
)
def _(spark, d):
    new = I.source(spark, d, "events").select(F.col("event_id").alias("seq"), "ts")
    return changes.assign_ids(
        I.accounts(spark, d), new, ["ts", "seq"]
    ).select("seq", "id")
