"""Queries over sources, filters, scalar functions and log reads."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import filters, log
from ledgerline.plans import derived as D
from ledgerline.plans import inputs as I
from ledgerline.plans.registry import CHECKS, query
from ledgerline.sources import imports, logs, tables
from ledgerline.streaming.folders import work_folder

AS_OF = datetime(2024, 2, 1)


def _by_type(**values):
    chain = F
    for name, value in values.items():
        if name != "otherwise":
            chain = chain.when(F.col("event_type") == name, value)
    return chain.otherwise(values["otherwise"])


# --- sources ---


@query(
    "entity_scan",
    f"WITH {D.PERSONAS} SELECT name, description, created_at FROM personas",
)
def _(spark, d):
    return I.personas(spark, d).select("name", "description", "created_at").orderBy("created_at", "name")


@query(
    "schema_upgrade",
    f"""WITH {D.PERSONAS}
    SELECT name, description, profile, locale FROM personas
    UNION ALL SELECT 'old-' || name, description, '', 'en-US' FROM personas""",
)
def _(spark, d):
    current = I.personas(spark, d)
    old = current.select(F.concat(F.lit("old-"), "name").alias("name"), "description", "created_at")
    return tables.combine("personas", current, old).select("name", "description", "profile", "locale")


def _stamped(spark, d):
    ts = F.col("ts")
    return I.source(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("event"),
        _by_type(
            view=F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
            click=F.date_format(ts, "yyyy-MM-dd'T'HH:mm"),
            purchase=F.date_format(ts, "yyyy-M-d"),
            error=F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
            otherwise=F.lit(""),
        ).alias("ts"),
    )


@query(
    "milestone_import",
    """SELECT event_id AS id, event_type AS event,
      CASE event_type WHEN 'view' THEN date_trunc('second', ts) WHEN 'click' THEN date_trunc('minute', ts)
        WHEN 'purchase' THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
        ELSE TIMESTAMP '2024-02-01 00:00:00' END AS ts
    FROM events WHERE event_type <> 'error'""",
)
def _(spark, d):
    return imports.import_milestones(_stamped(spark, d), AS_OF)[0]


@query(
    "milestone_import_rejects",
    """SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
    WHERE event_type = 'error'""",
)
def _(spark, d):
    return imports.import_milestones(_stamped(spark, d), AS_OF)[1].select("id", "ts")


def _lines(spark, d):
    """Side-log lines: object details, text details, lines cut short, blank lines."""
    ms = F.unix_millis("ts").cast("string")
    head = F.concat(F.lit('{"ts": '), ms, F.lit(', "action": "'))
    amount = F.floor("value").cast("string")
    return I.source(spark, d, "events").select(
        F.col("event_id").alias("id"),
        _by_type(
            signup=F.concat(head, F.lit('fill", "detail": {"durationMs": '), amount, F.lit("}}")),
            click=F.concat(head, F.lit('click", "detail": {"x": 1}}')),
            error=F.concat(head, F.lit('cut')),
            purchase=F.lit("   "),
            otherwise=F.concat(head, F.lit('open", "detail": "a page"}')),
        ).alias("value"),
    )


@query(
    "action_lines",
    """SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, date_trunc('milliseconds', ts) AS ts,
      CASE event_type WHEN 'signup' THEN 'fill' WHEN 'click' THEN 'click' ELSE 'open' END AS action,
      CAST(CASE event_type WHEN 'signup' THEN floor(value) WHEN 'click' THEN 0 ELSE -1 END AS BIGINT) AS duration_ms
    FROM events WHERE event_type IN ('signup', 'click', 'view')""",
)
def _(spark, d):
    rows, _rejects = logs.parse_action_lines(_lines(spark, d))
    return rows.select("id", "ts_ms", "ts", "action", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))


@query("action_line_rejects", "SELECT event_id AS id FROM events WHERE event_type = 'error'")
def _(spark, d):
    return logs.parse_action_lines(_lines(spark, d))[1].select("id")


def _account_rows(spark, d):
    o = I.source(spark, d, "orders")
    missing = F.col("o_orderstatus")
    return o.select(
        F.when(missing == "P", "").otherwise(F.concat(F.lit("ns/"), F.col("o_orderkey").cast("string"))).alias("entry"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("user"), F.col("o_custkey").cast("string"))).alias("username"),
    )


@query(
    "account_import",
    """SELECT 'ns/' || o_orderkey AS entry, 'user' || o_custkey AS username FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""",
)
def _(spark, d):
    return imports.split_accounts(_account_rows(spark, d))[0]


@query(
    "account_import_counts",
    """SELECT count(*) FILTER (o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW') AS imported,
      count(*) FILTER (o_orderstatus = 'P' OR o_orderpriority = '5-LOW') AS rejected FROM orders""",
)
def _(spark, d):
    return imports.split_accounts(_account_rows(spark, d))[2]


@query(
    "config_resolution",
    """WITH lines AS (
      SELECT source AS persona, CASE lang WHEN 'de' THEN 2 WHEN 'es' THEN 1 WHEN 'fr' THEN 0 ELSE 3 END AS p,
        doc_id AS n, lang || n_chars % 10 AS k, CAST(n_chars AS VARCHAR) AS v FROM documents),
    won AS (SELECT * FROM lines QUALIFY p = min(p) OVER (PARTITION BY persona))
    SELECT persona, k AS "key", arg_max(v, n) AS value FROM won GROUP BY persona, k""",
)
def _(spark, d):
    lang = F.col("lang")
    rank = F.when(lang == "de", 2).when(lang == "es", 1).when(lang == "fr", 0).otherwise(3)
    lines = I.source(spark, d, "documents").select(
        F.col("source").alias("persona"),
        rank.alias("precedence"),
        F.col("doc_id").alias("line_no"),
        F.concat(
            F.lit("  "),
            lang,
            (F.col("n_chars") % 10).cast("string"),
            F.lit(":  "),
            F.col("n_chars").cast("string"),
            F.lit(" "),
        ).alias("line"),
    )
    return imports.resolve_config(lines)


# --- filters ---


@query(
    "actions_of_persona",
    f"WITH {D.ACTIONS} SELECT * FROM actions WHERE persona = 'u7'",
)
def _(spark, d):
    return filters.list_for(I.actions(spark, d), ["ts", "id"], persona="u7")


@query(
    "live_context",
    f"WITH {D.CONTEXT} SELECT id, persona, created_at FROM context WHERE deleted_at IS NULL",
)
def _(spark, d):
    return filters.live(I.context(spark, d)).select("id", "persona", "created_at")


@query(
    "context_search",
    f"""WITH {D.CONTEXT} SELECT id, persona FROM context
    WHERE deleted_at IS NULL AND contains(lower(summary), 'and the')""",
)
def _(spark, d):
    return filters.search_context(I.context(spark, d), "and THE").select("id", "persona")


@query(
    "context_search_wildcards",
    f"""WITH {D.CONTEXT} SELECT id, persona FROM context
    WHERE deleted_at IS NULL AND summary ILIKE '%th_ %ent%'""",
)
def _(spark, d):
    return filters.search_context(I.context(spark, d), "th_ %ent", wildcards=True).select("id", "persona")


@query(
    "context_search_tagged",
    f"""WITH {D.CONTEXT} SELECT id, persona FROM context
    WHERE deleted_at IS NULL AND contains(lower(summary), 'en') AND (tags LIKE 'de ,%' OR tags LIKE '%, src3,')""",
)
def _(spark, d):
    return filters.search_context(I.context(spark, d), "en", tags=" de ,src3,").select("id", "persona")


@query(
    "milestones_with_tag",
    f"WITH {D.MILESTONES} SELECT id, persona, event FROM milestones WHERE list_contains(tags, 'post')",
)
def _(spark, d):
    return filters.with_tag(I.milestones(spark, d), "post").select("id", "persona", "event")


@query(
    "context_any_tag",
    f"WITH {D.CONTEXT} SELECT id, persona FROM context WHERE tags LIKE 'fr ,%' OR tags LIKE 'de ,%'",
)
def _(spark, d):
    return filters.with_any_tag(I.context(spark, d), "fr, de , ").select("id", "persona")


@query(
    "log_slice",
    f"WITH {D.ACTIONS} SELECT * FROM actions WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'",
)
def _(spark, d):
    since = F.lit(datetime(2024, 1, 10)).cast("timestamp")
    return log.log_slice(I.actions(spark, d), since)


@query(
    "visible_elements",
    f"WITH {D.ELEMENTS} SELECT page_id, pos, tag FROM elements WHERE visible",
)
def _(spark, d):
    return filters.visible(I.elements(spark, d)).select("page_id", "pos", "tag")


@query(
    "first_elements",
    f"""WITH {D.ELEMENTS} SELECT page_id, pos, tag FROM elements
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3""",
)
def _(spark, d):
    return filters.head_per(I.elements(spark, d), n=3).select("page_id", "pos", "tag")


@query(
    "masked_accounts",
    f"WITH {D.ACCOUNTS} SELECT id, service, CASE WHEN creds_ref = '' THEN '' ELSE '***' END AS creds_ref FROM accounts",
)
def _(spark, d):
    return filters.redact(I.accounts(spark, d)).select("id", "service", "creds_ref")


_FIELDS = "CASE event_type WHEN 'signup' THEN 'Password' WHEN 'error' THEN 'TOKEN' ELSE event_type END"


@query(
    "masked_fields",
    f"""SELECT event_id AS entry, {_FIELDS} AS field,
      CASE WHEN event_type IN ('signup', 'error') THEN '***' ELSE props END AS value FROM events""",
)
def _(spark, d):
    rows = I.source(spark, d, "events").select(
        F.col("event_id").alias("entry"),
        _by_type(
            signup=F.lit("Password"), error=F.lit("TOKEN"), otherwise=F.col("event_type")
        ).alias("field"),
        F.col("props").alias("value"),
    )
    return filters.redact_fields(rows)


@query(
    "entries_of_personas",
    f"""WITH {D.ACCOUNTS}, {D.PERSONAS}, entries AS (
      SELECT 'ns/' || persona || '/' || service || '/' || id AS entry FROM accounts)
    SELECT p.name AS persona, e.entry, replace(e.entry, 'ns/' || p.name || '/', '') AS service,
      e.entry IS NULL AS fallback
    FROM personas p LEFT JOIN entries e ON starts_with(e.entry, 'ns/' || p.name || '/')
      AND split_part(e.entry, '/', 2) = p.name""",
)
def _(spark, d):
    entries = I.accounts(spark, d).select(
        F.concat_ws("/", F.lit("ns"), "persona", "service", F.col("id").cast("string")).alias("entry")
    )
    return filters.entries_for(entries, I.personas(spark, d), "ns")


# --- scalar functions ---


@query(
    "url_domains",
    f"""WITH u AS (SELECT page_id, {D.DOMAIN} AS domain FROM pages)
    SELECT page_id, domain, {D.base('domain')} AS base, contains(domain, '.') AS tld FROM u""",
)
def _(spark, d):
    return I.urls(spark, d).select(
        "page_id",
        X.extract_domain("url").alias("domain"),
        X.base_domain(X.extract_domain("url")).alias("base"),
        X.has_tld(X.extract_domain("url")).alias("tld"),
    )


@query(
    "text_previews",
    r"""SELECT doc_id,
      regexp_replace(left(replace(lower(text), ' ', '-'), 40), '[^\p{L}\p{N}-]', '', 'g') AS slug,
      left(text, 120) AS cut, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short,
      left(text, 80) || '...' AS always, left(split_part(text, chr(10), 1), 200) AS first
    FROM documents""",
)
def _(spark, d):
    return I.source(spark, d, "documents").select(
        "doc_id",
        X.slug("text").alias("slug"),
        X.preview("text", 120).alias("cut"),
        X.preview("text", 100, "if_cut").alias("short"),
        X.preview("text", 80, "always").alias("always"),
        X.first_line("text", 200).alias("first"),
    )


@query(
    "rendered_tags",
    f"""WITH {D.MILESTONES}
    SELECT id, CASE WHEN len(tags) > 0 THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END AS brackets,
      CASE WHEN len(tags) > 0 THEN '`' || array_to_string(tags, '` `') || '`' ELSE '' END AS code
    FROM milestones""",
)
def _(spark, d):
    return I.milestones(spark, d).select(
        "id", X.render_tags("tags").alias("brackets"), X.render_tags("tags", "code").alias("code")
    )


@query(
    "split_tags",
    """SELECT doc_id AS id, lang || '|' || source || CASE WHEN doc_id % 3 = 0 THEN '|third' ELSE '' END AS tags,
      CAST(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n FROM documents""",
)
def _(spark, d):
    listed = F.when(F.col("id") % 3 == 0, F.concat("tags", F.lit(" ,, third,"))).otherwise(F.col("tags"))
    tags = X.split_tags(listed)
    return I.context(spark, d).select("id", F.array_join(tags, "|").alias("tags"), F.size(tags).alias("n"))


@query(
    "credential_refs",
    """WITH r AS (SELECT o_orderkey AS id, CASE o_orderpriority
        WHEN '1-URGENT' THEN 'gopass://docker:c' || o_custkey || '/ns/' || o_orderkey
        WHEN '2-HIGH' THEN 'local/ns/' || o_orderkey WHEN '3-MEDIUM' THEN 'gopass://ns/' || o_orderkey
        WHEN '4-NOT SPECIFIED' THEN 'codespace:x' || o_custkey || '/a/b' ELSE 'docker:abc' END AS ref,
        o_orderpriority AS p, o_custkey AS c FROM orders)
    SELECT id, CASE p WHEN '1-URGENT' THEN 'docker:c' || c WHEN '2-HIGH' THEN 'local' WHEN '3-MEDIUM' THEN ''
        WHEN '4-NOT SPECIFIED' THEN 'codespace:x' || c END AS env,
      CASE p WHEN '1-URGENT' THEN 'ns/' || id WHEN '2-HIGH' THEN 'ns/' || id WHEN '3-MEDIUM' THEN 'ns/' || id
        WHEN '4-NOT SPECIFIED' THEN 'a/b' END AS path,
      CASE WHEN p = '3-MEDIUM' THEN 'gopass://local/ns/' || id
        ELSE 'gopass://' || replace(ref, 'gopass://', '') END AS prefixed FROM r""",
)
def _(spark, d):
    p, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    cust = F.col("o_custkey").cast("string")
    ref = (
        F.when(p == "1-URGENT", F.concat(F.lit("gopass://docker:c"), cust, F.lit("/ns/"), key))
        .when(p == "2-HIGH", F.concat(F.lit("local/ns/"), key))
        .when(p == "3-MEDIUM", F.concat(F.lit("gopass://ns/"), key))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("codespace:x"), cust, F.lit("/a/b")))
        .otherwise("docker:abc")
    )
    return I.source(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        X.parse_creds_ref(ref)["env"].alias("env"),
        X.parse_creds_ref(ref)["path"].alias("path"),
        X.prefix_ref(ref, "local").alias("prefixed"),
    )


@query(
    "flow_refs",
    "SELECT page_id, split_part(url, '/', 1) AS domain, substr(url, strpos(url, '/') + 1) AS action FROM pages",
)
def _(spark, d):
    return I.urls(spark, d).select("page_id", X.flow_ref("url").alias("r")).select("page_id", "r.*")


@query(
    "formatted_times",
    f"""WITH {D.PERSONAS} SELECT name, coalesce(strftime(last_used_at, '%Y-%m-%d %H:%M'), 'never') AS used
    FROM personas""",
)
def _(spark, d):
    return I.personas(spark, d).select("name", X.format_ts("last_used_at").alias("used"))


@query(
    "json_columns",
    """SELECT event_id AS id, CASE WHEN event_type IN ('click', 'error') THEN -1
        WHEN event_type = 'view' THEN 0 ELSE 2 END AS n_tags,
      CASE WHEN event_type = 'purchase' THEN 'go' ELSE '' END AS step_action,
      CAST(length(props) * 12 AS INTEGER) AS typing_ms FROM events""",
)
def _(spark, d):
    quoted = F.concat(F.lit('["a", "'), F.col("event_type"), F.lit('"]'))
    raw = _by_type(click=F.lit("not json"), error=F.lit(None), view=F.lit("[]"), otherwise=quoted)
    steps = _by_type(
        purchase=F.lit('[{"action": "go", "amount": 3}]'), otherwise=F.lit("{broken")
    )
    return I.source(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.coalesce(F.size(X.json_strings(raw)), F.lit(-1)).alias("n_tags"),
        F.coalesce(F.get(X.json_steps(steps), F.lit(0))["action"], F.lit("")).alias("step_action"),
        X.fill_duration("props").alias("typing_ms"),
    )


@query(
    "response_json",
    """SELECT event_id AS resp_id, event_type <> 'signup' AS found,
      CASE WHEN event_type = 'signup' THEN -1 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k
    FROM events""",
)
def _(spark, d):
    parsed = X.extract_json("text")
    return I.responses(spark, d).select(
        "resp_id",
        parsed.isNotNull().alias("found"),
        F.coalesce(F.try_variant_get(parsed, "$.k", "bigint"), F.lit(-1)).alias("k"),
    )


@query(
    "conversation_json",
    "SELECT conv_id, turn, turn % 3 = 0 AS found, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS role FROM conversations",
)
def _(spark, d):
    c = I.source(spark, d, "conversations")
    answer = F.concat(F.lit(' {"turn":'), F.col("turn").cast("string"), F.lit(',"role":"'), "role", F.lit('"} done'))
    value = X.extract_json(F.when(F.col("turn") % 3 == 0, F.concat("text", answer)).otherwise(F.col("text")))
    role = F.coalesce(F.variant_get(value, "$.role", "string"), F.lit(""))
    return c.select("conv_id", "turn", value.isNotNull().alias("found"), role.alias("role"))


# --- log reads ---


@query(
    "recent_actions",
    f"""WITH {D.ACTIONS} SELECT * FROM actions
    QUALIFY row_number() OVER (PARTITION BY persona ORDER BY ts DESC, id DESC) <= 20""",
)
def recent_actions(spark, d):
    return log.recent_n(I.actions(spark, d))


@query(
    "recent_accounts_by_status",
    f"""WITH {D.ACCOUNTS} SELECT id, status, created_at FROM accounts
    QUALIFY row_number() OVER (PARTITION BY status ORDER BY created_at DESC, id DESC) <= 1500""",
)
def _(spark, d):
    rows = I.accounts(spark, d).select("id", "status", "created_at")
    return log.recent_n(rows, ["status"], ["created_at", "id"], 1500)


@query(
    "last_posts",
    f"""WITH {D.MILESTONES} SELECT id, persona, ts FROM milestones WHERE list_contains(tags, 'post')
    QUALIFY row_number() OVER (PARTITION BY persona ORDER BY ts DESC, id DESC) <= 5""",
)
def _(spark, d):
    rows = filters.with_tag(I.milestones(spark, d), "post").select("id", "persona", "ts")
    return log.last_n(rows, n=5)


@query(
    "date_breaks",
    f"""WITH {D.ACTIONS} SELECT id, persona, ts, CAST(ts AS DATE) AS date,
      coalesce(lag(CAST(ts AS DATE)) OVER (PARTITION BY persona ORDER BY ts, id) <> CAST(ts AS DATE), true) AS new_date
    FROM actions""",
)
def _(spark, d):
    return log.with_date_breaks(I.actions(spark, d)).select("id", "persona", "ts", "date", "new_date")


@query(
    "last_used",
    f"WITH {D.ACTIONS} SELECT persona, max(ts) AS last_used_at FROM actions GROUP BY persona",
)
def _(spark, d):
    return log.last_used(I.actions(spark, d))


@query(
    "touched_personas",
    f"""WITH {D.ACTIONS}, {D.PERSONAS}, u AS (SELECT persona, max(ts) AS t FROM actions GROUP BY persona)
    SELECT name, coalesce(greatest(last_used_at, t), TIMESTAMP '1970-01-01') AS last_used_at
    FROM personas LEFT JOIN u ON u.persona = name""",
)
def _(spark, d):
    never = F.lit(datetime(1970, 1, 1)).cast("timestamp")
    return log.touch(I.personas(spark, d), I.actions(spark, d)).select(
        "name", F.coalesce("last_used_at", never).alias("last_used_at")
    )


@query(
    "first_accounts",
    f"""WITH {D.ACCOUNTS} SELECT persona, id, service FROM accounts
    QUALIFY row_number() OVER (PARTITION BY persona ORDER BY created_at, id) = 1""",
)
def _(spark, d):
    return log.first_per(I.accounts(spark, d), ["persona"], ["created_at", "id"]).select(
        "persona", "id", "service"
    )


@query(
    "newest_actions_overall",
    f"WITH {D.ACTIONS} SELECT * FROM actions ORDER BY ts DESC, id DESC LIMIT 20",
)
def _(spark, d):
    return log.newest_overall(I.actions(spark, d))


@query(
    "latest_recordings",
    """SELECT 'u' || user_id AS directory, max('rec-' || strftime(ts, '%Y%m%d%H%M%S') || '.mp4') AS name
    FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def _(spark, d):
    ext = _by_type(error=F.lit(".txt"), otherwise=F.lit(".mp4"))
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    files = I.source(spark, d, "events").select(
        I.user("user_id").alias("directory"), F.concat(F.lit("rec-"), stamp, ext).alias("name")
    )
    return log.latest_recording(files)


@query(
    "action_counts",
    f"WITH {D.ACTIONS} SELECT persona, action, count(*) AS n FROM actions GROUP BY ALL",
)
def _(spark, d):
    return log.counts(I.actions(spark, d), "persona", "action")


@query(
    "stored_actions",
    f"""WITH {D.ACTIONS} SELECT id, persona, action, detail, ts, CAST(ts AS DATE) AS date FROM actions""",
)
def _(spark, d):
    path = f"{work_folder(spark)}/actions-{uuid4().hex}"
    actions = I.actions(spark, d)
    for half in (0, 1):
        logs.append_actions(actions.where(F.col("id") % 2 == half), path)
    return logs.read_actions(spark, path).select("id", "persona", "action", "detail", "ts", "date")


@query("stored_action_lines", f"SELECT * EXCLUDE (id) FROM ({CHECKS['action_lines']})")
def _(spark, d):
    path = f"{work_folder(spark)}/lines-{uuid4().hex}"
    _lines(spark, d).select("value").write.text(path)
    rows = logs.read_action_jsonl(spark, path)[0]
    return rows.select("ts_ms", "ts", "action", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))


@query(
    "imported_arrays",
    """SELECT 'ns/' || o_orderkey || '}"{' AS entry, 'user' || o_custkey AS username, '' AS error FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
    UNION ALL SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'ns/' || o_orderkey || '}"{' END, '',
      CASE WHEN o_orderstatus = 'P' THEN 'entry is missing' ELSE 'username is missing' END FROM orders
    WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'
    UNION ALL SELECT '', '', 'not valid JSON' FROM (SELECT DISTINCT o_orderkey % 4 FROM orders)""",
)
def _(spark, d):
    """Four files, each one array whose last record is broken off."""
    path = f"{work_folder(spark)}/arrays-{uuid4().hex}"
    o = I.source(spark, d, "orders")
    entry = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("ns/"), F.col("o_orderkey"), F.lit('}"{')))
    user = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("user"), F.col("o_custkey")))
    json = F.concat(F.to_json(F.struct(entry.alias("entry"), user.alias("username"))), F.lit(","))
    lines = o.select((F.col("o_orderkey") % 4).alias("file"), F.lit(1).alias("kind"), json.alias("value"))
    ends = lines.select("file").distinct()
    heads = ends.select("file", F.lit(0).alias("kind"), F.lit("[").alias("value"))
    tails = ends.select("file", F.lit(2).alias("kind"), F.lit('{"entry": "x", ').alias("value"))
    whole = lines.unionByName(heads).unionByName(tails).repartition("file").sortWithinPartitions("file", "kind")
    whole.select("file", "value").write.partitionBy("file").text(path)
    good, rejects, _counts = imports.import_accounts(spark, path)
    shown = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return good.select("entry", "username", F.lit("").alias("error")).unionByName(
        rejects.select(shown("entry"), F.lit("").alias("username"), "error")
    )
