"""DuckDB SQL that checks the queries SQL can express."""

QUALITY = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM t
),
windows AS (
    SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows),
covered AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY r
),
m AS (
    SELECT w.r, doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN covered USING (r)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
        OR 100 * n_capitals > 40 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""

URLS = r"""
WITH rules(host, path, action) AS (
    VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
        ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
),
t AS (
    SELECT row_number() OVER () AS r, page_id,
        CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages
),
u AS (
    SELECT r, page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM t
),
best AS (
    SELECT r, arg_max({'rule': rules.host || rules.path, 'action': action},
        length(rules.host || rules.path) * 1000 + length(rules.host)) AS b
    FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
    GROUP BY r
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict FROM u LEFT JOIN best USING (r)
"""

PREFERENCE = r"""
WITH turns AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (
    SELECT conv_id, turn, text FROM turns WHERE role = 'assistant'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) = 1
),
rejected AS (
    SELECT t.* FROM turns t LEFT JOIN last l USING (conv_id) WHERE l.turn IS NULL OR t.turn < l.turn
    UNION ALL
    SELECT l.conv_id, l.turn, 'assistant', o.text FROM last l JOIN last o ON o.conv_id = xor(l.conv_id, 1::BIGINT)
),
sides AS (
    SELECT conv_id, turn, 'c' AS side, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns
    UNION ALL
    SELECT conv_id, turn, 'r', coalesce(role, ''), coalesce(text, '') FROM rejected
),
one AS (
    SELECT *, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
    FROM sides QUALIFY row_number() OVER (PARTITION BY conv_id, turn, side ORDER BY role, text) = 1
),
met AS (SELECT conv_id, turn, count(*) = 2 AND min(line) = max(line) AS same FROM one GROUP BY ALL),
cuts AS (SELECT conv_id, min(turn) FILTER (NOT same) AS cut FROM met GROUP BY conv_id),
placed AS (
    SELECT one.*, cut, cut IS NULL OR turn < cut AS shared,
        coalesce(sum(length(line)) FILTER (cut IS NOT NULL AND turn >= cut) OVER (
            PARTITION BY conv_id, side ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM one JOIN cuts USING (conv_id)
)
SELECT conv_id, count(*) FILTER (shared AND side = 'c') AS n_shared,
    coalesce(string_agg(line, '' ORDER BY turn) FILTER (shared AND side = 'c'), '') AS prompt,
    coalesce(string_agg(line, '' ORDER BY turn) FILTER (NOT shared AND side = 'c'), '') AS chosen,
    coalesce(string_agg(line, '' ORDER BY turn) FILTER (NOT shared AND side = 'r'), '') AS rejected,
    coalesce(string_agg((pos + length(head)) || ':' || (pos + length(line) - 1), ',' ORDER BY turn)
        FILTER (NOT shared AND side = 'c' AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((pos + length(head)) || ':' || (pos + length(line) - 1), ',' ORDER BY turn)
        FILTER (NOT shared AND side = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""

EMBEDDINGS = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a WHERE l.b < r.a OR l.b < r.b),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN degree d ON d.a = vec_id LEFT JOIN lowest w ON w.a = vec_id
"""

PREFIX_TRIE = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
bits AS (
    SELECT c, flatten(list_transform(string_split(c::VARCHAR, ''),
        lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]::BIGINT[])) AS steps
    FROM ids
),
crc AS (
    SELECT c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, steps), lambda a, x:
        CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384::BIGINT) ELSE xor(a, x) >> 1 END)) AS v
    FROM bits
),
starts AS (SELECT c, c - c % 5 AS b, v % 9 AS h FROM crc),
copied AS (SELECT s.c, t.pos, role, text FROM starts s JOIN turns t ON t.c = s.b AND t.pos <= s.h),
taken AS (SELECT s.c, h, count(k.c) AS k FROM starts s LEFT JOIN copied k ON k.c = s.c GROUP BY ALL),
rebuilt AS (
    SELECT * FROM copied
    UNION ALL SELECT t.c, t.pos - h + k, role, text FROM turns t JOIN taken USING (c) WHERE t.pos > h
),
paths AS (
    SELECT c, pos AS d, strlen(text) AS w, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
        OVER (PARTITION BY c ORDER BY pos) AS p
    FROM rebuilt
    UNION ALL SELECT c, 0, 0, '' FROM ids
),
up AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS parent FROM paths),
nodes AS (SELECT p, d, parent, any_value(w) AS w, min(c) AS c, count(*) AS n FROM up GROUP BY ALL),
kids AS (SELECT parent AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
sums AS (
    SELECT t.p, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n - 1) * u.w) AS saved
    FROM valued t JOIN valued u ON starts_with(u.p, t.p) GROUP BY ALL
),
lasts AS (SELECT c, arg_max(p, d) AS p FROM paths GROUP BY c),
ends AS (SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM lasts GROUP BY p)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, o.c AS parent_conv_id, v.n AS n_convs, v.n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM valued v JOIN sums USING (p) LEFT JOIN valued o ON o.p = v.parent AND v.d > 0 LEFT JOIN ends ON ends.p = v.p
"""

TOP_INNER = r"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT q.vec_id AS query_id, q.r, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 10
"""
