"""SQL for the queries that DuckDB can answer over whole tables: brute force, independent of the operators' methods."""

from __future__ import annotations

from ..functions.dialogs import ROLES

_POINTS = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WS = "(" + " || ".join(f"chr({p})" for p in _POINTS) + ")"
_ROLE = "CASE " + " ".join(f"WHEN r IN ({', '.join(repr(n) for n in names)}) THEN '{role}'" for role, names in ROLES.items()) + " END"

P1 = f"""
WITH m AS (SELECT conversation_id, turn_id, CASE WHEN turn_id IS NULL THEN sent_at END AS at_time, {_ROLE} AS role, nullif(trim(text, {_WS}), '') AS body, message_id
  FROM (SELECT *, regexp_replace(lower(role), '[^a-z]', '', 'g') AS r FROM chat_messages WHERE conversation_id IS NOT NULL)),
d AS (SELECT conversation_id, turn_id, at_time, role, body, min(message_id) AS message_id FROM m GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id, at_time) - 1 AS pos, first_value(role) OVER (PARTITION BY conversation_id ORDER BY turn_id, at_time) = 'system' AS led FROM d),
e AS (SELECT *, CASE WHEN led AND pos = 0 THEN 'system' WHEN (pos - led::INTEGER) % 2 = 0 THEN 'user' ELSE 'assistant' END AS due FROM o),
u AS (SELECT conversation_id FROM e GROUP BY conversation_id HAVING
  bool_and(role IS NOT NULL AND body IS NOT NULL AND role = due)
  AND ((count(turn_id) = 0 AND count(DISTINCT at_time) = count(*)) OR (count(turn_id) = count(*) AND count(DISTINCT turn_id) = count(*) AND min(turn_id) IN (0, 1) AND max(turn_id) - min(turn_id) + 1 = count(*)))
  AND count(*) - max(led::INTEGER) >= 2 AND (count(*) - max(led::INTEGER)) % 2 = 0)
SELECT conversation_id, pos::INTEGER AS seq, role, message_id FROM e WHERE conversation_id IN (SELECT conversation_id FROM u)
"""

_WORDS = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
_TRIPLES = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
_SPLIT = lambda c: f"CASE WHEN lower(trim({c})) IN ('valid', 'val', 'dev') THEN 'validation' ELSE lower(trim({c})) END"
_TALKS = f"""
cvt AS (SELECT 'convai2' AS corpus, row_index AS id, {_SPLIT("source_split")} AS split, your_persona AS persona, array_to_string(flatten(list_transform(turns, lambda t: [t.text, t.response])), ' ') AS talk
  FROM convai2_conversations WHERE len(turns) > 0),
pcj AS (SELECT row_index, split, json_extract(dialog, '$[*]') AS turns FROM (SELECT row_index, split, CASE WHEN json_valid(dialog) THEN dialog END AS dialog FROM personachat_dialogs) WHERE json_type(dialog) = 'ARRAY'),
pct AS (SELECT 'personachat' AS corpus, row_index AS id, {_SPLIT("split")} AS split, NULL::VARCHAR[] AS persona,
  array_to_string(flatten(list_transform(turns, lambda t: [json_extract_string(t, '$.text'), json_extract_string(t, '$.response')])), ' ') AS talk
  FROM pcj WHERE len(turns) > 0 AND len(list_filter(turns, lambda t: json_type(t) <> 'OBJECT')) = 0),
talks AS (SELECT * FROM cvt UNION ALL SELECT * FROM pct)"""

P5 = f"""
WITH {_TALKS},
s AS (SELECT corpus, id, {_TRIPLES} AS g FROM (SELECT corpus, id, {_WORDS("talk")} AS w FROM talks)),
f AS (SELECT corpus, id, len(g) AS n, unnest(g) AS t FROM s),
x AS (SELECT a.corpus, a.id AS row_a, b.id AS row_b, a.n AS na, b.n AS nb, count(*) AS hits FROM f a JOIN f b ON a.corpus = b.corpus AND a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT corpus, row_a, row_b FROM x WHERE hits >= 0.6 * (na + nb - hits) - 1e-9
"""
P5_CLASSES = f"""
WITH RECURSIVE {_TALKS},
every AS (SELECT corpus, id, talk FROM talks UNION ALL SELECT 'personachat', row_index, NULL FROM personachat_dialogs WHERE dialog IS NOT NULL AND row_index NOT IN (SELECT id FROM pct)),
t AS (SELECT corpus, id, {_WORDS("talk")} AS w FROM every),
c AS (SELECT corpus, id, CASE WHEN len(w) > 0 THEN min(id) OVER (PARTITION BY corpus, w) ELSE id END AS class_row, w FROM t),
s AS (SELECT corpus, id, {_TRIPLES} AS g FROM c WHERE id = class_row),
f AS (SELECT corpus, id, len(g) AS n, unnest(g) AS t FROM s),
x AS (SELECT a.corpus, a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS hits FROM f a JOIN f b ON a.corpus = b.corpus AND a.t = b.t AND a.id <> b.id GROUP BY ALL),
e AS (SELECT corpus, a, b FROM x WHERE hits >= 0.6 * (na + nb - hits) - 1e-9),
r AS (SELECT DISTINCT corpus, a AS id, a AS root FROM e UNION SELECT e.corpus, e.b, r.root FROM r JOIN e ON e.corpus = r.corpus AND e.a = r.id),
g AS (SELECT corpus, id, min(root) AS root FROM r GROUP BY ALL), l AS (SELECT corpus, a AS id, count(*) AS links FROM e GROUP BY ALL)
SELECT c.corpus, c.id AS row_index, class_row, coalesce(root, class_row) AS group_row, coalesce(links, 0) AS links FROM c LEFT JOIN g ON g.corpus = c.corpus AND g.id = class_row LEFT JOIN l ON l.corpus = c.corpus AND l.id = class_row
"""
_P3_PAIRS = f"""
{_TALKS},
s AS (SELECT corpus, id, split, {_TRIPLES} AS g FROM (SELECT corpus, id, split, {_WORDS("CASE WHEN corpus = 'convai2' THEN concat_ws(' ', array_to_string(persona, ' '), talk) ELSE talk END")} AS w FROM talks WHERE corpus <> 'convai2' OR len(persona) > 0)),
f AS (SELECT corpus, id, split, len(g) AS n, unnest(g) AS t FROM s),
x AS (SELECT a.corpus, a.split, a.id AS held, b.id AS trained, a.n, count(*) AS hits FROM f a JOIN f b ON a.corpus = b.corpus AND a.t = b.t AND a.split IN ('validation', 'test') AND b.split = 'train' GROUP BY ALL),
pairs AS (SELECT corpus, split, held, trained FROM x WHERE hits >= 0.7 * n - 1e-9)"""
P3 = f"WITH {_P3_PAIRS} SELECT corpus, least(held, trained) AS row_a, greatest(held, trained) AS row_b FROM pairs"
P3_REPORT = f"""
WITH {_P3_PAIRS}, raw AS (SELECT corpus, split, id FROM talks UNION ALL SELECT 'personachat', {_SPLIT("split")}, row_index FROM personachat_dialogs WHERE dialog IS NOT NULL AND row_index NOT IN (SELECT id FROM pct)),
n AS (SELECT corpus, split, count(*) AS n_rows FROM raw WHERE split IN ('validation', 'test') GROUP BY ALL),
p AS (SELECT corpus, split, count(DISTINCT held) AS k, count(*) AS m FROM pairs GROUP BY ALL)
SELECT n.corpus, n.split, n_rows AS "rows", coalesce(k, 0) AS rows_in_train, coalesce(m, 0) AS pairs FROM n LEFT JOIN p ON n.corpus = p.corpus AND n.split = p.split
"""

_CANON = lambda x: f"list_sort(list_filter(list_transform({x}, lambda s: regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda s: s <> ''))"
_LINES = lambda c: f"""regexp_split_to_array("{c}", '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]')"""
_GROUPS = f"""
r AS (SELECT 'convai2' AS corpus, row_index AS id, {_CANON("your_persona")} AS a, {_CANON("partner_persona")} AS b FROM convai2_conversations
  UNION ALL SELECT 'synthetic', row_index, {_CANON(_LINES("user 1 personas"))}, {_CANON(_LINES("user 2 personas"))} FROM synthetic_chats),
g AS (SELECT corpus, id, min(id) OVER k AS row_a, count(*) OVER k AS copies FROM r WHERE len(a) > 0 AND len(b) > 0 WINDOW k AS (PARTITION BY corpus, least(a, b), greatest(a, b)))"""
P4 = f"WITH {_GROUPS} SELECT corpus, row_a, id AS row_b FROM g WHERE id <> row_a"
P4_GROUPS = f"WITH {_GROUPS} SELECT corpus, row_a, copies FROM g WHERE id = row_a"

_SHARES = f"""
w AS (SELECT doc_id, {_WORDS("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END)) AS g FROM w),
a AS (SELECT doc_id, i, g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS again FROM p),
c AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM a),
n AS (SELECT doc_id, count(*) AS n, count_if(covered) AS r FROM c GROUP BY doc_id)"""
P10 = f"WITH {_SHARES} SELECT doc_id FROM n WHERE r >= 0.3 * n - 1e-9"
P10_SHARES = f"WITH {_SHARES} SELECT d.doc_id, coalesce(n, 0) AS words, coalesce(r, 0) AS repeated_words, coalesce(r / n, 0.0) AS share FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"

ORACLE: dict[str, str] = {"p1_found": P1, "p3_found": P3, "p3_report": P3_REPORT, "p4_found": P4, "p4_groups": P4_GROUPS, "p5_found": P5, "p5_classes": P5_CLASSES, "p10_found": P10, "p10_repetition": P10_SHARES}
