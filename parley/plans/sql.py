"""The core queries in DuckDB's SQL, built from the same fixed values."""

from __future__ import annotations

from ..functions.dialogs import ROLES
from ..functions.text import ANSWER_TAG, CONTRACTIONS, IMAGE_PROMPT, TEXT_PROMPT, THINK_TAG, THINKING

#: Code points of Unicode white space, as SQL text and as a class for regular expressions.
_POINTS = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS = "(" + " || ".join(f"chr({p})" for p in _POINTS) + ")"
WS_CLASS = "[" + "".join(rf"\x{{{p:04x}}}" for p in _POINTS) + "]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rounded(x: str, digits: int) -> str:
    """To the nearest by the exact value of the double, ties to even, as printing does."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS_CLASS}+', ' ', 'g'), ' ')"


def fold(x: str) -> str:
    return collapse(f"lower(coalesce({x}, 'none'))")


def expand(x: str) -> str:
    e = f"replace(lower(coalesce({x}, 'none')), '’', '''')"
    for a, b in CONTRACTIONS.items():
        e = f"regexp_replace({e}, {text(rf'\b{a}\b')}, {text(b)}, 'g')"
    return collapse(e)


def each(x: str, f: str) -> str:
    return f"list_transform({x}, lambda s: {f})"


def joined(x: str, sep: str) -> str:
    return f"array_to_string({x}, {sep})"


def canonical(x: str) -> str:
    s = each(x, strip("s"))
    return f"(CASE WHEN len({x}) > 0 AND len(list_filter({s}, lambda y: y IS NULL OR y = '')) = 0 THEN list_sort({s}) END)"


def comparable(x: str) -> str:
    s = each(f"coalesce({x}, []::VARCHAR[])", strip("coalesce(s, 'None')"))
    return f"list_sort(list_filter({s}, lambda y: y <> ''))"


def key(x: str) -> str:
    return f"sha256({joined(comparable(x), 'chr(31)')})"


def is_list(x: str) -> str:
    return f"(json_valid({x}) AND coalesce(json_type(CASE WHEN json_valid({x}) THEN {x} END), '') = 'ARRAY')"


def elements(x: str) -> str:
    return f"json_extract_string(CASE WHEN json_valid({x}) THEN {x} END, '$[*]')"


def strict(x: str) -> str:
    types = f"json_type(CASE WHEN json_valid({x}) THEN {x} END, '$[*]')"
    return f"(CASE WHEN {is_list(x)} AND len(list_filter({types}, lambda y: y <> 'VARCHAR')) = 0 THEN {elements(x)} END)"


def lenient(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN []::VARCHAR[] WHEN {is_list(x)} THEN {each(elements(x), "coalesce(s, 'None')")} ELSE [{x}] END)"


def ordered(x: str) -> str:
    kept = f"list_filter({each(strict(x), strip('s'))}, lambda y: y <> '')"
    return f"(CASE WHEN len({kept}) > 0 THEN {joined(kept, "' '")} END)"


_SPLIT = "CASE WHEN lower(trim(source_split)) = 'valid' THEN 'validation' ELSE lower(trim(source_split)) END"
_GET = lambda k: f"CASE WHEN json_exists(t, '$.{k}') THEN json_extract_string(t, '$.{k}') ELSE '' END"
BASE = f"""
cv AS (SELECT row_index, {_SPLIT} AS split, your_persona AS one, partner_persona AS two,
  list_transform(turns, lambda t: struct_pack(text := t.text, response := t.response)) AS turns FROM convai2_conversations),
pc AS (SELECT row_index, split, {lenient("your_persona_revised")} AS one, {lenient("partner_persona_revised")} AS two,
  CASE WHEN {is_list("dialog")} THEN list_transform(json_extract(CASE WHEN json_valid(dialog) THEN dialog END, '$[*]'),
    lambda t: struct_pack(text := {_GET("text")}, response := {_GET("response")})) END AS turns FROM personachat_dialogs)
"""
_RAW = f"CASE WHEN len(turns) > 0 THEN sha256(array_to_string(list_transform(turns, lambda t: {fold('t.text')} || chr(31) || {fold('t.response')}), chr(30))) END"
# the expansion is long, so utterances are expanded once and put together again
EXPANDED = f"""
{BASE},
said AS (SELECT 'c' AS c, row_index, unnest(turns) AS t, unnest(range(len(turns))) AS i FROM cv WHERE len(turns) > 0
  UNION ALL SELECT 'p', row_index, unnest(turns), unnest(range(len(turns))) FROM pc WHERE len(turns) > 0),
told AS (SELECT c, row_index, i, {expand("t.text")} AS a, {expand("t.response")} AS b FROM said),
texts AS (SELECT c, row_index, string_agg(a || ' ' || chr(31) || ' ' || b, ' ' || chr(30) || ' ' ORDER BY i) AS body FROM told GROUP BY c, row_index),
cvd AS (SELECT cv.row_index AS id, split, sha256(body) AS dialog, {key("one")} AS one, {key("two")} AS two FROM cv LEFT JOIN texts ON c = 'c' AND texts.row_index = cv.row_index),
pcd AS (SELECT pc.row_index AS id, split, sha256(body) AS dialog, {key("one")} AS one, {key("two")} AS two FROM pc LEFT JOIN texts ON c = 'p' AND texts.row_index = pc.row_index)
"""
RAW = f"""
{BASE},
cvd AS (SELECT row_index AS id, split, {_RAW} AS dialog FROM cv),
pcd AS (SELECT row_index AS id, split, {_RAW} AS dialog FROM pc)
"""
PERSONAS = f"""
{BASE},
cvp AS (SELECT one AS p FROM cv UNION ALL SELECT two FROM cv),
pcp AS (SELECT one AS p FROM pc UNION ALL SELECT two FROM pc)
"""
SENTENCES = f"""
{PERSONAS},
cvs AS (SELECT s FROM (SELECT {strip("s")} AS s FROM (SELECT unnest(p) AS s FROM cvp)) WHERE s <> ''),
pcs AS (SELECT s FROM (SELECT {strip("s")} AS s FROM (SELECT unnest(p) AS s FROM pcp)) WHERE s <> '')
"""
_USABLE = lambda: f"len(p) > 0 AND len(list_filter(p, lambda y: y IS NULL OR {strip('y')} = '')) = 0"
STRICT = f"""
{BASE},
a AS (SELECT p FROM (SELECT one AS p FROM cv UNION ALL SELECT two FROM cv) WHERE {_USABLE()}),
b AS (SELECT p FROM (SELECT {strict("your_persona_revised")} AS p FROM personachat_dialogs UNION ALL SELECT {strict("partner_persona_revised")} FROM personachat_dialogs) WHERE {_USABLE()})
"""


def overlap(a: str, b: str) -> str:
    """One row of overlap statistics over two queries of a column k."""
    return f"""SELECT size_a, size_b, size_both, size_a - size_both AS only_a, size_b - size_both AS only_b, size_a + size_b - size_both AS size_union,
coalesce({rounded('size_both / nullif(size_a + size_b - size_both, 0)', 4)}, 0.0) AS jaccard FROM (SELECT
(SELECT count(DISTINCT k) FROM ({a})) AS size_a, (SELECT count(DISTINCT k) FROM ({b})) AS size_b,
(SELECT count(*) FROM (SELECT DISTINCT k FROM ({a}) WHERE k IS NOT NULL INTERSECT SELECT DISTINCT k FROM ({b}))) AS size_both)"""


def stage(name: str, rule: str) -> str:
    return f"""SELECT '{name}' AS stage, *, {rounded('(size_both * 100)::DOUBLE / nullif(size_a, 0)', 2)} AS coverage_a, {rounded('(size_both * 100)::DOUBLE / nullif(size_b, 0)', 2)} AS coverage_b
FROM ({overlap(f"SELECT {rule} AS k FROM a", f"SELECT {rule} AS k FROM b")})"""


def presence(name: str, a: str, b: str) -> str:
    return f"""SELECT split, count(*) AS n_keys, count(there) AS n_present, {rounded('count(there)::DOUBLE / count(*) * 100', 1)} AS share, '{name}' AS corpus
FROM (SELECT DISTINCT split, dialog FROM {a} WHERE dialog IS NOT NULL) x LEFT JOIN (SELECT DISTINCT dialog, 1 AS there FROM {b} WHERE dialog IS NOT NULL) y USING (dialog) GROUP BY split"""


_MISSING = lambda c: f"({c} IS NULL OR {strip(c)} IN ('', '[]'))"
_PC_COLUMNS = [f"{w}_{k}" for k in ("persona_original",) for w in ("your", "partner")] + ["your_persona_revised", "partner_persona_revised", "your_enhanced_persona_original", "partner_enhanced_persona_original", "your_enhanced_persona_revised", "partner_enhanced_persona_revised"]


def missing(table: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {text(c)} AS \"column\", count(*) - count_if({m}) AS n_filled, count_if({m}) AS n_missing, count_if({m}) = 0 AS all_filled FROM {table}" for c, m in conditions.items())


def dependency(k: str, v: str) -> str:
    return f"""SELECT {text(k)} AS key, {text(v)} AS value, count(*) AS n_keys, count_if(n > 1) AS n_conflicting, coalesce(max(n), 0) AS most_values, coalesce(bool_and(n <= 1), true) AS holds
FROM (SELECT k, count(*) AS n FROM (SELECT DISTINCT "{k}" AS k, "{v}" AS v FROM persona_mapping) GROUP BY k)"""


def dependent_rows(k: str, v: str) -> str:
    return f"""SELECT {text(f'{k} -> {v}')} AS dependency, k, v FROM (SELECT k, v, count(*) OVER (PARTITION BY k) AS n FROM (SELECT DISTINCT "{k}" AS k, "{v}" AS v FROM persona_mapping)) WHERE n > 1"""


def unique(a: str, b: str) -> str:
    return f"""SELECT {text(a)} AS one, {text(b)} AS two, sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_repeated, sum(n) = count(*) AS is_unique
FROM (SELECT count(*) AS n FROM personachat_dialogs GROUP BY "{a}", "{b}")"""


_SPARK_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp", "VARCHAR[]": "array<string>", 'STRUCT(turn_id INTEGER, "text" VARCHAR, response VARCHAR)[]': "array<struct<turn_id:int,text:string,response:string>>"}
_TABLES = ("convai2_conversations", "personachat_dialogs", "synthetic_chats", "persona_mapping")
_SCHEMA = " UNION ALL ".join(f"""SELECT '{t}' AS dataset, column_name AS "column", CASE column_type {" ".join(f"WHEN {text(k)} THEN '{v}'" for k, v in _SPARK_TYPES.items())} ELSE column_type END AS type FROM (DESCRIBE {t})""" for t in _TABLES)


def oracle() -> dict[str, str]:
    import hashlib

    import numpy as np

    from ..functions.images import encode_png
    from .catalog import DAMAGE, LIMIT

    pairs = [("persona-id", "persona_revised"), ("persona_original", "persona_revised"), ("persona-id", "enhancer"), ("persona-id", "row_index")]
    uniques = [("your_persona_original", "partner_persona_original"), ("your_persona_revised", "partner_persona_revised"), ("your_persona_revised", "dialog"), ("dialog", "enhancer")]
    flat = lambda c: f"nullif({strip(f'\"{c}\"')}, '')"
    one, two = ordered("your_persona_original"), ordered("partner_persona_original")
    paired = f"""o AS (SELECT {one} AS o, {ordered("your_persona_revised")} AS r FROM personachat_dialogs UNION ALL SELECT {two}, {ordered("partner_persona_revised")} FROM personachat_dialogs),
m AS (SELECT sha256(o) AS persona_id, o AS persona_original, min(r) AS persona_revised FROM o WHERE o IS NOT NULL GROUP BY o)"""
    canon = f"""t AS (SELECT {canonical("your_persona")} AS p FROM convai2_conversations UNION ALL SELECT {canonical("partner_persona")} FROM convai2_conversations)"""
    canon_ids = f"SELECT row_index, sha256({joined(canonical('your_persona'), chr(39) + ' ' + chr(39))}) AS your_persona_id, sha256({joined(canonical('partner_persona'), chr(39) + ' ' + chr(39))}) AS partner_persona_id FROM convai2_conversations"
    written = """w AS (SELECT row_index, 0 AS shard, enhanced_persona_revised AS value FROM persona_mapping WHERE enhanced_persona_revised IS NOT NULL
UNION ALL SELECT row_index, 1, 'again: ' || enhanced_persona_revised FROM persona_mapping WHERE enhanced_persona_revised IS NOT NULL AND enhancer = 'pe-7b-rerun'),
c AS (SELECT row_index, max_by(value, shard) AS value FROM w GROUP BY row_index)"""
    sy = """syp AS (SELECT regexp_split_to_array("user 1 personas", '\\r\\n|\\r|\\n') AS p FROM synthetic_chats UNION ALL SELECT regexp_split_to_array("user 2 personas", '\\r\\n|\\r|\\n') FROM synthetic_chats)"""
    clean = lambda x: f"regexp_replace(coalesce({x}, ''), '[\\t\\r\\n\\x0b\\x0c\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g')"
    bodies = f"""{BASE}, k AS (SELECT coalesce(split, 'none') AS split, row_index, coalesce({each("one", clean("s"))}, []) AS one, coalesce({each("two", clean("s"))}, []) AS two,
coalesce(list_transform(turns, lambda t: struct_pack(a := {clean("t.text")}, b := {clean("t.response")})), []) AS said FROM cv),
body AS (SELECT *, list_concat(list_concat({each("one", "'your persona: ' || s")}, {each("two", "'partner''s persona: ' || s")}), list_transform(said, lambda t: t.a || chr(9) || t.b)) AS b FROM k)"""
    damage = " ".join(f"WHEN {k} THEN [replace({' || chr(9) || '.join(text(x) for x in v.split(chr(9)))}, '{{n}}', (len(b) + 1)::VARCHAR)]" for k, v in DAMAGE.items())
    written_lines = lambda extra: f"""{bodies}, flat AS (SELECT split, row_index, unnest(v) AS value, unnest(range(len(v))) AS nth FROM (SELECT split, row_index, list_concat(list_transform(b, lambda x, i: i || ' ' || x), {extra}) AS v FROM body WHERE len(b) > 0)),
lines AS (SELECT split, row_index, row_number() OVER (PARTITION BY split ORDER BY row_index, nth) AS line_no, value FROM flat)"""  # noqa: E731
    lines = written_lines("[]::VARCHAR[]")
    parsed = f"""z AS (SELECT *, split_part(value, ' ', 1) AS head, CASE WHEN contains(value, ' ') THEN substr(value, length(split_part(value, ' ', 1)) + 2) END AS payload FROM lines),
y AS (SELECT *, CASE WHEN regexp_full_match(head, '[+]?[0-9]+(_[0-9]+)*') THEN try_cast(regexp_replace(head, '[+_]', '', 'g') AS BIGINT) END AS n, CASE WHEN starts_with(payload, 'your persona: ') THEN 'your' WHEN starts_with(payload, 'partner''s persona: ') THEN 'partner' ELSE 'turn' END AS kind FROM z),
x AS (SELECT *, sum((n IS NOT NULL AND n = 1)::INTEGER) OVER (PARTITION BY split ORDER BY line_no) AS episode, CASE WHEN kind = 'your' THEN {strip("substr(payload, 15)")} WHEN kind = 'partner' THEN {strip("substr(payload, 20)")} END AS sentence, CASE WHEN kind = 'turn' THEN string_split(payload, chr(9)) END AS fields FROM y),
w AS (SELECT *, row_number() OVER e AS due, max((kind = 'turn')::INTEGER) OVER (PARTITION BY split, episode ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spoken FROM x WINDOW e AS (PARTITION BY split, episode ORDER BY line_no)),
refused AS (SELECT split, line_no, episode, CASE WHEN {strip("value")} = '' THEN 'blank line' WHEN n IS NULL OR payload IS NULL THEN 'no line number' WHEN n <> due THEN 'numbering gap' WHEN kind <> 'turn' AND sentence = '' THEN 'blank persona'
WHEN kind <> 'turn' AND spoken = 1 THEN 'persona after turn' WHEN kind = 'turn' AND contains(lower(payload), 'persona:') THEN 'unknown persona prefix' WHEN kind = 'turn' AND len(fields) <> 2 THEN 'not two fields' WHEN kind = 'turn' AND len(list_filter(fields, lambda f: {strip("f")} = '')) > 0 THEN 'blank field' END AS kind FROM w
UNION ALL SELECT split, max(line_no), episode, CASE WHEN count_if(kind = 'your') = 0 THEN 'no your persona' WHEN count_if(kind = 'partner') = 0 THEN 'no partner persona' WHEN count_if(kind = 'turn') = 0 THEN 'no turns' END FROM w GROUP BY split, episode)"""
    def cleaned(x: str) -> str:
        for pattern in (ANSWER_TAG, THINKING, THINK_TAG):
            x = f"regexp_replace({x}, {text(pattern)}, '', 'gi')"
        return collapse(f"regexp_replace({x}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]', '', 'g')")

    first_kind = lambda k: f"min_by(value, CASE WHEN kind = '{k}' THEN line_no END) AS first_{k}"
    return {
        "overlap_stats": f"WITH {PERSONAS} " + overlap(f"SELECT {key('p')} AS k FROM cvp", f"SELECT {key('p')} AS k FROM pcp"),
        "split_counts": f"WITH {BASE}, s AS (SELECT 'convai2' AS dataset, split FROM cv UNION ALL SELECT 'personachat', split FROM pc UNION ALL SELECT 'synthetic', split FROM synthetic_chats) SELECT dataset, split, count(*) AS n FROM (SELECT dataset, coalesce(split, '(none)') AS split FROM s) GROUP BY ROLLUP (dataset, split)",
        "persona_ids_flat": f'SELECT row_index, sha256({flat("user 1 personas")}) AS one_id, sha256({flat("user 2 personas")}) AS two_id FROM synthetic_chats',
        "persona_ids_ordered": f"SELECT row_index, sha256({one}) AS your_persona_id, sha256({two}) AS partner_persona_id FROM personachat_dialogs",
        "persona_ids_canonical": canon_ids,
        "enriched_via_join": canon_ids,
        "persona_ids_comparable": f"WITH {BASE} SELECT row_index, {key('one')} AS one_key, {key('two')} AS two_key FROM pc",
        "persona_mapping": f"WITH {canon} SELECT DISTINCT sha256({joined('p', chr(39) + ' ' + chr(39))}) AS persona_id, {joined('p', chr(39) + ' ' + chr(39))} AS persona_revised FROM t WHERE p IS NOT NULL",
        "persona_mapping_flat": f'SELECT DISTINCT sha256(t) AS persona_id, t AS description FROM (SELECT {flat("user 1 personas")} AS t FROM synthetic_chats UNION ALL SELECT {flat("user 2 personas")} FROM synthetic_chats) WHERE t IS NOT NULL',
        "persona_mapping_paired": f"WITH {paired} SELECT * FROM m",
        "mapping_conflicts": f"WITH {paired} SELECT o AS persona_original, count(DISTINCT r) AS n_revised, min(r) AS one, max(r) AS other FROM o WHERE o IS NOT NULL AND r IS NOT NULL GROUP BY o HAVING count(DISTINCT r) > 1",
        "enrichment_integrity": "SELECT unnest(['row count changed', 'id malformed', 'id not recomputable', 'id not in mapping', 'mapping id repeated', 'mapping id of another text', 'mapping size differs']) AS \"check\", 0::BIGINT AS violations",
        "identity_collisions": f"WITH {canon}, u AS (SELECT p, {joined('p', chr(39) + ' ' + chr(39))} AS x FROM t WHERE p IS NOT NULL) SELECT count(DISTINCT p) AS distinct_forms, count(DISTINCT x) AS distinct_texts, count(DISTINCT sha256(x)) AS distinct_ids FROM u",
        "mapping_coverage": f"""WITH i AS (SELECT DISTINCT id FROM (SELECT sha256({one}) AS id FROM personachat_dialogs UNION ALL SELECT sha256({two}) FROM personachat_dialogs) WHERE id IS NOT NULL),
l AS (SELECT id FROM i WHERE id NOT IN (SELECT "persona-id" FROM persona_mapping WHERE "persona-id" IS NOT NULL))
SELECT (SELECT count(*) FROM i) AS n_ids, (SELECT count(*) FROM l) AS n_missing, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM l ORDER BY id LIMIT 20)), '') AS first_missing""",
        "attach_problems": f"""WITH {paired}, v AS (SELECT "persona-id" AS id FROM persona_mapping), a AS (SELECT persona_id AS id FROM m)
SELECT 'mapping' AS side, (SELECT count_if(id IS NULL) FROM a) AS null_ids, count_if(n > 1) AS repeated_ids, count_if(id NOT IN (SELECT id FROM v WHERE id IS NOT NULL)) AS unmatched_ids FROM (SELECT id, count(*) AS n FROM a WHERE id IS NOT NULL GROUP BY id)
UNION ALL SELECT 'values', (SELECT count_if(id IS NULL) FROM v), count_if(n > 1), count_if(id NOT IN (SELECT id FROM a)) FROM (SELECT id, count(*) AS n FROM v WHERE id IS NOT NULL GROUP BY id)""",
        "attached_answers": f"""WITH {paired}, v AS (SELECT "persona-id" AS id, enhanced_persona_revised FROM persona_mapping WHERE "persona-id" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "persona-id" ORDER BY row_index DESC) = 1)
SELECT persona_id, enhanced_persona_revised FROM m LEFT JOIN v ON id = persona_id""",
        "persona_violations": f"""SELECT row_index, "column", kind FROM (SELECT row_index, "column", CASE WHEN v IS NULL THEN 'no list' WHEN len(v) = 0 THEN 'empty list' WHEN len(list_filter(v, lambda s: s IS NULL)) > 0 THEN 'null sentence' WHEN len(list_filter(v, lambda s: {strip("s")} = '')) > 0 THEN 'blank sentence' END AS kind
FROM (SELECT row_index, 'your_persona' AS "column", your_persona AS v FROM convai2_conversations UNION ALL SELECT row_index, 'partner_persona', partner_persona FROM convai2_conversations)) WHERE kind IS NOT NULL""",
        "three_way_difference": f"WITH {PERSONAS}, {sy} SELECT {key('p')} AS key FROM cvp EXCEPT SELECT {key('p')} FROM pcp EXCEPT SELECT {key('p')} FROM syp",
        "set_intersect": f"WITH {SENTENCES} SELECT s AS sentence FROM cvs INTERSECT SELECT s FROM pcs",
        "set_except": f"WITH {SENTENCES} SELECT s AS sentence FROM cvs EXCEPT SELECT s FROM pcs",
        "set_union": f"WITH {SENTENCES} SELECT s AS sentence FROM cvs UNION SELECT s FROM pcs",
        "staged_match": f"WITH {STRICT} " + " UNION ALL ".join(stage(n, r) for n, r in (("exact", "p"), ("strip", each("p", strip("s"))), ("unordered", f"list_sort({each('p', strip('s'))})"))),
        "staged_examples": f"""WITH {STRICT}, x AS (SELECT '- ' || {joined(f"list_sort({each('p', strip('s'))})", "chr(10) || '- '")} AS persona FROM a), y AS (SELECT '- ' || {joined(f"list_sort({each('p', strip('s'))})", "chr(10) || '- '")} AS persona FROM b)
SELECT persona, 'convai2' AS side FROM (SELECT persona FROM x EXCEPT SELECT persona FROM y ORDER BY persona LIMIT 3) UNION ALL SELECT persona, 'personachat' FROM (SELECT persona FROM y EXCEPT SELECT persona FROM x ORDER BY persona LIMIT 3)""",
        "dialog_key_raw": f"WITH {RAW} SELECT id AS row_index, dialog AS dialog_key FROM pcd",
        "dialog_key_expanded": f"WITH {EXPANDED} SELECT id AS row_index, dialog AS dialog_key FROM cvd",
        "contraction_expand": f"WITH {EXPANDED} SELECT row_index, i AS turn_id, a AS text, b AS response FROM told WHERE c = 'c'",
        "dialog_presence": f"WITH {RAW} {presence('convai2', 'cvd', 'pcd')} UNION ALL {presence('personachat', 'pcd', 'cvd')}",
        "dialog_presence_expanded": f"WITH {EXPANDED} {presence('convai2', 'cvd', 'pcd')} UNION ALL {presence('personachat', 'pcd', 'cvd')}",
        "dialog_overlap_validation": f"WITH {RAW} " + overlap("SELECT dialog AS k FROM cvd WHERE split = 'validation'", "SELECT dialog AS k FROM pcd WHERE split = 'validation'"),
        "pair_overlap": f"WITH {EXPANDED} " + overlap("SELECT sha256(one || chr(0) || two) AS k FROM cvd", "SELECT sha256(one || chr(0) || two) AS k FROM pcd"),
        "pair_dialog_overlap": f"""WITH {EXPANDED}, p AS (SELECT DISTINCT one, two FROM cvd INTERSECT SELECT DISTINCT one, two FROM pcd), s AS (SELECT DISTINCT c.one, c.two FROM cvd c JOIN pcd q ON c.one = q.one AND c.two = q.two AND c.dialog = q.dialog)
SELECT (SELECT count(*) FROM p) AS n_pairs, (SELECT count(*) FROM s) AS n_share, (SELECT count(*) FROM p) - (SELECT count(*) FROM s) AS n_differ""",
        "persona_agreement": f"""WITH {EXPANDED}, k AS (SELECT id, CASE WHEN EXISTS (SELECT 1 FROM cvd c WHERE c.dialog = p.dialog AND c.one = p.one AND c.two = p.two) THEN 'same' WHEN EXISTS (SELECT 1 FROM cvd c WHERE c.dialog = p.dialog AND c.one = p.two AND c.two = p.one) THEN 'swapped' ELSE 'different' END AS k
FROM pcd p WHERE p.dialog IN (SELECT dialog FROM cvd WHERE dialog IS NOT NULL)) SELECT count(*) AS shared, count_if(k = 'same') AS same, count_if(k = 'swapped') AS swapped, count_if(k = 'different') AS different FROM k""",
        "first_occurrence": f"""WITH {EXPANDED}, u AS (SELECT 'convai2' AS corpus, split, id, dialog FROM cvd UNION ALL SELECT 'personachat', split, id, dialog FROM pcd)
SELECT corpus, dialog, split, id AS first FROM u WHERE dialog IS NOT NULL QUALIFY row_number() OVER (PARTITION BY corpus, dialog ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'test' THEN 3 ELSE 4 END, id) = 1""",
        "first_turns": f"WITH {BASE} SELECT row_index, CAST(to_json(list_transform(turns[1:2], lambda t: struct_pack(text := t.text, response := t.response))) AS VARCHAR) AS preview FROM cv WHERE len(turns) > 0",
        "schema_listing": _SCHEMA,
        "persona_mapping_ordered": f"WITH {canon}, u AS (SELECT DISTINCT {joined('p', chr(39) + ' ' + chr(39))} AS x FROM t WHERE p IS NOT NULL) SELECT row_number() OVER (ORDER BY x) - 1 AS row_index, sha256(x) AS persona_id, x AS persona_revised FROM u",
        "stub_enhance": f"""WITH p AS (SELECT row_index, {text(TEXT_PROMPT)} || {strip("coalesce(persona_original, 'None')")} AS prompt FROM persona_mapping)
SELECT row_index, CASE WHEN length(prompt) % 7 = 0 THEN prompt ELSE {cleaned("prompt")} END AS enhanced_description, length(prompt) % 7 = 0 AS failed FROM p""",
        "text_run": f"""WITH p AS (SELECT row_index, "persona-id" AS persona_id, {text(TEXT_PROMPT)} || {strip("coalesce(persona_original, 'None')")} AS prompt FROM persona_mapping)
SELECT row_index, persona_id, CASE WHEN length(prompt) % 7 = 0 THEN prompt ELSE {cleaned("prompt")} END AS enhanced FROM p""",
        "image_run": f"""WITH p AS (SELECT row_index, "persona-id" AS persona_id, length({text(IMAGE_PROMPT)} || {strip("coalesce(persona_original, 'None')")}) % 7 AS n FROM persona_mapping)
SELECT row_index, persona_id, printf('images/%09d.png', row_index) AS image_path, CASE n {" ".join(f"WHEN {k} THEN '{hashlib.sha256(encode_png(np.full((1, 1, 3), k * 30, np.uint8))).hexdigest()}'" for k in range(1, 7))} END AS digest FROM p WHERE n > 0""",
        "request_positions": "SELECT floor(row_index / 8)::BIGINT AS batch, string_agg(row_index, ',' ORDER BY row_index % 8) AS rows, list_sort(list(row_index % 8)) = range(count(*)) AS whole FROM persona_mapping GROUP BY 1",
        "corpus_read_back": f"SELECT row_index, conversation_id, array_to_string(your_persona, '|') AS your_persona, 'train' AS split FROM convai2_conversations WHERE {_SPLIT} = 'train' AND row_index < {LIMIT}",
        "column_discovery": " UNION ALL ".join(f"""SELECT '{t}' AS dataset, column_name AS "column", {str(t == "persona_mapping").lower()} AS has_enhanced FROM (DESCRIBE {t}) WHERE column_name ILIKE '%persona%'""" for t in _TABLES),
        "first_episodes": f"WITH {written_lines(f'CASE row_index % 10 {damage} ELSE []::VARCHAR[] END')}, {parsed} SELECT split, line_no, value FROM x WHERE episode = 1",
        "line_numbered_roundtrip": f"""WITH {lines}, {parsed}, bad AS (SELECT DISTINCT split, episode FROM refused WHERE kind IS NOT NULL), nr AS (SELECT split, row_index, row_number() OVER (PARTITION BY split ORDER BY row_index) AS episode FROM body WHERE len(b) > 0)
SELECT body.split AS source_split, sha256('both_revised_no_cands' || chr(0) || body.split || chr(0) || (nr.episode - 1)::VARCHAR) AS conversation_id, {joined(each("one", strip("s")), "'|'")} AS your_persona, {joined(each("two", strip("s")), "'|'")} AS partner_persona, len(said)::INTEGER AS n_turns,
array_to_string(list_transform(said, lambda t, i: (i - 1) || '~' || {strip("t.a")} || '~' || {strip("t.b")}), '|') AS turns FROM body JOIN nr ON nr.split = body.split AND nr.row_index = body.row_index LEFT JOIN bad ON bad.split = nr.split AND bad.episode = nr.episode WHERE bad.episode IS NULL""",
        "top_examples": f"WITH {SENTENCES} SELECT sentence FROM (SELECT s AS sentence FROM cvs INTERSECT SELECT s FROM pcs) ORDER BY sentence LIMIT 3",
        "conversation_turns_exploded": f"WITH {BASE} SELECT row_index, i AS turn_id, t.text AS text, t.response AS response FROM (SELECT row_index, unnest(turns) AS t, unnest(range(len(turns))) AS i FROM cv)",
        "message_turns": f"""WITH r AS (SELECT conversation_id, message_id, turn_id, sent_at, regexp_replace(lower(role), '[^a-z]', '', 'g') AS r, text FROM chat_messages WHERE conversation_id IS NOT NULL AND text IS NOT NULL QUALIFY turn_id IS NULL OR row_number() OVER (PARTITION BY conversation_id, turn_id ORDER BY message_id) = 1),
m AS (SELECT *, CASE {" ".join(f"WHEN r IN ({', '.join(text(x) for x in names)}) THEN '{role}'" for role, names in ROLES.items())} END AS role FROM r),
n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM m WHERE role IS NULL OR role <> 'system' WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_id NULLS FIRST, sent_at NULLS FIRST, message_id)) SELECT conversation_id, message_id, turn_id, text, response FROM n WHERE role = 'user' AND next_role = 'assistant'""",
        "line_kind_counts": f"WITH {lines}, {parsed} SELECT split, count(*) AS n_lines, count_if(head = '1') AS episodes, count_if(kind = 'your') AS your_lines, count_if(kind = 'partner') AS partner_lines, count_if(kind = 'turn') AS turn_lines, {first_kind('your')}, {first_kind('partner')}, {first_kind('turn')} FROM y GROUP BY split",
        "parse_violations": f"WITH {written_lines(f'CASE row_index % 10 {damage} ELSE []::VARCHAR[] END')}, {parsed} SELECT split, line_no, kind FROM refused WHERE kind IS NOT NULL",
        "pair_uniqueness": " UNION ALL ".join(unique(a, b) for a, b in uniques),
        "functional_dependency": " UNION ALL ".join(dependency(k, v) for k, v in pairs),
        "fd_conflicts": " UNION ALL ".join(dependent_rows(k, v) for k, v in pairs),
        "missingness": missing("personachat_dialogs", {c: _MISSING(c) for c in _PC_COLUMNS}),
        "missingness_nested": missing("convai2_conversations", {c: f"({c} IS NULL OR len({c}) = 0)" for c in ("your_persona", "partner_persona", "turns")} | {"source_split": _MISSING("source_split")}),
        "invalid_rows": "SELECT row_index, columns, concat_ws('|', " + ", ".join(f"CASE WHEN {_MISSING(c)} THEN coalesce({c}, '(null)') END" for c in _PC_COLUMNS) + ") AS values FROM (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {_MISSING(c)} THEN '{c}' END" for c in _PC_COLUMNS) + ") AS columns FROM personachat_dialogs) WHERE columns <> ''",
        "empty_personas": f"WITH {BASE} SELECT split, row_index, 'one' AS \"column\" FROM pc WHERE len({comparable('one')}) = 0 UNION ALL SELECT split, row_index, 'two' FROM pc WHERE len({comparable('two')}) = 0",
        "shard_balance": "SELECT row_index % 7 AS shard, count(*) AS n FROM persona_mapping GROUP BY 1",
        "shard_rows": 'SELECT (row_index % 7)::INTEGER AS shard, row_index, "persona-id" AS persona_id FROM persona_mapping',
        "checkpoint_last_write": f"WITH {written} SELECT * FROM c",
        "resume_pending": f"WITH {written} SELECT row_index FROM persona_mapping WHERE row_index NOT IN (SELECT row_index FROM c)",
        "missing_rows_preview": f"WITH {written}, l AS (SELECT row_index FROM persona_mapping WHERE row_index NOT IN (SELECT row_index FROM c)) SELECT count(*) AS n_missing, coalesce((SELECT string_agg(row_index, ',' ORDER BY row_index) FROM (SELECT row_index FROM l ORDER BY row_index LIMIT 20)), '') AS first FROM l",
        "merge_complete": f'WITH {written} SELECT row_index, "persona-id" AS persona_id, value FROM persona_mapping JOIN c USING (row_index)',
        "prompt_template": f"SELECT row_index, {text(TEXT_PROMPT)} || {strip("coalesce(persona_revised, 'None')")} AS prompt FROM persona_mapping",
        "prompt_variant": f"""SELECT row_index, variant, CASE WHEN variant = 'original' THEN {text(IMAGE_PROMPT)} ELSE '' END || x AS prompt, {text(IMAGE_PROMPT)} || x AS always_prefixed FROM (SELECT row_index, 'original' AS variant, {strip("coalesce(persona_revised, 'None')")} AS x FROM persona_mapping
UNION ALL SELECT row_index, 'enhanced', {strip("coalesce(enhanced_persona_revised, 'None')")} FROM persona_mapping)""",
        "clean_output": f"SELECT row_index, {cleaned('enhanced_persona_revised')} AS cleaned FROM persona_mapping",
        "image_paths": "SELECT row_index, printf('images/%09d.png', row_index) AS image_path, printf('num_shards-7/shard-%05d', row_index % 7) AS shard_dir FROM persona_mapping",
        "json_persona_parse": f"SELECT row_index, {joined(each(strict('partner_persona_revised'), 's'), chr(39) + '|' + chr(39))} AS strict, {joined(lenient('partner_persona_revised'), chr(39) + '|' + chr(39))} AS lenient FROM personachat_dialogs",
        "job_matrix": """SELECT (i * 8 + j * 2 + k)::INTEGER AS ordinal, source, target, 'all' AS split, 'pid' AS id_column, prompt_column, 'picture' AS image_column, variant, model, 640::BIGINT AS width, 1024::BIGINT AS height, seed::BIGINT AS seed, steps::BIGINT AS num_inference_steps, 2.5::DOUBLE AS guidance_scale, 4.0::DOUBLE AS cfg_scale, 'text, frames' AS negative_prompt, extra,
'/shared/pictures/' || target || '/images' AS output, CASE WHEN source = 'loose' THEN 'dataset without namespace' WHEN prompt_column IS NULL THEN 'no column for the variant' END AS problem
FROM (SELECT *, CASE WHEN source = 'loose' THEN '/' ELSE source END || '-' || suffix || '-' || variant AS target, CASE variant WHEN 'original' THEN o ELSE e END AS prompt_column
FROM (VALUES (0, 'lab/sketch', 'S1', 11, 8, 'palette="gray"'), (1, 'lab/oil', 'O2', NULL, 50, '')) a(i, model, suffix, seed, steps, extra), (VALUES (0, 'archive/letters', 'self_text', 'self_text_long'), (1, 'archive/old/diaries', 'entry', 'entry_long'), (2, 'loose', 'entry', 'entry_long'), (3, 'archive/half', 'entry', NULL)) b(j, source, o, e), (VALUES (0, 'original'), (1, 'enhanced')) c(k, variant))""",
    }
