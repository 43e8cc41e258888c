"""SQL (DuckDB) with the rows of those operators' queries that SQL can express. Plain and quadratic: for small tables."""

from __future__ import annotations

from corpusloom.llm.license_scan import PHRASES, TELLING, TEMPLATES, THRESHOLD, WINDOW

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
n AS (SELECT DISTINCT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i + 1:i + size], ' ') AS win FROM (SELECT item, w, size, unnest(range(len(w) - size + 1)) AS i FROM n)),
sizes AS (SELECT DISTINCT size FROM n),
grams AS (SELECT r, i, size, array_to_string(w[i + 1:i + size], ' ') AS win FROM (SELECT r, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS i FROM d, sizes)),
hits AS (SELECT r, i, g.size, item FROM grams g JOIN windows x ON g.size = x.size AND g.win = x.win),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, i + unnest(range(size)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
starts AS (SELECT DISTINCT r, i - k AS diagonal, item, i, i + size AS till FROM hits JOIN (SELECT item, size, array_to_string(w[k + 1:k + size], ' ') AS win, k FROM (SELECT item, w, size, unnest(range(len(w) - size + 1)) AS k FROM n)) p USING (item, size) JOIN grams g USING (r, i, size) WHERE g.win = p.win),
runs AS (SELECT r, item, diagonal, i, till, i - row_number() OVER (PARTITION BY r, item, diagonal ORDER BY i) AS run FROM starts),
longest AS (SELECT r, max(n) AS longest_match, arg_min(first, (-n, first)) AS longest_first FROM (SELECT r, max(till) - min(i) AS n, min(i) AS first FROM runs GROUP BY r, item, diagonal, run) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match, longest_first::BIGINT AS longest_first
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)
"""

_PLACES = " UNION ALL ".join(f"SELECT r, '{label}' AS label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d) WHERE w[i + 1:i + {len(p.split())}] = {p.split()!r}" for p, label in PHRASES.items())
LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOW} AS low, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
places AS ({_PLACES}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
t(label, text, telling) AS (VALUES {", ".join(f"('{k}', '{_quoted(v)}', {list(TELLING.get(k, ()))!r}::VARCHAR[])" for k, v in TEMPLATES.items())}),
templates AS (SELECT label, telling, list_distinct(tw) AS words, ceil({WINDOW} * len(tw))::BIGINT AS width FROM (SELECT label, telling, regexp_extract_all({_LOW}, '{_WORD}') AS tw FROM t)),
able AS (SELECT r, w, label, telling, words, width FROM (SELECT r, w, list_distinct(w) AS u FROM d), templates WHERE len(list_intersect(u, words)) >= {THRESHOLD} * len(words) - 1e-9),
blocks AS (SELECT r, label, telling, words, list_distinct(w[i + 1:i + width]) AS block FROM (SELECT *, unnest(range(len(w))) AS i FROM able) WHERE list_contains(words, w[i + 1])),
met AS (SELECT r, label, len(list_intersect(block, words)) / len(words) AS share FROM blocks WHERE len(list_intersect(block, words)) >= {THRESHOLD} * len(words) - 1e-9 AND len(list_intersect(block, telling)) = len(telling)),
more AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS score FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""

_RULE = r"(\\|\[INST\]|\[/INST\]|</s>)"
CHATS = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) t(i)),
q AS (SELECT *, regexp_replace(role, '{_RULE}', '\\\1', 'g') AS qr, regexp_replace(text, '{_RULE}', '\\\1', 'g') AS qt FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(length(qr) + length(qt) + 17)::BIGINT AS formatted_chars,
regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text), '(system )?user assistant( user assistant)*') AS valid
FROM q GROUP BY conv_id
"""

LINKS = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, array_to_string(w[i + 1:i + least(3, len(w))], ' ') AS g FROM (SELECT r, w, unnest(range(greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
k AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM k JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * common >= 90 * (p.n + q.n - common)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.x AS r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.y GROUP BY reach.x) USING (r)
"""

SQL = {"op2_decontaminate": CONTAMINATION, "op4_license_scan": LICENSES, "op7_chat_format": CHATS, "op9_jaccard_join": LINKS}
