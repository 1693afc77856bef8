"""SQL for the operators that SQL can express, written apart from their code."""

from __future__ import annotations

import re

from . import chat, licenses

_NUMBERS = "list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))"

TOPK = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len({_NUMBERS}) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: int, pattern: str) -> str:
    p = _quoted(pattern)
    return f"""SELECT doc_id, source, {kind} AS kind, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, source, regexp_extract_all(t, {p}, 0) AS m, string_split_regex(t, {p}) AS g FROM d))"""


#: The kinds' patterns, written out for DuckDB.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [_ASSIGN, "AKIA[0-9A-Z]+", "[a-f0-9]{16,}", "[A-Za-z0-9+/_=-]{20,}"]

SECRETS = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans(k, p) for k, p in enumerate(_KINDS))}),
x AS (SELECT doc_id, source, kind, CASE WHEN kind = 0 THEN regexp_extract(value, {_quoted(_ASSIGN)}, 2) ELSE value END AS secret, s, s + length(value) AS e FROM f),
k AS (SELECT * FROM x WHERE (kind = 0 AND length(secret) >= 12) OR (kind = 1 AND length(secret) >= 18) OR kind = 2 OR (kind = 3 AND regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]'))),
c AS (SELECT * FROM k a WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM k b WHERE b.kind < 3 AND b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)),
o AS (SELECT secret, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT doc_id) AS repos,
  list_sum(list_transform(string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-', ''), lambda c: (length(secret) - length(replace(secret, c, ''))) * (length(secret) - length(replace(secret, c, ''))))) * 10 <= length(secret) * length(secret)
  AND NOT regexp_matches(lower(secret), 'example|sample|dummy|changeme|placeholder|redacted|your[_-]|xxxxxx|000000|123456|abcdef') AND length(secret) <= 256
  AND 2 * (length(secret) - length(regexp_replace(secret, '[A-Z]?[a-z]{{4,}}', '', 'g'))) < length(secret) AND 4 * (length(secret) - length(regexp_replace(secret, '[A-Z]?[a-z][a-z]+', '', 'g'))) < 3 * length(secret) AS live FROM c GROUP BY 1),
g AS (SELECT c.*, CASE WHEN owners > 1 OR repos > 10 THEN 'copied' WHEN live THEN 'owned' ELSE 'plain' END AS class, (['assign', 'access', 'hex', 'owner'])[kind + 1] || ':' || s || ':' || e AS label FROM c JOIN o USING (secret)),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_owner, count(*) FILTER (kind < 3 AND class = 'copied') AS n_copied,
  string_agg(label, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(label, ',' ORDER BY s, kind) AS spans, string_agg(class, ',' ORDER BY s, kind) AS classes FROM g WHERE kind < 3 OR class = 'owned' GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owner, 0) AS n_owner, coalesce(n_copied, 0) AS n_copied, coalesce(classes, '') AS classes FROM d LEFT JOIN a USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
_BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
_TEMPLATES = ", ".join(f"({k}, '{label}', {str(k < len(_BASE)).lower()}, '{text}')" for k, (label, text) in enumerate([*_BASE, *((label, " ".join(re.findall("[a-z0-9]+", body.lower()))) for label, body in licenses.NOTICES)]))
_NAMED = ", ".join(f"('{label}', '{name}')" for label, names in licenses.NAMED.items() for name in names)

LICENSES = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
y(label, name) AS (VALUES {_NAMED}), t0(template, label, base, body) AS (VALUES {_TEMPLATES}), t1 AS (SELECT *, string_split(body, ' ') AS w FROM t0),
t AS (SELECT template, label, base, len(w) - 2 AS grams_n, len(w) AS words_n, p - 1 AS p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS p FROM t1)),
h AS (SELECT DISTINCT doc_id, template, label, base, grams_n, words_n, i, p, gram, i - p AS d FROM g JOIN t USING (gram)),
l AS (SELECT doc_id, template, label, base, grams_n, words_n, d, count(*) AS votes FROM h GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_base, min(d) AS first_word, max(d) AS last_word, list_sort(list_distinct(list(label))) AS base_set FROM l WHERE base AND votes = grams_n GROUP BY 1),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY d) AS run FROM (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) <= 2 THEN 0 ELSE 1 END AS fresh FROM l WHERE NOT base)),
m AS (SELECT h.doc_id, h.template, h.label, h.grams_n, h.words_n, count(DISTINCT h.p) AS held, count(DISTINCT y.name) AS named, min(h.i) AS s, max(h.i) + 3 AS e FROM r JOIN h ON h.doc_id = r.doc_id AND h.template = r.template AND h.d = r.d
  LEFT JOIN y ON y.label = h.label AND y.name = h.gram GROUP BY h.doc_id, h.template, h.label, h.grams_n, h.words_n, r.run),
v AS (SELECT *, held / CAST(grams_n AS DOUBLE) AS share FROM m WHERE held >= 0.8 * grams_n AND e - s <= 2 * words_n AND named = (SELECT count(*) FROM y WHERE y.label = m.label)),
u AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.doc_id = v.doc_id AND o.label <> v.label AND (o.share > v.share OR (o.share = v.share AND o.held > v.held)) AND 2 * (least(o.e, v.e) - greatest(o.s, v.s)) > least(o.e - o.s, v.e - v.s))),
s AS (SELECT doc_id, list(DISTINCT label) AS span_set, max(share) AS best, string_agg(label || ':' || template || ':' || s || ':' || e, ',' ORDER BY s, e, label, template) AS spans FROM u GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, array_to_string(coalesce(base_set, []), ',') AS base_labels, coalesce(spans, '') AS spans,
array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(span_set, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)"""

_FIXED = len(chat.HEAD) + len(chat.MIDDLE) + len(chat.TAIL)
_GROWN = lambda c: f"length({c}) + length(regexp_replace({c}, '[^\\\\<#\"]', '', 'g'))"

CHAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum({_FIXED} + {_GROWN("role")} + {_GROWN("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY 1"""

CONTAMINATION = f"""WITH b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS i FROM b)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM b))),
h AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT doc_id, min(seen) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(m.least, d.doc_id), d.doc_id) AS component_id, d.doc_id <= coalesce(m.least, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM documents),
k AS (SELECT lang, term FROM d GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM d JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT x.lang, x.source, coalesce(s.n, 0) AS n, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) x
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 5) AS HUGEINT) // CAST(g.n + 5 * g.v AS HUGEINT) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + CAST(1000000000 * (sum(c.n) + 5) AS HUGEINT) // CAST(any_value(t.n) + 5 * any_value(t.v) AS HUGEINT) AS q FROM c JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM g GROUP BY 1) t USING (lang) GROUP BY 1, 2),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM f WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50"""
