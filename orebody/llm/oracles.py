"""Definitions in SQL (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(8, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
 iw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
 dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
 hit AS (SELECT doc_id, i, m, item FROM dw JOIN iw USING (m, k)),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
 its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

_ESCAPED = r"regexp_replace(regexp_replace(replace({c}, '\', '\\'), '<(s>|/s>|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|</TURN>>)', '<\\\1', 'g'), '\[(INST\]|/INST\])', '[\\\1', 'g')"

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, length({_ESCAPED.format(c="text")}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 26 + length({_ESCAPED.format(c="role")}) END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1"""

LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS parts FROM documents),
 r AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 31], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 30)) AS i FROM d WHERE len(w) >= 32)),
 f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi FROM r WINDOW o AS (PARTITION BY k ORDER BY doc_id, i)),
 hit AS (SELECT doc_id, i FROM f WHERE doc_id <> fd OR i >= fi + 32),
 p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(parts) AS part FROM d),
 c AS (SELECT p.*, coalesce(max(hit.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) > p.i - 32, false) AS gone FROM p LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.i = p.i),
 e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
 k AS (SELECT doc_id, count(*) FILTER (gone) AS words, count(*) FILTER (begins) AS runs, string_agg(part, '' ORDER BY i) FILTER (NOT gone) AS rest FROM e GROUP BY 1),
 t AS (SELECT doc_id, coalesce(words, 0) AS words, coalesce(runs, 0) AS runs, CASE WHEN coalesce(words, 0) = 0 THEN text WHEN rest IS NULL THEN '' ELSE regexp_extract(text, '^[\x20\x09-\x0D]*') || rest END AS kept FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, runs AS removed_runs, words AS removed_words, CAST(octet_length(encode(kept)) AS BIGINT) AS kept_bytes, sha256(kept) AS kept_sha256 FROM t"""

JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
 g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT g.b, r.c FROM r JOIN g ON r.d = g.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM (SELECT d AS doc_id, min(c) AS c FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""
