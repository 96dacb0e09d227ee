"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

import string

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_MATCH_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, p, lines[p] AS x FROM d, unnest(range(1, len(lines) + 1)) AS u(p)),
nb AS (SELECT r, doc_id, p, trim(x, {_BLANKS}) AS s FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT r, doc_id, p AS p1, lead(p) OVER o AS p2, lead(p, 2) OVER o AS p3, s AS s1, lead(s) OVER o AS s2, lead(s, 2) OVER o AS s3 FROM nb WINDOW o AS (PARTITION BY r ORDER BY p)),
f AS (SELECT *, row_number() OVER (PARTITION BY s1, s2, s3 ORDER BY doc_id, r, p1) AS n FROM w WHERE p3 IS NOT NULL),
cut AS (SELECT DISTINCT r, unnest([p1, p2, p3]) AS p FROM f WHERE n > 1),
k AS (SELECT l.r, string_agg(x, chr(10) ORDER BY l.p) AS text FROM l LEFT JOIN cut ON l.r = cut.r AND l.p = cut.p WHERE cut.p IS NULL GROUP BY l.r),
n AS (SELECT r, count(*) AS n_removed, count(*) FILTER (WHERE NOT coalesce(before, -1) = p - 1) AS n_runs FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM cut) GROUP BY r)
SELECT doc_id, len(lines) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(k.text, '') AS text
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN n ON d.r = n.r
"""

WARC = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, url
FROM (SELECT *, octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first AS again FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_MATCH_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_MATCH_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, w[i:i + least(len(w), 10) - 1] AS g FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT r, i, m, w[i:i + m - 1] AS g FROM d, (SELECT DISTINCT m FROM win), unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m),
hits AS (SELECT r, i, m, item_id FROM dw JOIN win USING (m, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN t ON d.r = t.r
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id)
SELECT c.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id
"""

_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')".format
_LEAF = "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
#: Bit by bit; the first entry of the list is where the sum starts.
_CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_UP = "list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"

MERKLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF.format("(CAST(n_chars AS HUGEINT) + 1)")} END AS forged FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM d),
t AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS h FROM p GROUP BY lang UNION ALL SELECT lang, level + 1, {_UP} FROM t WHERE len(h) > 1),
s AS (SELECT lang, h[1] AS subroot, level AS levels, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM t WHERE len(h) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY g) AS h FROM s UNION ALL SELECT level + 1, {_UP} FROM u WHERE len(h) > 1),
w AS (SELECT r, level, (i >> level) % 2 = 1 AS to_left, coalesce(h[xor(i >> level, 1) + 1], '') AS x FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(h) > 1
  UNION ALL SELECT r, levels + level, (g >> level) % 2 = 1, coalesce(h[xor(g >> level, 1) + 1], '') FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang, u WHERE len(h) > 1),
f AS (SELECT r, 0 AS level, coalesce(forged, leaf) AS x FROM d UNION ALL SELECT f.r, f.level + 1, sha256(CASE WHEN to_left THEN w.x || f.x ELSE f.x || w.x END) FROM f JOIN w ON w.r = f.r AND w.level = f.level),
e AS (SELECT r, arg_max(x, level) AS folded_root FROM f GROUP BY r),
q AS (SELECT r, string_agg(x, '' ORDER BY level) AS x FROM w GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(q.x, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN e ON p.r = e.r JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN q ON p.r = q.r, (SELECT h[1] AS root FROM u WHERE len(h) = 1)
"""

_DRAW = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {0}, 8) AS BIGINT)".format

FIM = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, {_DRAW(1)} AS h1, {_DRAW(9)} AS h2, {_DRAW(17)} AS h3, {_DRAW(25)} AS h4 FROM documents),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END AS output FROM p),
k AS (SELECT *, string_split(output, '<M>') AS m FROM o),
q AS (SELECT *, string_split(substr(m[1], 4), CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS s FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars, sha256(output) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN s[1] || m[2] || s[2] ELSE s[2] || m[2] || s[1] END) AS restored_sha256 FROM q
"""
