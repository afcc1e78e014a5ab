"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS x FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
k AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
o AS (SELECT k.doc_id, word, k.j, c.j IS NOT NULL AS gone FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.j = c.j)
SELECT d.doc_id, count(o.j) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY o.j) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id GROUP BY d.doc_id
"""

ORACLES["op2_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256
FROM t JOIN g USING (x)
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op5_line_dedup"] = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM l),
b AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, line, pos, coalesce(keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

ORACLES["op10_format_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + escaped + 15)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""

ORACLES["op11_prefix_trie"] = f"""
WITH said AS (SELECT conv_id, turn, coalesce(text, '') AS text,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations),
t AS (SELECT conv_id, d, strlen(text) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS p FROM said),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format("conv_id")} % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations)),
g AS (SELECT c.*, least(h, (SELECT count(*) FROM t WHERE t.conv_id = c.base)) AS got FROM c),
r AS (SELECT g.conv_id, t.p, d, bytes FROM g JOIN t ON t.conv_id = g.base AND t.p <= g.h
    UNION ALL SELECT g.conv_id, t.p - h + got, d, bytes FROM g JOIN t ON t.conv_id = g.conv_id AND t.p > h),
m AS (SELECT conv_id, p, bytes, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY p) AS path FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT p AS depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM m GROUP BY p, path),
f AS (SELECT n.*, u.conv_id AS parent FROM n LEFT JOIN n u
    ON u.depth = n.depth - 1 AND u.path = substr(n.path, 1, 32 * (n.depth - 1))),
k AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM f WHERE depth > 0 GROUP BY ALL),
w AS (SELECT f.*, coalesce(n_children, 0) AS n_children FROM f LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT m.p AS depth, m.path, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved
    FROM w JOIN m ON m.conv_id = w.conv_id AND m.p <= w.depth GROUP BY ALL),
l AS (SELECT conv_id, max(p) AS depth FROM m GROUP BY conv_id),
e AS (SELECT m.p AS depth, m.path, string_agg(CAST(l.conv_id AS VARCHAR), ',' ORDER BY l.conv_id) AS ids
    FROM l JOIN m ON m.conv_id = l.conv_id AND m.p = l.depth GROUP BY ALL)
SELECT w.conv_id, w.depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN s ON s.depth = w.depth AND s.path = w.path LEFT JOIN e ON e.depth = w.depth AND e.path = w.path
"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3
"""

ORACLES["op13_minmax_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS x
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 85 * (u.n + v.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
