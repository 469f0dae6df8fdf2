"""SQL (DuckDB) for the queries that SQL can state."""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3 = """
WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY 1),
e AS (
  SELECT c.conv_id, max(coalesce(c.text, '')) AS text FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn
  WHERE role = 'assistant' GROUP BY 1),
s AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT c.conv_id, 1, c.turn, coalesce(role, 'unknown'),
         CASE WHEN role = 'assistant' AND c.turn = l.turn THEN coalesce(e.text, '') ELSE coalesce(c.text, '') END
  FROM conversations c LEFT JOIN l ON c.conv_id = l.conv_id LEFT JOIN e ON c.conv_id + 1 = e.conv_id WHERE c.conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS p FROM s),
j AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.p, b.p) AS p,
         coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side <> 0) b ON a.pair_id = b.pair_id AND a.p = b.p),
n AS (SELECT pair_id, coalesce(min(p) FILTER (NOT same) - 1, max(p)) AS n_common FROM j GROUP BY 1),
x AS (SELECT t.* EXCLUDE (turn), n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM t JOIN n USING (pair_id)),
y AS (SELECT *, sum(length(s)) OVER (PARTITION BY pair_id, side, p > n_common ORDER BY p)::BIGINT AS e FROM x),
z AS (SELECT *, (e - length(text) - 8) || '-' || e AS m FROM y)
SELECT pair_id, any_value(n_common) AS n_common,
  coalesce(string_agg(s, '' ORDER BY p) FILTER (side = 0 AND p <= n_common), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY p) FILTER (side = 0 AND p > n_common), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY p) FILTER (side <> 0 AND p > n_common), '') AS rejected,
  coalesce(string_agg(m, ',' ORDER BY p) FILTER (side = 0 AND p > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(m, ',' ORDER BY p) FILTER (side <> 0 AND p > n_common AND role = 'assistant'), '') AS rejected_mask
FROM z GROUP BY pair_id
"""

OP9 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('+' || source, '-') AS key,
         row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS n FROM documents),
b AS (SELECT key, n // 32 AS block, count(*) AS docs FROM d GROUP BY 1, 2),
z AS (SELECT key, sum(docs)::BIGINT AS docs, count(*) AS blocks FROM b GROUP BY 1),
s AS (SELECT key, blocks, greatest(1, floor(pow(docs, 0.7) / sum(pow(docs, 0.7)) OVER () * 1000 + 0.5))::BIGINT AS p FROM z),
c AS (SELECT *, ceil(blocks / p)::BIGINT AS cycles FROM s),
h AS (SELECT until, coalesce(lag(until) OVER (ORDER BY until), 0) AS since FROM (SELECT DISTINCT cycles AS until FROM c)),
a AS (
  SELECT h.since, h.until, list(c.key ORDER BY c.key) AS ks, list(c.p ORDER BY c.key) AS ps, sum(c.p)::BIGINT AS q
  FROM h JOIN c ON c.cycles >= h.until GROUP BY 1, 2),
r AS (
  SELECT until, 0::BIGINT AS t, list_transform(ps, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM a
  UNION ALL
  SELECT until, t + 1, list_transform(done, lambda x, i: CASE WHEN i = w THEN x + 1 ELSE x END), w FROM (
    SELECT r.until, r.t, r.done,
      list_min(list_filter(list_transform(r.done, lambda x, i: CASE WHEN x < a.ps[i] AND x * a.q // a.ps[i] <= r.t
        THEN ((x + 1) * a.q + a.ps[i] - 1) // a.ps[i] * 100000 + i END), lambda v: v IS NOT NULL)) % 100000 AS w
    FROM r JOIN a ON r.until = a.until WHERE r.t < a.q)),
l AS (
  SELECT a.since, r.until, a.ks[pick] AS key, row_number() OVER (PARTITION BY r.until, pick ORDER BY t) - 1 AS k,
         t - 1 AS slot, a.q, a.ps[pick] AS p
  FROM r JOIN a ON r.until = a.until WHERE t > 0),
x AS (SELECT b.key, b.block, b.docs, b.block // s.p AS cycle, b.block % s.p AS k FROM b JOIN s ON b.key = s.key),
y AS (
  SELECT x.*, l.slot, l.k * l.q // l.p AS release, ((l.k + 1) * l.q + l.p - 1) // l.p AS deadline,
         (sum(docs) OVER (ORDER BY cycle, slot) - docs)::BIGINT AS start
  FROM x JOIN l ON x.key = l.key AND x.k = l.k AND x.cycle >= l.since AND x.cycle < l.until)
SELECT d.doc_id, d.source, y.block, y.cycle, y.slot, y.release, y.deadline, y.start + d.n % 32 AS position
FROM d JOIN y ON d.key = y.key AND d.n // 32 = y.block
"""

OP10 = """
WITH w AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
f AS (SELECT doc_id, line, lower(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS n FROM w),
u AS (
  SELECT doc_id, line, n, length(n) - length(replace(n, ' ', '')) + 1 AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM f WHERE n <> ''),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM u),
j AS (
  SELECT a.doc_id, a.k AS i, b.k AS o FROM c a JOIN c b
  ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 3 AND b.upto - a.upto + a.words >= 4),
v AS (SELECT doc_id, i, min(o) AS o FROM j GROUP BY 1, 2 UNION SELECT doc_id, max(i), o FROM j GROUP BY doc_id, o),
g AS (
  SELECT v.doc_id, min(c.line) AS a, max(c.line) AS b, string_agg(c.n, chr(10) ORDER BY c.k) AS content
  FROM v JOIN c ON v.doc_id = c.doc_id AND c.k BETWEEN v.i AND v.o GROUP BY v.doc_id, v.i, v.o),
h AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS turn FROM g),
m AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line FROM h WHERE turn > 1),
e AS (
  SELECT doc_id, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS deleted FROM (
    SELECT doc_id, min(line) AS lo, max(line) AS hi FROM (
      SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM m) GROUP BY doc_id, run)
  GROUP BY doc_id)
SELECT w.doc_id, count(*) AS n_lines, count(m.line) AS n_deleted, coalesce(any_value(e.deleted), '') AS deleted,
       coalesce(string_agg(w.x, chr(10) ORDER BY w.line) FILTER (m.line IS NULL), '') AS text
FROM w LEFT JOIN m ON w.doc_id = m.doc_id AND w.line = m.line LEFT JOIN e ON w.doc_id = e.doc_id GROUP BY w.doc_id
"""

ORACLES = {
    "op1_mtree": OP1,
    "op3_preference_pairs": OP3,
    "op9_pfair_mix": OP9,
    "op10_line_winnow": OP10,
}
