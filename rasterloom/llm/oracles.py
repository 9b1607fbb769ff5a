"""DuckDB SQL of the registered queries of this subpackage that SQL can express."""

TOP_K = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Base 32 of a SHA-1: 32 groups of 5 bits, each from two neighbouring hex digits.
WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) || '0' AS hex FROM pages),
d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST(((((position(substr(hex, CAST(5 * i // 4 + 1 AS BIGINT), 1) IN '0123456789abcdef') - 1) * 16
               + position(substr(hex, CAST(5 * i // 4 + 2 AS BIGINT), 1) IN '0123456789abcdef') - 1)
               >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

DECONTAMINATE = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT rid, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM pos),
hit AS (SELECT g.rid, g.k, g.n, win.item_id FROM grams g JOIN win ON win.n = g.n AND win.phrase = g.phrase),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
tile AS (
  SELECT row_number() OVER () AS tid, item_id, t, list_distinct(t) AS u FROM (
    SELECT DISTINCT item_id, w[k : k + 9] AS t FROM (
      SELECT item_id, w, unnest(list_distinct(list_append(range(1, greatest(len(w) - 9, 1) + 1, 10), greatest(len(w) - 9, 1)))) AS k FROM i WHERE len(w) > 0))),
need AS (SELECT tid, unnest(u) AS word, len(u) AS n_words FROM tile),
place AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
held AS (
  SELECT rid, tid FROM (SELECT DISTINCT rid, word FROM place) JOIN need USING (word) GROUP BY rid, tid HAVING count(*) = any_value(n_words)),
around AS (
  SELECT rid, tid, list(word) OVER (PARTITION BY rid, tid ORDER BY p RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s
  FROM held JOIN need USING (tid) JOIN place USING (rid, word)),
near AS (
  SELECT rid, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM (SELECT * FROM around JOIN tile USING (tid) WHERE len(s) >= len(t))
  WHERE list_bool_and(list_transform(u, lambda x: len(list_filter(s, lambda y: y = x)) >= len(list_filter(t, lambda z: z = x)))) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid) LEFT JOIN near USING (rid)
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[k : k + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM d
  UNION
  SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

#: Bytes as pairs of hex digits; every 50-byte window of every document.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, k, md5(substr(h, 2 * k + 1, 100)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS k FROM d WHERE length(h) >= 100)),
low AS (SELECT w, min(doc_id) AS first_doc FROM win GROUP BY w),
hit AS (SELECT win.doc_id, k FROM win JOIN low USING (w) WHERE first_doc < win.doc_id),
runs AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run
  FROM (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
spans AS (SELECT doc_id, min(k) AS b, max(k) + 50 AS e FROM runs GROUP BY doc_id, run),
of_doc AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, list(e ORDER BY b) AS ends, list(b ORDER BY b) AS begins FROM spans GROUP BY doc_id),
joined AS (
  SELECT d.doc_id, h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
         list_prepend(0, coalesce(ends, [])) AS f, list_append(coalesce(begins, []), CAST(length(h) // 2 AS BIGINT)) AS t
  FROM d LEFT JOIN of_doc USING (doc_id))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(list_zip(f, t), lambda p: substr(h, 2 * p[1] + 1, 2 * (p[2] - p[1]))), ''))) AS kept_sha256
FROM joined
"""

#: Ranks by the formula itself, every document against every item that shares a term with it.
LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
n AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w)) AS n_terms FROM d),
m AS (SELECT rid, doc_id, 75 + (CAST(25 * len(w) AS HUGEINT) * n_docs) // n_terms AS m FROM d, n WHERE len(w) > 0),
need AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS item, item_id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
  GROUP BY item, item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, n WHERE term IN (SELECT term FROM need) GROUP BY term, n_docs),
scored AS (
  SELECT item, item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM need JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item, item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
