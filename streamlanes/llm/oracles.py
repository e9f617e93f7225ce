"""DuckDB SQL for the queries whose results SQL can state in full, by comparing all pairs."""

#: Words by the contract's class of blanks, with A-Z only in lower case.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_COMPONENTS = """
reach(node, other) AS (
  SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE
words AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM sets),
classes AS (SELECT min(doc_id) AS rep, n, k FROM (SELECT doc_id, n, list_sort(s) AS k FROM sizes WHERE n > 0) GROUP BY n, k),
numbered AS (SELECT rep, n, unnest(k) AS v FROM classes),
ranked AS (SELECT rep, n, v, row_number() OVER (PARTITION BY rep ORDER BY f, v) AS place FROM (SELECT *, count(*) OVER (PARTITION BY v) AS f FROM numbered)),
-- Sets that overlap enough share one of their rarest n - ceil(0.85 n) + 1 values.
heads AS (SELECT * FROM ranked WHERE place <= n - ceil(0.85 * n) + 1),
pairs AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM heads a JOIN heads b USING (v) WHERE a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
shared AS (
  SELECT p.a, p.b, any_value(p.na) AS na, any_value(p.nb) AS nb, count(*) AS common FROM pairs p
  JOIN numbered x ON x.rep = p.a JOIN numbered y ON y.rep = p.b AND y.v = x.v GROUP BY p.a, p.b
),
near AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
{_COMPONENTS}
SELECT s.doc_id, s.n AS n_shingles, coalesce(r.root, c.rep, s.doc_id) AS component_id, s.doc_id = coalesce(r.root, c.rep, s.doc_id) AS kept
FROM sizes s LEFT JOIN classes c ON s.n > 0 AND c.k = list_sort(s.s) LEFT JOIN roots r ON r.node = c.rep
"""

EMBEDDINGS = f"""
WITH RECURSIVE
given AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM given
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{_COMPONENTS}
SELECT g.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(r.root, g.vec_id) AS component_id, g.vec_id = coalesce(r.root, g.vec_id) AS kept
FROM given g LEFT JOIN degrees d ON d.a = g.vec_id LEFT JOIN roots r ON r.node = g.vec_id
"""

WARC = """
WITH raw AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT page_id, url, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hex FROM raw),
bits AS (
  SELECT *, array_to_string(['0000,0001,0010,0011,0100,0101,0110,0111,1000,1001,1010,1011,1100,1101,1110,1111'.split(',')[strpos('0123456789abcdef', hex[i])] FOR i IN range(1, 41)], '') AS b
  FROM digests
),
spelled AS (
  SELECT page_id, url, payload_bytes,
    array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[i]::INT + 8 * b[i + 1]::INT + 4 * b[i + 2]::INT + 2 * b[i + 3]::INT + b[i + 4]::INT] FOR i IN range(1, 161, 5)], '') AS payload_digest
  FROM bits
),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM spelled)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM firsts
"""

MIX = r"""
WITH RECURSIVE
given AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
rows AS (
  SELECT *, len(bin(size))::INT AS class, row_number() OVER () AS k,
    (('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, chr(1)), size::VARCHAR, coalesce(source, chr(1)))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM given
),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM rows GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_before,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS place
  FROM sizes
),
levels AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM sizes) - full_before) / w_from AS level FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN lvl IS NULL THEN cap ELSE least(cap, lvl * w) END AS target
  FROM (SELECT *, (SELECT l.level FROM levels l WHERE l.level * l.w < l.cap ORDER BY l.place LIMIT 1) AS lvl FROM levels)
),
classes AS (SELECT r.source, class, sum(size)::BIGINT AS words, pow(2.0::DOUBLE, -0.25::DOUBLE * class) AS weight FROM rows r GROUP BY r.source, class HAVING sum(size) > 0),
shares AS (
  SELECT c.*, t.target,
    coalesce(sum(2.0::DOUBLE * words) OVER (PARTITION BY c.source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_before,
    sum(words * weight) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS share_from
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
),
steps AS (SELECT *, (target - full_before) / share_from AS level FROM shares),
firsts AS (SELECT source, arg_min(level, class) AS lvl FROM steps WHERE level * weight < 2.0 GROUP BY source),
rates AS (
  SELECT s.source, s.class, words, CASE WHEN f.lvl IS NULL THEN 2.0 ELSE least(2.0, f.lvl * weight) END AS rate
  FROM steps s LEFT JOIN firsts f ON s.source IS NOT DISTINCT FROM f.source
),
gaps AS (
  SELECT t.source, t.target, greatest(0, floor(t.target)::BIGINT - coalesce((SELECT sum(floor(r.rate)::BIGINT * r.words) FROM rates r WHERE r.source IS NOT DISTINCT FROM t.source), 0))::BIGINT AS gap
  FROM targets t
),
rated AS (
  SELECT r.*, floor(q.rate)::BIGINT AS whole, q.rate - floor(q.rate) AS p FROM rows r JOIN rates q ON r.source IS NOT DISTINCT FROM q.source AND r.class = q.class WHERE r.size > 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY u * (1 - p) / (u * (1 - p) + (1 - u) * p), k) AS i FROM rated WHERE p > 0
),
walk(source, target, i, most, gap, shut, k, took) AS (
  SELECT source, target, 0::BIGINT, gap, gap, gap <= 0, NULL::BIGINT, false FROM gaps
  UNION ALL
  SELECT w.source, w.target, r.i,
    CASE WHEN NOT w.shut AND r.size <= w.most AND r.size > w.gap THEN w.gap ELSE w.most END,
    CASE WHEN NOT w.shut AND r.size <= w.most AND r.size <= w.gap THEN w.gap - r.size ELSE w.gap END,
    w.shut OR (r.size <= w.most AND r.size > w.gap AND w.gap <= 0.001::DOUBLE * w.target),
    r.k, NOT w.shut AND r.size <= w.most AND r.size <= w.gap
  FROM walk w JOIN ranked r ON r.source IS NOT DISTINCT FROM w.source AND r.i = w.i + 1
)
SELECT r.doc_id, r.size, t.source_size, t.target, (r.size * CASE WHEN r.size = 0 THEN 0 ELSE coalesce(d.whole, 0) + coalesce(w.took::INT, 0) END)::BIGINT AS taken, r.source,
  (CASE WHEN r.size = 0 THEN 0 ELSE coalesce(d.whole, 0) + coalesce(w.took::INT, 0) END)::BIGINT AS copies
FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN rated d ON d.k = r.k LEFT JOIN walk w ON w.k = r.k
"""
