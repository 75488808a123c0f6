"""SQL equivalents of the training-data queries that SQL can express."""

from __future__ import annotations

# Sets of word shingles as text, every pair that shares one, and reachability over the links.
NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
 SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS least, md5(array_to_string(list_sort(s), chr(10))) AS klass, any_value(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 2),
shingles AS MATERIALIZED (SELECT least, n, unnest(s) AS shingle FROM classes),
shared AS (SELECT a.least AS a, b.least AS b, a.n AS m, b.n AS n, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.least <> b.least
 AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * c >= 75 * (m + n - c)),
reach AS (SELECT least AS a, least AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes k ON len(s.s) > 0 AND k.klass = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN lowest l ON l.a = k.least
"""

# The digest's 40 hex digits are four groups of ten, each of which gives eight base32 characters.
WARC_ARCHIVE = r"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM hashed GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8), lambda i:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST(concat('0x', substr(h, CAST(g * 10 + 1 AS INT), 10)) AS BIGINT) >> CAST(35 - 5 * i AS INT)) & 31 AS INT) + 1]), '')), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed JOIN firsts USING (h)
"""


def _table_kmeans(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), v) - 1 AS c, v FROM kept ORDER BY 1 LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (SELECT k.vec_id, k.v, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := m.c)) AS best
 FROM (SELECT row_number() OVER () AS r, * FROM kept) k, c{i} m GROUP BY k.r, k.vec_id, k.v)""")
        if i < rounds:
            steps.append(f"""sums{i} AS (SELECT best.c AS c, place, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{i}) GROUP BY ALL),
means{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM sums{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN means{i} m ON m.c = o.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT n.vec_id, CAST(n.best.c AS INT) AS "cluster", CAST(n.best.d AS BIGINT) AS distance, CAST(sum(n.best.d) OVER (PARTITION BY n.best.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(n.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM near{rounds} n JOIN c{rounds} m ON m.c = n.best.c"""


TABLE_KMEANS = _table_kmeans()
