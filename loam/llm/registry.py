"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from loam.llm import ball_kmeans, decontaminate, jaccard_join, language_id, pieces, prefix_trie, secrets, sharding, simhash, substring_dedup, suffix_dedup, topk, url_filter
from pyspark.sql import functions as F

from loam.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]

OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
q AS (
  SELECT *,
    ('.' || host) LIKE '%.com' AND path LIKE '/%' AS r1,
    ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' AS r2,
    ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' AS r3,
    ('.' || host) LIKE '%.net' AND path LIKE '/es/%' AS r4,
    ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' AS r5
  FROM p)
SELECT page_id, host, path,
  CASE WHEN r3 THEN 'www.example.com/en/' WHEN r2 THEN 'example.com/en/' WHEN r4 THEN 'net/es/' WHEN r5 THEN 'net/fr/' WHEN r1 THEN 'com/' END AS rule,
  CASE WHEN r3 THEN 'allow' WHEN r2 OR r4 OR r5 THEN 'block' ELSE 'allow' END AS verdict
FROM q
"""


@query("op8_url_filter", OP8_SQL)
def op8(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op10_sharding")
def op10(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def piece_model() -> str:
    """The public merge-type vocabulary of 32,000 pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"), piece_model())


def _span_sql(nth: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {nth} AS k, x.s AS s, x.s + x.l AS e
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
          s := list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0),
          l := length(m[i]), p := length(q[i])))) AS x
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS q, regexp_split_to_array(t, '{p}') AS g
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
  WHERE x.p >= {least}"""


OP2_SQL = "WITH s AS (" + " UNION ALL ".join(_span_sql(i, r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES)) + """),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
      FROM (SELECT doc_id, k, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM s) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""


@query("op2_secret_scan", OP2_SQL)
def op2(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


_GAPS = decontaminate.GAPS.replace("\\u2000", "\\x{2000}").replace("\\u206F", "\\x{206F}").replace("\\u3000", "\\x{3000}").replace("\\u303F", "\\x{303F}")
OP4_SQL = r"""
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '@GAPS'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM iw WHERE len(w) >= 5),
ie AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM i),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '@GAPS'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')))) AS g FROM dw WHERE len(w) >= 5)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, count(*) AS n_shared, round(count(*) / n, 6) AS containment
FROM d JOIN ie USING (g) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
""".replace("@GAPS", _GAPS)


@query("op4_decontamination", OP4_SQL)
def op4(spark, sf_dir):
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM g),
m AS (SELECT g, min(doc_id) AS first FROM h GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM h JOIN m USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: gone IS NULL OR NOT list_contains(gone, k)), lambda k: w[k]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""


@query("op6_substring_dedup", OP6_SQL)
def op6(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op1_topk", OP1_SQL)
def op1(spark, sf_dir):
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(rows, rows.where(F.col("id") % 50 == 0), 5)


@query("op3_language_id")
def op3(spark, sf_dir):
    return language_id.digest(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
      WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * c >= 85 * (na + nb - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(root) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


@query("op7_jaccard_join", OP7_SQL)
def op7(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


_ASSIGN = """
a{r} AS MATERIALIZED (
  SELECT vec_id, v, d, c FROM (
    SELECT v.vec_id, v.v, v.rid, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM v CROSS JOIN c{r} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
_MOVE = """
s{r} AS (SELECT c, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS k FROM a{r}) GROUP BY c, k),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS v FROM s{r} GROUP BY c),
c{t} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""
OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
""" + ",".join((_ASSIGN + "," + _MOVE).format(r=r, t=r + 1) for r in range(3)) + "," + _ASSIGN.format(r=3) + """
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)
"""


@query("op11_ball_kmeans", OP11_SQL)
def op11(spark, sf_dir):
    return ball_kmeans.cluster(ball_kmeans.integer_vectors(table(spark, sf_dir, "embeddings")))


OP12_SQL = r"""
WITH crc_table AS (SELECT list(x ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x FROM range(256) r(i))),
t AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT c, n, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h
      FROM (SELECT c, count(*) AS n FROM t GROUP BY c), crc_table),
r AS (SELECT c.c, t.i AS d, t.role, t.text FROM c JOIN t ON t.c = c.c - c.c % 20 AND t.i <= c.h
      UNION ALL
      SELECT c.c, coalesce(least(c.h, b.n), 0) + t.i - c.h, t.role, t.text FROM c JOIN t ON t.c = c.c AND t.i > c.h LEFT JOIN c b ON b.c = c.c - c.c % 20),
g AS (SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
        sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d)) AS key FROM r
      UNION ALL SELECT c, 0, 0, '' FROM c),
n AS (SELECT d, key, min(c) AS own, count(*) AS n, min(w) AS w FROM g GROUP BY d, key),
up AS (SELECT DISTINCT x.d, x.key, y.key AS above FROM g x JOIN g y ON y.c = x.c AND y.d = x.d - 1),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS k FROM up GROUP BY ALL),
under AS (SELECT y.d, y.key, x.key AS low, any_value(x.n) AS n, any_value(x.w) AS w, any_value(kx.k) AS k
          FROM n x JOIN g y ON y.c = x.own AND y.d <= x.d LEFT JOIN kids kx ON kx.d = x.d AND kx.key = x.key GROUP BY y.d, y.key, x.d, x.key),
sums AS (SELECT d, key, count(*) FILTER (k IS NULL) AS leaves, sum((n - 1) * w) AS saved FROM under GROUP BY d, key),
e AS (SELECT g.d, key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM g JOIN (SELECT c, max(d) AS d FROM g GROUP BY c) l USING (c, d) GROUP BY g.d, key)
SELECT n.own AS conv_id, n.d::BIGINT AS depth, p.own AS parent_conv_id, n.n AS n_convs, coalesce(kids.k, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sums USING (d, key) LEFT JOIN up USING (d, key) LEFT JOIN n p ON p.d = n.d - 1 AND p.key = up.above
LEFT JOIN kids ON kids.d = n.d AND kids.key = n.key LEFT JOIN e ON e.d = n.d AND e.key = n.key
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op13_simhash")
def op13(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))
