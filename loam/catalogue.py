"""The named queries of the library and their SQL twins, by the ids of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import scalars as Z
from loam.operators import diff, duplicates, export, find, graph, lifecycle, maintain, related, search
from loam.plans import context, ingest, query_language
from loam.schema import DAY, ENTITY_COLUMNS, HISTORY, NOW
from loam.session import scratch_path, table
from loam.sources import adapters as A
from loam.sources import paths, scan
from loam.streaming import rename as rename_feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


E, L, R, V, C, D, N = A.ENTITIES_SQL, A.LISTING_SQL, A.RELATIONS_SQL, A.VECTORS_SQL, A.CONTENT_SQL, A.DOCUMENT_RELATIONS_SQL, A.RENAMES_SQL
ALL = ", ".join(ENTITY_COLUMNS)

# --- sources


@query("s1_scan_stats", f"WITH {E}, {L} SELECT count(*) AS total, count(*) FILTER (size_bytes <= 100000) AS indexed, count(*) FILTER (size_bytes > 100000) AS skipped, CAST(0 AS BIGINT) AS errors FROM listing WHERE NOT (path LIKE '/corpus/src3/%')")
def s1(spark, d):
    return scan.scan_stats(A.listing(spark, d), paths.IgnoreSet(extra_segments=("src3",)), max_bytes=100_000)


def _files(spark, d) -> DataFrame:
    """Documents as a listing of files."""
    e = A.entities(spark, d).select("path", "created_at", "modified_at", "accessed_at", "size_bytes")
    return e.join(A.content(spark, d).select("path", "content"), "path")


_SHOWN = ", ".join(c for c in ENTITY_COLUMNS if c != "id")
_STATE = "CASE WHEN accessed_at >= {0} - 30 * {1} THEN 'active' WHEN accessed_at >= {0} - 90 * {1} THEN 'dormant' ELSE 'archived' END".format(NOW, DAY)


@query("s2_snapshot", f"WITH {E} SELECT path, size_bytes, content_hash FROM entities WHERE size_bytes <= 20000 AND NOT path LIKE '/corpus/src4/%'")
def s2(spark, d):
    found = scan.to_entities(_files(spark, d), NOW, paths.IgnoreSet(extra_segments=("src4",)), max_bytes=20_000)
    return found.select("path", "size_bytes", "content_hash")


@query("s3_entities", f"WITH {E} SELECT {_SHOWN.replace('lifecycle', _STATE + ' AS lifecycle').replace('created_at, modified_at', 'coalesce(g.c, created_at) AS created_at, coalesce(g.m, modified_at) AS modified_at').replace('git_author', 'g.a AS git_author')} FROM entities LEFT JOIN (SELECT '/corpus/' || source || '/' || doc_id || '.' || lang AS gp, CAST(5 AS BIGINT) AS c, CAST(9 AS BIGINT) AS m, 'Ann' AS a FROM documents WHERE doc_id % 7 = 0) g ON gp = path")
def s3(spark, d):
    tracked = A.entities(spark, d).where(F.substring("id", 5, 20).cast("long") % 7 == 0)
    git = tracked.select("path", F.lit(5).cast("long").alias("created_at"), F.lit(9).cast("long").alias("modified_at"), F.lit("Ann").alias("author"))
    return scan.to_entities(_files(spark, d), NOW, git=git).drop("id")


@query("s4_content_hash", "SELECT doc_id, CASE WHEN strlen(text) > 10000 THEN 'size:' || strlen(text) ELSE sha256(text) END AS content_hash FROM documents")
def s4(spark, d):
    return table(spark, d, "documents").select("doc_id", scan.content_hash(F.col("text"), F.octet_length("text"), 10_000).alias("content_hash"))


@query("s5_ignore_filter", f"""WITH {E} SELECT path, (path LIKE '%/src3/%' OR (extension = 'de' AND NOT path LIKE '/corpus/src5/%') OR path LIKE '/corpus/src7/%') AS ignored FROM entities""")
def s5(spark, d):
    rules = paths.IgnoreSet(("src3",), ("# comment", "*.de", "!/src5/*.de", "src7/"), "/corpus")
    return A.entities(spark, d).select("path", rules.ignored(F.col("path")).alias("ignored"))


_SENSITIVE_NAMES = {"click": ".Env", "view": "server.PEM", "error": "environment.py", "purchase": "secrets.json", "signup": "id_rsa.pub"}


@query(
    "s6_sensitive_filter",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'matches sensitive pattern: .env' WHEN 'view' THEN 'matches sensitive pattern: *.pem'
      WHEN 'purchase' THEN 'matches sensitive pattern: secrets.json' WHEN 'signup' THEN 'in sensitive directory: .config/gcloud' END AS reason FROM events""",
)
def s6(spark, d):
    e = table(spark, d, "events")
    name = F.create_map(*[F.lit(x) for kv in _SENSITIVE_NAMES.items() for x in kv])[F.col("event_type")]
    folder = F.when(F.col("event_type") == "signup", "/.Config/gcloud/").otherwise("/src/")
    path = F.concat(F.lit("/u/"), F.col("user_id").cast("string"), folder, name)
    return e.select("event_id", paths.sensitive_reason(path).alias("reason"))


@query("s7_extract_text", f"WITH {C} SELECT path, CAST(length(substr(content, 1, 32000)) AS INTEGER) AS chars, sha256(substr(content, 1, 32000)) AS digest FROM content")
def s7(spark, d):
    return A.content(spark, d).select("path", scan.text_of(F.col("content")).alias("t")).select("path", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("s7_extract_bytes", f"WITH {C} SELECT path, CAST(length(substr(content, 1, 32000)) AS INTEGER) AS chars, sha256(substr(content, 1, 32000)) AS digest FROM content")
def s7b(spark, d):
    rows = A.content(spark, d).select("path", scan.extract_text(F.col("path"), F.col("content").cast("binary")).alias("t"))
    return rows.select("path", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("s8_import_edges", "SELECT '/repo/n' || a.n_nationkey || '/main.py' AS from_path, '/repo/n' || a.n_nationkey || '/r' || a.n_regionkey || '.py' AS to_path, 'imports' AS kind FROM nation a UNION SELECT '/repo/n' || n_nationkey || '/main.py', '/repo/common/base.py', 'imports' FROM nation")
def s8(spark, d):
    n = table(spark, d, "nation")
    folder = F.concat(F.lit("/repo/n"), F.col("n_nationkey").cast("string"))
    module = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    files = n.select(F.concat(folder, F.lit("/main.py")).alias("path"), F.concat(F.lit("import os\nfrom . import "), module, F.lit("\nfrom common.base import x\n")).alias("content"))
    known = n.select(F.concat(folder, F.lit("/"), module, F.lit(".py")).alias("path")).union(spark.createDataFrame([("/repo/common/base.py",)], "path string"))
    return scan.import_edges(files, known)


@query("s9_rust_mods", "SELECT '/crate/n' || n_nationkey || '/lib.rs' AS from_path, '/crate/n' || n_nationkey || CASE WHEN n_regionkey % 2 = 0 THEN '/r' || n_regionkey || '.rs' ELSE '/r' || n_regionkey || '/mod.rs' END AS to_path, 'mod' AS kind FROM nation")
def s9(spark, d):
    n = table(spark, d, "nation")
    folder, module = F.concat(F.lit("/crate/n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    files = n.select(F.concat(folder, F.lit("/lib.rs")).alias("path"), F.concat(F.lit("use std::fmt;\nmod "), module, F.lit(";\n// mod other;\nmod inline { }\nmod missing;\n")).alias("content"))
    known = n.select(F.concat(folder, F.lit("/"), module, F.when(F.col("n_regionkey") % 2 == 0, ".rs").otherwise("/mod.rs")).alias("path"))
    return scan.import_edges(files, known)


@query(
    "s10_script_edges",
    """SELECT '/web/n' || n_nationkey || '/main.ts' AS from_path, '/web/n' || n_nationkey || '/r' || n_regionkey || '.tsx' AS to_path, 'imports' AS kind FROM nation
    UNION ALL SELECT '/web/n' || n_nationkey || '/main.ts', '/web/shared/index.js', 'imports' FROM nation UNION ALL SELECT '/web/n' || n_nationkey || '/main.ts', '/web/lib.js', 'imports' FROM nation""",
)
def s10(spark, d):
    n = table(spark, d, "nation")
    folder, module = F.concat(F.lit("/web/n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    text = F.concat(F.lit("import React from 'react'\nimport { a } from './"), module, F.lit("'\nexport * from \"../shared\"\nconst l = require( '../lib.js' )\nimport x from './nowhere'\n"))
    files = n.select(F.concat(folder, F.lit("/main.ts")).alias("path"), text.alias("content"))
    known = n.select(F.concat(folder, F.lit("/"), module, F.lit(".tsx")).alias("path")).union(spark.createDataFrame([("/web/shared/index.js",), ("/web/lib.js",)], "path string"))
    return scan.import_edges(files, known)


@query(
    "s11_edges_by_language",
    """SELECT '/mix/a' || n_nationkey || e.ext AS from_path, '/mix/b' || n_nationkey || e.ext AS to_path, CASE WHEN e.ext = '.rs' THEN 'mod' ELSE 'imports' END AS kind
    FROM nation, (VALUES (0, '.py'), (1, '.rs'), (2, '.js')) e(k, ext) WHERE n_nationkey % 4 = e.k""",
)
def s11(spark, d):
    n = table(spark, d, "nation")
    key, kind = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 4
    ext = F.when(kind == 0, ".py").when(kind == 1, ".rs").when(kind == 2, ".js").otherwise(".txt")
    line = F.when(kind == 0, F.concat(F.lit("from .b"), key, F.lit(" import x\n"))).when(kind == 1, F.concat(F.lit("mod b"), key, F.lit(";\n"))).otherwise(F.concat(F.lit("import b from './b"), key, F.lit("'\n")))
    files = n.select(F.concat(F.lit("/mix/a"), key, ext).alias("path"), line.alias("content"))
    return scan.import_edges(files, n.select(F.concat(F.lit("/mix/b"), key, ext).alias("path")))


@query("href_edges", """SELECT DISTINCT url AS from_path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS to_path, 'links' AS kind FROM pages""")
def href(spark, d):
    return scan.href_edges(table(spark, d, "pages"))


@query(
    "s12_author_mode",
    """WITH c AS (SELECT '/customer/' || o_custkey AS path, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority AS author FROM orders),
    n AS (SELECT path, author, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT path, author FROM n QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, author) = 1)
    SELECT path, min(ts) AS created_at, max(ts) AS modified_at, t.author FROM c JOIN t USING (path) GROUP BY path, t.author""",
)
def s12(spark, d):
    return scan.git_metadata(A.commits(spark, d))


@query("s13_table_counts", f"WITH {E}, {R} SELECT 'entities' AS name, count(*) AS n FROM entities UNION ALL SELECT 'relations', count(*) FROM relations")
def s13(spark, d):
    count = lambda n, df: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count("entities", A.entities(spark, d)).union(count("relations", A.relations(spark, d)))


@query("s14_indexer_source", f"WITH {E} SELECT path, content_hash FROM entities WHERE lifecycle <> 'dead' AND (path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src2/%')")
def s14(spark, d):
    return find.indexer_source(A.entities(spark, d), ["/corpus/src1", "/corpus/src2"]).select("path", "content_hash")


# --- exports


@query("x1_json_lines", f"""WITH {E} SELECT CAST(to_json({{'path': path, 'size_bytes': size_bytes, 'lifecycle': lifecycle, 'summary': summary}}) AS VARCHAR) AS line FROM entities""")
def x1(spark, d):
    return export.json_lines(A.entities(spark, d), "path", "size_bytes", "lifecycle", "summary")


@query("x2_csv_lines", f"""WITH {E} SELECT '"' || path || '","' || name || '","' || extension || '",' || size_bytes || ',' || created_at || ',' || modified_at || ',' || accessed_at || ',"' || lifecycle || '","' || content_hash || '","",""' AS line FROM entities""")
def x2(spark, d):
    return export.csv_lines(A.entities(spark, d))


@query("x3_dot_lines", f"""WITH {E}, {D} SELECT '  "' || path || '";' AS line FROM entities UNION ALL SELECT '  "' || from_path || '" -> "' || to_path || '" [label="' || kind || '"];' FROM doc_relations""")
def x3(spark, d):
    return export.dot_lines(A.entities(spark, d).select("path"), A.document_relations(spark, d))


@query(
    "x5_mermaid",
    f"""WITH {R}, e AS (SELECT from_path, to_path, kind FROM relations WHERE to_path LIKE '/region/%'), n AS (SELECT from_path AS path FROM e UNION SELECT to_path FROM e),
    a AS (SELECT path, 'n' || (row_number() OVER (ORDER BY path) - 1) AS alias FROM n)
    SELECT '  ' || alias || '["' || path || '"]' AS line FROM a UNION ALL SELECT '  ' || f.alias || ' -->|' || kind || '| ' || t.alias FROM e JOIN a f ON f.path = from_path JOIN a t ON t.path = to_path""",
)
def x5(spark, d):
    e = A.relations(spark, d).where(F.col("to_path").startswith("/region/"))
    nodes = e.select(F.col("from_path").alias("path")).union(e.select("to_path")).distinct()
    return export.mermaid_lines(nodes, e)


@query("x6_entity_lines", f"WITH {E} SELECT rpad(lifecycle, 8, ' ') || '  ' || path AS line FROM entities")
def x6(spark, d):
    return export.entity_lines(A.entities(spark, d))


@query("x7_entity_text", f"WITH {E} SELECT path, sha256('path: ' || path || chr(10) || 'name: ' || name || chr(10) || 'extension: ' || extension || chr(10) || 'size_bytes: ' || size_bytes || chr(10) || 'lifecycle: ' || lifecycle || chr(10) || 'created_at: ' || created_at || chr(10) || 'modified_at: ' || modified_at || chr(10) || 'accessed_at: ' || accessed_at || chr(10) || 'content_hash: ' || content_hash || chr(10) || 'summary: -' || chr(10) || 'git_author: -') AS digest FROM entities")
def x7(spark, d):
    return export.entity_text(A.entities(spark, d)).select("path", F.sha2("text", 256).alias("digest"))


@query("x8_archive_plan", f"WITH {E} SELECT path, '/archive' || path AS target FROM entities WHERE lifecycle = 'archived' AND path LIKE '/corpus/src1/%'")
def x8(spark, d):
    return export.archive_plan(A.entities(spark, d), "/corpus/src1")


# --- maintenance

_UPSERT = f"""{E}, {L}, u AS (SELECT coalesce(o.id, n.id) AS id, coalesce(n.path, o.path) AS path, o.id AS oid, n.id AS nid, o.created_at AS oc, n.created_at AS nc, o.summary AS os, n.summary AS ns,
  o.lifecycle AS olife, n.lifecycle AS nlife, o.content_hash AS ohash, n.content_hash AS nhash,
  CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN o.extension ELSE n.extension END AS extension, CASE WHEN n.id IS NULL THEN o.size_bytes ELSE n.size_bytes END AS size_bytes,
  CASE WHEN n.id IS NULL THEN o.modified_at ELSE n.modified_at END AS modified_at, CASE WHEN n.id IS NULL THEN o.accessed_at ELSE n.accessed_at END AS accessed_at
  FROM entities o FULL JOIN listing n ON o.path = n.path)"""


@query("m1_upsert_rows", f"WITH {_UPSERT} SELECT id, path, name, extension, size_bytes, coalesce(oc, nc) AS created_at, modified_at, accessed_at, coalesce(nlife, olife) AS lifecycle, coalesce(nhash, ohash) AS content_hash, coalesce(os, ns) AS summary, CAST(NULL AS VARCHAR) AS git_author FROM u")
def m1(spark, d):
    return maintain.upsert(A.entities(spark, d), A.listing(spark, d))


_EVENTS = f"""SELECT id AS entity_id, path, 'created' AS event, CAST(NULL AS VARCHAR) AS old_lifecycle, nlife AS new_lifecycle, CAST(NULL AS VARCHAR) AS old_path, size_bytes, nhash AS content_hash, CAST({NOW} AS BIGINT) AS recorded_at, 0 AS seq FROM u WHERE oid IS NULL
  UNION ALL SELECT id, path, 'lifecycle', olife, nlife, NULL, size_bytes, nhash, {NOW}, 0 FROM u WHERE oid IS NOT NULL AND nid IS NOT NULL AND olife <> nlife
  UNION ALL SELECT id, path, 'modified', NULL, NULL, NULL, size_bytes, nhash, {NOW}, 1 FROM u WHERE oid IS NOT NULL AND nid IS NOT NULL AND ohash <> nhash"""


@query("m1_upsert_history", f"WITH {_UPSERT} {_EVENTS}")
def m1_history(spark, d):
    return maintain.upsert_history(A.entities(spark, d), A.listing(spark, d), NOW)


@query("m2_delete", f"WITH {E}, {D}, gone AS (SELECT path FROM entities WHERE lifecycle = 'archived') SELECT 'entity' AS what, path, CAST(NULL AS VARCHAR) AS other FROM entities WHERE path NOT IN (FROM gone) UNION ALL SELECT 'edge', from_path, to_path FROM doc_relations WHERE from_path NOT IN (FROM gone) AND to_path NOT IN (FROM gone) UNION ALL SELECT 'deleted', path, lifecycle FROM entities WHERE path IN (FROM gone)")
def m2(spark, d):
    e = A.entities(spark, d)
    left, edges, events = maintain.delete(e, A.document_relations(spark, d), spark.createDataFrame([], HISTORY), e.where("lifecycle = 'archived'"), NOW)
    none = F.lit(None).cast("string")
    return left.select(F.lit("entity").alias("what"), "path", none.alias("other")).union(edges.select(F.lit("edge"), "from_path", "to_path")).union(events.select(F.lit("deleted"), "path", "old_lifecycle"))


@query("m3_list_dead", f"WITH {E} SELECT path FROM entities WHERE lifecycle = 'dead'")
def m3(spark, d):
    return maintain.dead(A.entities(spark, d)).select("path")


@query("m4_touch", f"WITH {E}, a AS (SELECT '/corpus/' || source || '/' || doc_id || '.' || lang AS path, max({NOW} - {DAY} * quality * 10) AS ts FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT path, greatest(accessed_at, coalesce(ts, accessed_at)) AS accessed_at FROM entities LEFT JOIN a USING (path)")
def m4(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    access = labels.join(docs, "doc_id").select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), (F.lit(NOW) - DAY * F.col("quality") * 10).cast("long").alias("ts"))
    return maintain.touch(A.entities(spark, d), access).select("path", "accessed_at")


def _rename(spark, d):
    e = A.entities(spark, d)
    past = maintain.upsert_history(e.limit(0), e, NOW - DAY)
    return maintain.rename(e, A.document_relations(spark, d), past, maintain.resolve_renames(A.renames(spark, d)), NOW)


@query("m5_rename_entities", f"WITH {E}, {N} SELECT id, coalesce(new, path) AS path, CASE WHEN new IS NULL THEN name ELSE substr(new, 8) END AS name, CASE WHEN new IS NULL THEN extension ELSE 'txt' END AS extension, lifecycle FROM entities LEFT JOIN renames ON old = path")
def m5(spark, d):
    return _rename(spark, d)[0].select("id", "path", "name", "extension", "lifecycle")


@query("m5_rename_cascade", f"WITH {E}, {D}, {N} SELECT DISTINCT coalesce(a.new, from_path) AS from_path, coalesce(b.new, to_path) AS to_path, kind FROM doc_relations LEFT JOIN renames a ON a.old = from_path LEFT JOIN renames b ON b.old = to_path")
def m5_edges(spark, d):
    return _rename(spark, d)[1].select("from_path", "to_path", "kind")


@query("m5_rename_history", f"WITH {E}, {N} SELECT id AS entity_id, coalesce(new, path) AS path, 'created' AS event, CAST(NULL AS VARCHAR) AS old_path FROM entities LEFT JOIN renames ON old = path UNION ALL SELECT id, new, 'renamed', old FROM entities JOIN renames ON old = path")
def m5_history(spark, d):
    return _rename(spark, d)[2].select("entity_id", "path", "event", "old_path")


@query("m6_edge_upsert", f"WITH {R} SELECT from_path, to_path, kind, min(created_at) AS created_at FROM (SELECT * FROM relations UNION ALL SELECT from_path, to_path, kind, created_at - 1 FROM relations WHERE kind = 'in') GROUP BY ALL")
def m6(spark, d):
    r = A.relations(spark, d)
    return maintain.upsert_edges(r, r.where("kind = 'in'").withColumn("created_at", F.col("created_at") - 1))


@query("m7_replace_edges", f"WITH {R} SELECT from_path, to_path, kind FROM relations WHERE from_path NOT LIKE '/customer/%' UNION ALL SELECT DISTINCT from_path, replace(to_path, '/nation/', '/country/'), kind FROM relations WHERE from_path LIKE '/customer/%'")
def m7(spark, d):
    r = A.relations(spark, d)
    new = r.where(F.col("from_path").startswith("/customer/")).withColumn("to_path", F.replace(F.col("to_path"), F.lit("/nation/"), F.lit("/country/")))
    return maintain.replace_outgoing(r, new, new.select(F.col("from_path").alias("path"))).select("from_path", "to_path", "kind")


@query("m8_fts_upsert", f"WITH {C}, {N} SELECT path, name, substr(CASE WHEN old IS NULL THEN content ELSE 'new ' || content END, 1, 4000) AS content FROM content LEFT JOIN renames ON old = path")
def m8(spark, d):
    rows = search.fts_rows(A.content(spark, d))
    new = A.content(spark, d).join(A.renames(spark, d).select(F.col("old").alias("path")), "path", "left_semi").withColumn("content", F.concat(F.lit("new "), "content"))
    return maintain.upsert_by_path(rows, search.fts_rows(new))


@query("m9_vector_worklist", f"WITH {E}, {L} SELECT path FROM listing ANTI JOIN entities USING (path, content_hash)")
def m9(spark, d):
    return A.listing(spark, d).join(A.entities(spark, d), ["path", "content_hash"], "left_anti").select("path")


@query("m9_vector_upsert", f"""WITH {E}, {L} SELECT coalesce(l.path, e.path) AS path, coalesce(l.content_hash, e.content_hash) AS content_hash, CASE WHEN l.path IS NULL THEN 'old' ELSE l.path || ' ' || l.name END AS text_preview, CAST(CASE WHEN l.path IS NULL THEN 1 ELSE {NOW} END AS BIGINT) AS indexed_at
FROM entities e FULL JOIN (SELECT l.path, l.name, l.content_hash FROM listing l ANTI JOIN entities USING (path, content_hash)) l ON l.path = e.path""")
def m9_upsert(spark, d):
    one = F.array(F.lit(1.0).cast("float"))
    held = A.entities(spark, d).select("path", "content_hash", F.lit("old").alias("text_preview"), one.alias("vector"), F.lit(1).cast("long").alias("indexed_at"))
    texts = A.listing(spark, d).select("path", "content_hash", F.concat("path", F.lit("\n"), "name").alias("text"))
    return maintain.vector_upsert(held, texts, NOW).select("path", "content_hash", "text_preview", "indexed_at")


@query("m10_vector_move", f"WITH {E}, {N} SELECT coalesce(new, path) AS path, content_hash FROM entities LEFT JOIN renames ON old = path")
def m10(spark, d):
    return maintain.move_paths(A.entities(spark, d).select("path", "content_hash"), A.renames(spark, d))


@query("m11_clean_plan", f"WITH {E}, {L}, {D} SELECT 'dead' AS what, path, CAST(NULL AS VARCHAR) AS other FROM entities WHERE path NOT IN (SELECT path FROM listing) UNION ALL SELECT 'stale', from_path, to_path FROM (SELECT from_path, to_path FROM doc_relations UNION ALL SELECT from_path, to_path || '.old' FROM doc_relations WHERE kind = 'has_copy') WHERE from_path NOT IN (SELECT path FROM entities) OR to_path NOT IN (SELECT path FROM entities)")
def m11(spark, d):
    r = A.document_relations(spark, d)
    r = r.union(r.where("kind = 'has_copy'").withColumn("to_path", F.concat("to_path", F.lit(".old"))))
    return maintain.clean_plan(A.entities(spark, d), r, A.listing(spark, d).select("path"), NOW)


# --- filters and lookups


@query("f1_get_entity", f"WITH {E} SELECT {ALL} FROM entities WHERE path = '/corpus/src0/0.fr'")
def f1(spark, d):
    return find.by_path(A.entities(spark, d), "/corpus/src0/0.fr")


@query("f2_get_by_hash", f"WITH {E} SELECT path FROM entities WHERE content_hash = (SELECT content_hash FROM entities GROUP BY content_hash ORDER BY count(*) DESC, content_hash LIMIT 1)")
def f2(spark, d):
    e = A.entities(spark, d)
    top = e.groupBy("content_hash").count().orderBy(F.col("count").desc(), "content_hash").first()
    return find.by_hash(e, top["content_hash"]).select("path")


@query("f3_find_ext_size", f"WITH {E} SELECT path, size_bytes, modified_at FROM entities WHERE extension = 'en' AND size_bytes > 1048576 * 0 + 2000 ORDER BY modified_at DESC, path LIMIT 50")
def f3(spark, d):
    return find.find(A.entities(spark, d), find.FindFilter(extension=".en", larger_than=2000)).select("path", "size_bytes", "modified_at")


@query("f3_find_modified_after", f"WITH {E} SELECT path, modified_at FROM entities WHERE lifecycle = 'dormant' AND modified_at > 1693526400 ORDER BY modified_at DESC, path LIMIT 20 OFFSET 10")
def f3_modified(spark, d):
    f = find.build_filter(state="dormant", modified_after="2023-09-01", limit=20, offset=10)
    return find.find(A.entities(spark, d), f).select("path", "modified_at")


@query("f4_count_find", f"WITH {E} SELECT count(*) AS n FROM entities WHERE extension = 'de' AND created_at > 1688169600")
def f4(spark, d):
    return find.count_find(A.entities(spark, d), find.build_filter(extension="de", created_after="2023-07-01"))


@query("f5_matching", f"WITH {E} SELECT path FROM entities WHERE lifecycle = 'archived' AND size_bytes > 5000")
def f5(spark, d):
    return A.entities(spark, d).where(find.FindFilter(state="archived", larger_than=5000).condition()).select("path")


@query("f6_within_days", f"WITH {E} SELECT path FROM entities WHERE modified_at > {NOW} - 100 * {DAY}")
def f6(spark, d):
    return A.entities(spark, d).where(find.build_filter(modified_within_days=100, now=NOW).condition()).select("path")


@query("f7_ls", f"WITH {E} SELECT path, lifecycle FROM entities WHERE lifecycle = 'active' ORDER BY path LIMIT 20")
def f7(spark, d):
    return find.list_entities(A.entities(spark, d), "active").select("path", "lifecycle")


@query("f8_status", f"WITH {E} SELECT path, substr(content_hash, 1, 16) || '...' AS shown_hash, strftime(to_timestamp(accessed_at), '%Y-%m-%d %H:%M') || ' UTC' AS accessed FROM entities")
def f8(spark, d):
    return A.entities(spark, d).select("path", F.concat(Z.hash_prefix(F.col("content_hash")), F.lit("...")).alias("shown_hash"), Z.format_ts(F.col("accessed_at")).alias("accessed"))


@query("f9_list_by_lifecycle", f"WITH {E} SELECT path, name, lifecycle, accessed_at, size_bytes FROM entities WHERE lifecycle = 'dormant' ORDER BY accessed_at DESC, path LIMIT 20")
def f9(spark, d):
    return find.list_by_lifecycle(A.entities(spark, d), "dormant")


@query("f10_scope_filter", f"WITH {E} SELECT path FROM entities WHERE path LIKE '/corpus/src1/%'")
def f10(spark, d):
    return A.entities(spark, d).where(find.in_scope(F.col("path"), "/corpus/src1")).select("path")


@query("f11_prefix_filter", f"WITH {E} SELECT path FROM entities WHERE starts_with(path, '/corpus/src1')")
def f11(spark, d):
    return find.with_prefix(A.entities(spark, d), "/corpus/src1").select("path")


@query("f12_file_content", f"WITH {C} SELECT path, substr(content, 1, 32000) AS content, CAST(length(substr(content, 1, 32000)) AS INTEGER) AS chars FROM content")
def f12(spark, d):
    return A.content(spark, d).select("path", scan.text_of(F.col("content")).alias("content")).withColumn("chars", F.length("content"))


# --- lifecycle


@query("l1_lifecycle_state", f"WITH {E} SELECT path, CASE WHEN ({NOW} - accessed_at) // 86400 <= 7 THEN 'active' WHEN ({NOW} - accessed_at) // 86400 <= 14 THEN 'dormant' ELSE 'archived' END AS state FROM entities")
def l1(spark, d):
    return A.entities(spark, d).select("path", lifecycle.compute_state(F.col("accessed_at"), NOW, 7, 14).alias("state"))


@query("l2_refresh", f"WITH {E}, {L} SELECT e.path, e.lifecycle, n.s AS new_lifecycle FROM entities e JOIN (SELECT a.path, CASE WHEN b.path IS NULL THEN 'dead' WHEN ({NOW} - a.accessed_at) // 86400 <= 10 THEN 'active' WHEN ({NOW} - a.accessed_at) // 86400 <= 90 THEN 'dormant' ELSE 'archived' END AS s FROM entities a LEFT JOIN listing b ON a.path = b.path) n ON n.path = e.path WHERE e.lifecycle <> n.s")
def l2(spark, d):
    return lifecycle.refreshed(A.entities(spark, d), A.listing(spark, d), NOW, 10, 90).select("path", "lifecycle", "new_lifecycle")


@query("l3_due_refresh", f"""WITH {E}, n AS (SELECT path, lifecycle, ({NOW} + 45 * {DAY} - accessed_at) // {DAY} AS days FROM entities WHERE lifecycle <> 'dead'),
s AS (SELECT path, lifecycle AS old_lifecycle, CASE WHEN days <= 30 THEN 'active' WHEN days <= 90 THEN 'dormant' ELSE 'archived' END AS new_lifecycle FROM n) SELECT * FROM s WHERE old_lifecycle <> new_lifecycle""")
def l3(spark, d):
    t = lifecycle.DueTable(spark, scratch_path(spark, "due"))
    t.write(A.entities(spark, d), NOW)
    return t.refresh(NOW + 45 * DAY)


@query("l4_lifecycle_histogram", f"WITH {E} SELECT lifecycle, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM entities GROUP BY lifecycle")
def l4(spark, d):
    return lifecycle.histogram(A.entities(spark, d))


# --- joins


@query("j1_stale_relations", f"WITH {R}, n AS (SELECT DISTINCT '/part/' || p_partkey AS path FROM part UNION SELECT '/order/' || o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT from_path, to_path, kind FROM relations WHERE from_path NOT IN (SELECT path FROM n) OR to_path NOT IN (SELECT path FROM n)")
def j1(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("path"))
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("/order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return graph.stale_relations(A.relations(spark, d), parts.union(orders))


@query("j2_live_relations", f"WITH {R}, n AS (SELECT DISTINCT '/part/' || p_partkey AS path FROM part UNION SELECT '/order/' || o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT from_path, to_path, kind FROM relations WHERE from_path IN (SELECT path FROM n) AND to_path IN (SELECT path FROM n)")
def j2(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("path"))
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("/order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return graph.live_relations(A.relations(spark, d), parts.union(orders)).select("from_path", "to_path", "kind")


@query("j3_snapshot_diff", f"WITH {E}, {L} SELECT CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS status, coalesce(a.path, b.path) AS path FROM entities a FULL JOIN listing b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size_bytes <> b.size_bytes OR a.modified_at <> b.modified_at OR a.content_hash <> b.content_hash")
def j3(spark, d):
    return diff.snapshot_diff(A.entities(spark, d), A.listing(spark, d))


@query("j6_reconcile_by_hash", f"WITH {E}, {N}, i AS (SELECT coalesce(new, path) AS path, content_hash FROM entities LEFT JOIN renames ON old = path), u AS (SELECT * FROM entities WHERE lifecycle <> 'dead'), o AS (SELECT content_hash, min(path) AS new FROM u GROUP BY content_hash HAVING count(*) = 1) SELECT DISTINCT i.path AS old, o.new FROM i JOIN o USING (content_hash) WHERE i.path NOT IN (SELECT path FROM u)")
def j6(spark, d):
    e = A.entities(spark, d)
    return diff.reconcile_by_hash(maintain.move_paths(e.select("path", "content_hash"), A.renames(spark, d)), e)


@query("j7_rename_candidates", f"WITH {E}, {N}, l AS (SELECT coalesce(new, path) AS path, content_hash FROM entities LEFT JOIN renames ON old = path), m AS (SELECT content_hash, min(path) AS old FROM entities WHERE lifecycle <> 'dead' AND path NOT IN (SELECT path FROM l) GROUP BY content_hash HAVING count(*) = 1), f AS (SELECT content_hash, min(path) AS new FROM l WHERE path NOT IN (SELECT path FROM entities) GROUP BY content_hash HAVING count(*) = 1) SELECT old, new FROM m JOIN f USING (content_hash)")
def j7(spark, d):
    e = A.entities(spark, d)
    return diff.rename_candidates(e, maintain.move_paths(e.select("path", "content_hash"), A.renames(spark, d)))


@query("j9_index_worklist", f"WITH {E}, {L}, w AS (SELECT l.path, e.path IS NULL AS needs_vector, t.path IS NULL AS needs_fts FROM listing l LEFT JOIN entities e ON e.path = l.path AND e.content_hash = l.content_hash LEFT JOIN (SELECT path FROM entities) t ON t.path = l.path) SELECT * FROM w WHERE needs_vector OR needs_fts")
def j9(spark, d):
    e = A.entities(spark, d)
    return diff.index_worklist(A.listing(spark, d), e, e)


@query("j11_longest_prefix", f"WITH {E}, r AS (SELECT DISTINCT '/corpus/' || source AS root, source AS id FROM documents WHERE source <> 'src2' UNION ALL SELECT '/corpus', 'all') SELECT path, arg_max(r.id, length(root)) AS id FROM entities JOIN r ON starts_with(path, root || '/') GROUP BY path")
def j11(spark, d):
    roots = table(spark, d, "documents").where("source <> 'src2'").select(F.concat(F.lit("/corpus/"), "source").alias("root"), F.col("source").alias("id")).distinct()
    return find.longest_prefix(A.entities(spark, d), roots.union(spark.createDataFrame([("/corpus/", "all")], "root string, id string")))


# --- aggregations


@query("a1_exact_duplicates", f"WITH {E} SELECT content_hash, count(*) AS n, array_to_string(list_sort(list(path)), ',') AS paths FROM entities GROUP BY content_hash HAVING count(*) > 1")
def a1(spark, d):
    return duplicates.duplicate_groups(A.entities(spark, d)).withColumn("paths", F.array_join("paths", ","))


@query("a1_duplicate_members", f"WITH {E} SELECT content_hash, n, path FROM entities JOIN (SELECT content_hash, count(*) AS n FROM entities GROUP BY content_hash HAVING count(*) > 1) USING (content_hash)")
def a1_members(spark, d):
    return duplicates.duplicate_members(A.entities(spark, d))


@query("a2_scoped_duplicates", f"WITH {E} SELECT content_hash, count(*) AS n, array_to_string(list_sort(list(path)), ',') AS paths FROM entities WHERE path LIKE '/corpus/src8/%' GROUP BY content_hash HAVING count(*) > 1")
def a2(spark, d):
    return duplicates.duplicate_groups(A.entities(spark, d), "/corpus/src8").withColumn("paths", F.array_join("paths", ","))


@query("a3_graph_stats", f"WITH {E}, {D}, h AS (SELECT lifecycle, count(*) AS n FROM entities GROUP BY lifecycle) SELECT (SELECT count(*) FROM entities) AS total_entities, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM entities) AS total_bytes, (SELECT count(*) FROM doc_relations) AS total_relations, (SELECT string_agg(lifecycle || '=' || n, ',' ORDER BY lifecycle) FROM h) AS by_lifecycle")
def a3(spark, d):
    s = lifecycle.graph_stats(A.entities(spark, d), A.document_relations(spark, d))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("by_lifecycle")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return s.select("total_entities", "total_bytes", "total_relations", shown.alias("by_lifecycle"))


_REACH = """walk(path, depth) AS (SELECT from_path, 1 FROM relations WHERE to_path = '{0}' UNION SELECT r.from_path, w.depth + 1 FROM relations r JOIN walk w ON r.to_path = w.path WHERE w.depth < {1}),
reach AS (SELECT path, min(depth) AS depth FROM walk WHERE path <> '{0}' GROUP BY path)"""


@query("a4_impact_summary", f"WITH RECURSIVE {R}, {_REACH.format('/nation/3', 3)} SELECT '/nation/3' AS path, count(*) AS total, count(*) FILTER (depth = 1) AS direct, CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) <= 3 THEN 'low' WHEN count(*) <= 10 THEN 'medium' ELSE 'high' END AS risk FROM reach")
def a4(spark, d):
    return graph.impact_summary(A.relations(spark, d), "/nation/3", 3)


@query("a5_hash_paths", f"WITH {E} SELECT content_hash, count(*) AS n, min(path) AS first_path FROM entities GROUP BY content_hash")
def a5(spark, d):
    return duplicates.hash_paths(A.entities(spark, d))


@query("a7_distinct_hashes", f"WITH {E} SELECT DISTINCT content_hash FROM entities")
def a7(spark, d):
    return A.entities(spark, d).select("content_hash").distinct()


@query("a8_distinct_pairs", f"WITH {E} SELECT DISTINCT path, content_hash FROM entities")
def a8(spark, d):
    return A.entities(spark, d).select("path", "content_hash").distinct()


@query("a9_run_stats", f"""WITH {E}, {L}, {C}, o AS (SELECT CASE WHEN l.path LIKE '%/src3/%' THEN 'ignored' WHEN l.path LIKE '%/src4/%' THEN 'sensitive' WHEN e.path IS NOT NULL THEN 'up_to_date' WHEN c.content IS NULL OR trim(c.content) = '' THEN 'no_text' ELSE 'indexed' END AS outcome
  FROM listing l LEFT JOIN entities e ON e.path = l.path AND e.content_hash = l.content_hash LEFT JOIN content c ON c.path = l.path)
  SELECT count(*) AS total, count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome <> 'indexed') AS skipped, count(*) FILTER (outcome = 'sensitive') AS sensitive_skipped, CAST(0 AS BIGINT) AS errors FROM o""")
def a9(spark, d):
    e = A.entities(spark, d)
    sensitive = F.when(F.contains(F.col("path"), F.lit("/src4/")), F.lit("by rule"))
    return scan.run_stats(scan.index_run(A.listing(spark, d), e, e, A.content(spark, d), paths.IgnoreSet(("src3",)), sensitive))


# --- graph


@query("r1_reverse_deps", f"WITH RECURSIVE {R}, {_REACH.format('/region/1', 3)} SELECT path, CASE WHEN path LIKE '/order/%' THEN 'placed_by' ELSE 'in' END AS kind, CAST(depth AS INTEGER) AS depth FROM reach")
def r1(spark, d):
    return graph.reverse_deps(A.relations(spark, d), "/region/1", 3)


@query("r2_get_relations", f"WITH {R} SELECT from_path, to_path, kind FROM relations WHERE from_path = '/nation/3' OR to_path = '/nation/3'")
def r2(spark, d):
    return graph.relations_of(A.relations(spark, d), "/nation/3")


_AROUND = """w(a, b) AS (SELECT from_path, to_path FROM relations UNION ALL SELECT to_path, from_path FROM relations),
walk(path, depth) AS (SELECT '/region/2', 0 UNION SELECT w.b, walk.depth + 1 FROM w JOIN walk ON w.a = walk.path WHERE walk.depth < 2),
nodes AS (SELECT path, min(depth) AS depth FROM walk GROUP BY path)"""


@query("r3_neighbourhood", f"WITH RECURSIVE {R}, {_AROUND} SELECT path, CAST(depth AS INTEGER) AS depth FROM nodes")
def r3(spark, d):
    return graph.neighbourhood_nodes(A.relations(spark, d), "/region/2", 2)


@query("r3_neighbourhood_edges", f"WITH RECURSIVE {R}, {_AROUND} SELECT DISTINCT from_path, to_path, kind FROM relations WHERE from_path IN (SELECT path FROM nodes WHERE depth < 2) OR to_path IN (SELECT path FROM nodes WHERE depth < 2)")
def r3_edges(spark, d):
    r = A.relations(spark, d)
    return graph.neighbourhood_edges(r, graph.neighbourhood_nodes(r, "/region/2", 2), 2)


@query("r3b_bounded_neighbourhood", f"WITH RECURSIVE {R}, {_AROUND} SELECT path, CAST(depth AS INTEGER) AS depth FROM nodes ORDER BY depth, path LIMIT 50")
def r3b(spark, d):
    return graph.neighbourhood_nodes(A.relations(spark, d), "/region/2", 2, max_nodes=50)


@query("r4_cycles", f"WITH {E}, {D} SELECT DISTINCT a.from_path || ',' || a.to_path || ',' || a.from_path AS cycle FROM doc_relations a JOIN doc_relations b ON a.from_path = b.to_path AND a.to_path = b.from_path WHERE a.from_path < a.to_path")
def r4(spark, d):
    return graph.cycles(A.document_relations(spark, d)).select(F.array_join("cycle", ",").alias("cycle"))


@query(
    "r4_ring_cycles",
    """WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation),
    e AS (SELECT '/n/' || a.r || '/' || a.i AS a, '/n/' || b.r || '/' || b.i AS b FROM n a JOIN n b ON a.r = b.r AND (b.i = (a.i + 1) % a.m OR (a.i = 2 AND b.i = 0) OR (a.i = 3 AND b.i = 1))),
    w(first, path, last) AS (SELECT a, [a, b], b FROM e WHERE a < b UNION ALL SELECT first, list_append(path, e.b), e.b FROM w JOIN e ON e.a = w.last WHERE e.b > first AND NOT list_contains(path, e.b))
    SELECT array_to_string(list_append(path, first), ',') AS cycle FROM w JOIN e ON e.a = w.last AND e.b = w.first""",
)
def r4_rings(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("n_regionkey")
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r"), (F.row_number().over(own.orderBy("n_nationkey")) - 1).alias("i"), F.count("*").over(own).alias("m"))
    name = lambda x: F.concat_ws("/", F.lit("/n"), F.col(f"{x}.r").cast("string"), F.col(f"{x}.i").cast("string"))
    step = (F.col("b.i") == (F.col("a.i") + 1) % F.col("a.m")) | ((F.col("a.i") == 2) & (F.col("b.i") == 0)) | ((F.col("a.i") == 3) & (F.col("b.i") == 1))
    edges = n.alias("a").join(n.alias("b"), (F.col("a.r") == F.col("b.r")) & step).select(name("a").alias("from_path"), name("b").alias("to_path"), F.lit("next").alias("kind"))
    return graph.cycles(edges).select(F.array_join("cycle", ",").alias("cycle"))


@query("r7_history", f"WITH {_UPSERT}, h AS ({_EVENTS}) SELECT path, event, seq FROM h WHERE path = (SELECT min(path) FROM h WHERE event = 'modified') ORDER BY recorded_at DESC, seq DESC LIMIT 50")
def r7(spark, d):
    h = maintain.upsert_history(A.entities(spark, d), A.listing(spark, d), NOW)
    first = h.where("event = 'modified'").agg(F.min("path")).first()[0]
    return graph.history_of(h, first).select("path", "event", "seq")


@query("r8_history_text", f"WITH {_UPSERT}, h AS ({_EVENTS}) SELECT path, event, CASE event WHEN 'created' THEN 'state ' || new_lifecycle WHEN 'lifecycle' THEN old_lifecycle || ' -> ' || new_lifecycle ELSE 'hash ' || substr(content_hash, 1, 8) END AS detail FROM h")
def r8(spark, d):
    return graph.history_text(maintain.upsert_history(A.entities(spark, d), A.listing(spark, d), NOW)).select("path", "event", "detail")


def _projects(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    code = p.select(F.concat(F.lit("/repo/"), "p_brand", F.lit("/mod"), key, F.lit(".rs")).alias("path"))
    tests = p.select(F.concat(F.lit("/repo/"), "p_brand", F.lit("/tests/mod"), key, F.lit("_test.rs")).alias("path"))
    edges = p.select(F.concat(F.lit("/repo/"), "p_brand", F.lit("/tests/mod"), key, F.lit("_test.rs")).alias("from_path"), F.concat(F.lit("/repo/"), "p_brand", F.lit("/mod"), key, F.lit(".rs")).alias("to_path"), F.lit("imports").alias("kind"))
    return code.union(tests), edges


@query(
    "r9_related_tests",
    """WITH t AS (SELECT '/repo/' || p_brand || '/tests/mod' || p_partkey || '_test.rs' AS path, p_brand, p_partkey FROM part), i AS (SELECT p_partkey AS k, p_brand AS b FROM part WHERE p_partkey = 7)
    SELECT path, CAST(1 + CASE WHEN contains(path, 'mod7_test') THEN 10 ELSE 0 END + 4 + CASE WHEN p_partkey = 7 THEN 15 ELSE 0 END AS BIGINT) AS score,
      array_to_string(list_filter([CASE WHEN p_partkey = 7 THEN 'imports planned file' END, CASE WHEN contains(path, 'mod7_test') THEN 'name match' END, 'same area', 'test file'], lambda x: x IS NOT NULL), ',') AS reasons
    FROM t, i ORDER BY score DESC, path LIMIT 10""",
)
def r9(spark, d):
    e, r = _projects(spark, d)
    brand = table(spark, d, "part").where("p_partkey = 7").first()["p_brand"]
    got = related.related_tests(e, r, [f"/repo/{brand}/mod7.rs"], 10)
    return got.withColumn("reasons", F.array_join("reasons", ","))


@query("r10_test_paths", "SELECT '/repo/' || p_brand || '/tests/mod' || p_partkey || '_test.rs' AS path FROM part")
def r10(spark, d):
    return _projects(spark, d)[0].where(related.is_test_path(F.col("path")))


@query("r11_test_commands", "SELECT '/repo/' || p_brand || '/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.md' END AS path, CASE p_partkey % 3 WHEN 0 THEN 'cargo test --workspace --all-targets' WHEN 1 THEN 'uv run --group dev pytest' END AS command FROM part")
def r11(spark, d):
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    p = table(spark, d, "part").select(F.concat(F.lit("/repo/"), "p_brand", F.lit("/"), key, F.when(kind == 0, ".rs").when(kind == 1, ".py").otherwise(".md")).alias("path"))
    return p.select("path", related.test_command(F.col("path")).alias("command"))


@query("r12_change_plan_impact", f"""WITH RECURSIVE {R}, asked AS (SELECT '/nation/' || n_nationkey AS start FROM nation UNION ALL SELECT '/region/' || r_regionkey FROM region),
walk(start, path, depth) AS (SELECT start, start, 0 FROM asked UNION SELECT start, r.from_path, w.depth + 1 FROM relations r JOIN walk w ON r.to_path = w.path WHERE w.depth < 2),
reach AS (SELECT start, path, min(depth) AS depth FROM walk WHERE path <> start GROUP BY start, path)
SELECT start AS path, count(path) AS total, count(*) FILTER (depth = 1) AS direct, CASE WHEN count(path) = 0 THEN 'none' WHEN count(path) <= 3 THEN 'low' WHEN count(path) <= 10 THEN 'medium' ELSE 'high' END AS risk FROM asked LEFT JOIN reach USING (start) GROUP BY start""")
def r12(spark, d):
    starts = [f"/nation/{i}" for i in range(25)] + [f"/region/{i}" for i in range(5)]  # the stated files of a plan
    return graph.impact_of_many(graph.reverse_deps_many(A.relations(spark, d), starts, 2), starts)


_HISTORY_SQL = """o AS (SELECT o_custkey AS c, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority AS author, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS j FROM orders)"""


@query("s12_followed_history", f"""WITH {_HISTORY_SQL}, f AS (SELECT c, j // 3 AS v, max(j) AS upto FROM o GROUP BY ALL),
a AS (SELECT f.c, v, author, count(*) AS n, arg_min(ts, j) AS first, arg_max(ts, j) AS last, min(j) AS j0, max(j) AS j1 FROM f JOIN o ON o.c = f.c AND o.j <= f.upto GROUP BY ALL)
SELECT '/customer/' || c || '/v' || v AS path, arg_min(first, j0) AS created_at, arg_max(last, j1) AS modified_at, arg_min(author, struct_pack(n := -n, author := author)) AS author FROM a GROUP BY c, v""")
def s12_follow(spark, d):
    from pyspark.sql import Window

    from loam.sources import git

    o = table(spark, d, "orders")
    j = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    o = o.select("o_custkey", ts.alias("ts"), F.col("o_orderpriority").alias("author"), j.alias("j"), ((F.lit(1 << 33) - ts) * 100_000_000 - F.col("o_orderkey")).alias("nth"))
    name = lambda v: F.concat(F.lit("/customer/"), F.col("o_custkey").cast("string"), F.lit("/v"), v.cast("long").cast("string"))
    v = F.floor(F.col("j") / 3)
    moved = (F.col("j") % 3 == 0) & (F.col("j") > 0)  # every third change gives the file another name
    return git.follow(o.select(name(v).alias("path"), F.when(moved, name(v - 1)).alias("old_path"), F.when(moved, "R").otherwise("M").alias("status"), "nth", "ts", "author"))


@query("s1_tree_files", "SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS errors, true AS hashed FROM documents GROUP BY source")
def s1_tree(spark, d):
    from loam.sources import tree

    at = scratch_path(spark, "tree")
    table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").text(at)
    files = tree.with_hash(tree.listing(spark, at).where(~F.col("path").endswith(".crc") & ~F.col("path").endswith("_SUCCESS")))
    by = files.groupBy(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"))
    return by.agg(F.sum("size_bytes").alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.every(F.length("content_hash") == 64).alias("hashed"))


# --- search


_BM25 = f"""{C}, t AS (SELECT path, list_filter(regexp_split_to_array(lower(strip_accents(name || ' ' || substr(content, 1, 4000))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM content),
s AS (SELECT path, len(t) AS dl, len(list_filter(t, lambda x: x = '@0')) AS a, len(list_filter(t, lambda x: x = '@1')) AS b FROM t),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM s),
q AS (SELECT path, -(greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM s, n WHERE a > 0 AND b > 0)"""


def _bm25(a: str, b: str) -> str:
    return _BM25.replace("@0", a).replace("@1", b)


@query("q1_sanitize", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\-/.]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents")
def q1(spark, d):
    return table(spark, d, "documents").select("doc_id", search.sanitized(F.col("text")).alias("clean"))


@query("q4_vector_rows", f"WITH {E}, {C} SELECT e.path, content_hash, replace(substr(content, 1, 500), chr(10), ' ') AS text_preview, CAST(length(content) AS DOUBLE) AS v0, CAST(length(content) - length(replace(content, 'e', '')) AS DOUBLE) AS v1, CAST(7 AS BIGINT) AS indexed_at FROM entities e JOIN content c ON c.path = e.path")
def q4(spark, d):
    rows = A.entities(spark, d).select("path", "content_hash").join(A.content(spark, d).select("path", F.col("content").alias("text")), "path")
    got = search.vector_rows(rows, at=7, load=lambda: lambda t: [float(len(t)), float(t.count("e"))])
    return got.select("path", "content_hash", "text_preview", F.col("vector")[0].cast("double").alias("v0"), F.col("vector")[1].cast("double").alias("v1"), "indexed_at")


@query("q2_bm25_topk", f"WITH {_bm25('erha', 'thre')} SELECT path, round(rank, 6) AS rank FROM q ORDER BY q.rank, path LIMIT 10")
def q2(spark, d):
    hits = search.fts_search(search.fts_rows(A.content(spark, d)), "Erha thre")
    return hits.select("path", F.round("rank", 6).alias("rank"))


@query("q2_bm25_all", f"WITH {_bm25('that', 'with')} SELECT path, round(rank, 6) AS rank FROM q")
def q2_all(spark, d):
    return search.fts_match(search.fts_rows(A.content(spark, d)), "that with").select("path", F.round("rank", 6).alias("rank"))


@query("q3_fts_norm", f"WITH {_bm25('that', 'with')} SELECT path, 1.0::DOUBLE AS parity, round(1 / (1 + abs(rank)), 6) AS documented FROM q")
def q3(spark, d):
    hits = search.fts_match(search.fts_rows(A.content(spark, d)), "that with")
    return hits.select("path", search.fts_score(F.col("rank")).alias("parity"), F.round(search.fts_score(F.col("rank"), "abs"), 6).alias("documented"))


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_QV = "qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_DIST = "list_sum(list_transform(list_zip(vector, q), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"


@query("q5_knn_topk", f"WITH {V}, {_QV}, k AS (SELECT path, {_DIST} AS x FROM vectors, qv) SELECT path, round(x, 6) AS distance, round(1 - x, 6) AS score FROM k ORDER BY x, path LIMIT 10")
def q5(spark, d):
    return search.knn(A.vectors(spark, d), _query_vector(spark, d)).select("path", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("q6_scoped_knn", f"WITH {V}, {_QV}, k AS (SELECT path, {_DIST} AS x FROM vectors, qv WHERE path LIKE '/vec/1/%') SELECT path, round(x, 6) AS distance FROM k ORDER BY x, path LIMIT 10")
def q6(spark, d):
    return search.knn(A.vectors(spark, d), _query_vector(spark, d), 10, "/vec/1").select("path", F.round("distance", 6).alias("distance"))


@query("q7_knn_by_example", f"WITH {V}, {_QV}, k AS (SELECT path, {_DIST} AS x FROM vectors, qv WHERE path NOT LIKE '/vec/%/0') SELECT path, round(x, 6) AS distance FROM k ORDER BY x, path LIMIT 5")
def q7(spark, d):
    own = A.vectors(spark, d).where(F.col("path").rlike("^/vec/[0-9]+/0$")).first()["path"]
    return search.knn_like(A.vectors(spark, d), own, 5).select("path", F.round("distance", 6).alias("distance"))


def _document_vectors(spark, d) -> DataFrame:
    """Vectors under documents' paths, so that both channels can meet: the vector's id names the document."""
    c = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"))
    return table(spark, d, "embeddings").join(c, F.col("vec_id") == F.col("doc_id")).select("path", F.col("embedding").alias("vector"))


_HYBRID = f"""{E}, {_bm25('that', 'with')}, {_QV}, dv AS (SELECT '/corpus/' || source || '/' || doc_id || '.' || lang AS path, embedding AS vector FROM embeddings JOIN documents ON vec_id = doc_id),
v AS (SELECT path, 1 - {_DIST} AS vs FROM dv, qv ORDER BY vs DESC, path LIMIT 40), f AS (SELECT path, rank FROM q ORDER BY rank, path LIMIT 40),
h AS (SELECT path, vs, rank, coalesce(vs * 0.7, 0) + CASE WHEN rank IS NULL THEN 0 ELSE 0.3 END AS score, CASE WHEN vs IS NOT NULL AND rank IS NOT NULL THEN 'hybrid' WHEN vs IS NOT NULL THEN 'vector' ELSE 'fts' END AS source FROM v FULL JOIN f USING (path))"""


def _hybrid(spark, d, **options):
    return query_language.hybrid(A.entities(spark, d), _document_vectors(spark, d), search.fts_rows(A.content(spark, d)), "that with", query_vector=_query_vector(spark, d), **options)


@query("q8_hybrid_topk", f"WITH {_HYBRID} SELECT path, round(score, 6) AS score, source FROM h ORDER BY h.score DESC, path LIMIT 10")
def q8(spark, d):
    return search.ranked(_hybrid(spark, d)).select("path", F.round("score", 6).alias("score"), "source")


@query("q8_hybrid_filtered", f"WITH {_HYBRID.replace('LIMIT 40', 'LIMIT 120')} SELECT path, round(score, 6) AS score, source FROM h WHERE path IN (SELECT path FROM entities WHERE lifecycle = 'dormant') ORDER BY h.score DESC, path LIMIT 10")
def q8_filtered(spark, d):
    return search.ranked(_hybrid(spark, d, metadata=find.FindFilter(state="dormant"))).select("path", F.round("score", 6).alias("score"), "source")


@query(
    "q10_explanation",
    f"""WITH {_HYBRID.replace("'that'", "'that'")} SELECT path, source, false AS path_match, array_to_string(list_filter([CASE source WHEN 'hybrid' THEN 'matched in both vector and FTS channels' WHEN 'vector' THEN 'matched via semantic vector search' ELSE 'matched via full-text search (FTS)' END,
      CASE WHEN vs IS NOT NULL THEN CASE WHEN vs >= 0.8 THEN 'high' WHEN vs >= 0.6 THEN 'moderate' ELSE 'low' END || ' semantic similarity (' || printf('%.3f', vs) || ')' END,
      CASE WHEN rank IS NOT NULL THEN 'strong FTS match (score 1.000)' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM h""",
)
def q10(spark, d):
    return _hybrid(spark, d, explain=True).select("path", "source", "path_match", F.array_join("reasons", "; ").alias("reasons"))


@query("q11_page_total", f"WITH {_HYBRID} SELECT path, round(score, 6) AS score, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 12 AS has_more FROM h ORDER BY h.score DESC, path LIMIT 7 OFFSET 5".replace("LIMIT 40", "LIMIT 48"))
def q11(spark, d):
    page = query_language.search_page(A.entities(spark, d), _document_vectors(spark, d), search.fts_rows(A.content(spark, d)), "that with", 7, 5, query_vector=_query_vector(spark, d))
    return page.items.select("path", F.round("score", 6).alias("score"), F.lit(page.total).cast("long").alias("total"), F.lit(page.has_more).alias("has_more"))


@query("q13_dispatch_filters", f"WITH {E} SELECT path, modified_at FROM entities WHERE lifecycle = 'dormant' AND extension = 'fr' ORDER BY modified_at DESC, path LIMIT 10")
def q13(spark, d):
    return query_language.dispatch(A.entities(spark, d), None, None, "state:dormant ext:.fr").select("path", "modified_at")


@query("q15_saved_in_scope", f"WITH {E} SELECT path, modified_at FROM entities WHERE path LIKE '/corpus/src1/%' AND lifecycle <> 'dead' AND lifecycle = 'dormant' AND size_bytes > 0 ORDER BY modified_at DESC, path LIMIT 15")
def q15(spark, d):
    from pathlib import Path

    from loam.plans.session_api import Session

    saved = query_language.SavedQueries(Path("unwritten"), {"old": query_language.SavedQuery("find", state="dormant", larger_than_mb=0, limit=15)})
    s = Session(A.entities(spark, d), A.relations(spark, d), spark.createDataFrame([], HISTORY), saved=saved, scope="/corpus/src1")
    return s.run_saved_query("old").select("path", "modified_at")


def _index(spark, d) -> search.TextIndex:
    """The documents' texts in a stored index, of which a part came in later."""
    index = search.TextIndex(spark, scratch_path(spark, "index"))
    t = A.content(spark, d)
    late = F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(5)) == 0
    index.add(t.select("path", "name", F.when(late, "that with").otherwise(F.substring("content", 1, 4000)).alias("content")))
    index.add(search.fts_rows(t.where(late)))
    return index


@query("q2_index_topk", ORACLES["q2_bm25_topk"])
def q2_index(spark, d):
    return _index(spark, d).top("Erha thre", 10).select("path", F.round("rank", 6).alias("rank"))


@query("q8_index_topk", ORACLES["q8_hybrid_topk"])
def q8_index(spark, d):
    hits = query_language.hybrid(A.entities(spark, d), _document_vectors(spark, d), _index(spark, d), "that with", query_vector=_query_vector(spark, d))
    return search.ranked(hits).select("path", F.round("score", 6).alias("score"), "source")


@query("q14_saved_find", f"WITH {E} SELECT path, modified_at FROM entities WHERE lifecycle = 'archived' AND extension = 'en' ORDER BY modified_at DESC, path LIMIT 20")
def q14(spark, d):
    return query_language.SavedQuery("find", state="archived", extension="en").run(A.entities(spark, d)).select("path", "modified_at")


@query(
    "q16_context_budget",
    f"""WITH {C}, i AS (SELECT row_number() OVER (ORDER BY path) AS rank, path, replace(substr(content, 1, 500), chr(10), ' ') AS snippet FROM content),
    c AS (SELECT rank, path, CAST(strlen(path) + strlen(snippet) + 256 AS BIGINT) AS cost FROM i), s AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT path, cost, CAST(before AS BIGINT) AS spent_before FROM s WHERE before < 12000""",
)
def q16(spark, d):
    from pyspark.sql import Window

    ranked = A.content(spark, d).orderBy("path").limit(50)  # a page of ranked hits; 12,000 hold fewer
    items = ranked.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")).alias("rank"), "path", Z.preview(F.col("content")).alias("snippet"))
    return context.budgeted(items, 12_000).select("path", "cost", "spent_before")


@query("q16_context_items", f"""WITH {_UPSERT}, {D}, h AS ({_EVENTS}), x AS (SELECT path, from_path, to_path, kind FROM (SELECT from_path AS path, from_path, to_path, kind FROM doc_relations UNION ALL SELECT to_path, from_path, to_path, kind FROM doc_relations) QUALIFY row_number() OVER (PARTITION BY path ORDER BY from_path, to_path, kind) <= 8),
  y AS (SELECT path, count(*) AS n_edges FROM x GROUP BY path), z AS (SELECT path, least(count(*), 3) AS n_events FROM h GROUP BY path)
  SELECT e.path, e.lifecycle, CAST(coalesce(n_edges, 0) AS INTEGER) AS n_edges, CAST(coalesce(n_events, 0) AS INTEGER) AS n_events FROM entities e LEFT JOIN y ON y.path = e.path LEFT JOIN z ON z.path = e.path""")
def q16_items(spark, d):
    e = A.entities(spark, d)
    history = maintain.upsert_history(e, A.listing(spark, d), NOW)
    got = context.enriched(e.select("path"), e, A.document_relations(spark, d), history)
    none = F.lit(0)
    return got.select("path", "lifecycle", F.coalesce(F.size("relations"), none).alias("n_edges"), F.coalesce(F.size("recent_history"), none).alias("n_events"))


# --- sorting, sets, scalars


@query("o8_latest_history", f"WITH {_UPSERT}, h AS ({_EVENTS}) SELECT path, event, seq FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY recorded_at DESC, seq DESC) <= 1")
def o8(spark, d):
    h = maintain.upsert_history(A.entities(spark, d), A.listing(spark, d), NOW)
    return search.latest_per_path(h, "path", [F.col("recorded_at").desc(), F.col("seq").desc()], 1).select("path", "event", "seq")


@query("z1_format_ts", f"WITH {E} SELECT path, strftime(to_timestamp(created_at), '%Y-%m-%d %H:%M') || ' UTC' AS created FROM entities")
def z1(spark, d):
    return A.entities(spark, d).select("path", Z.format_ts(F.col("created_at")).alias("created"))


@query("z2_human_bytes", "SELECT doc_id, CASE WHEN strlen(text) >= 1048576 THEN printf('%.1f MB', strlen(text) / 1048576.0) WHEN strlen(text) >= 1024 THEN printf('%.1f KB', strlen(text) / 1024.0) ELSE strlen(text) || ' B' END AS size FROM documents")
def z2(spark, d):
    return table(spark, d, "documents").select("doc_id", Z.human_bytes(F.octet_length("text")).alias("size"))


@query(
    "z_scalars",
    f"""WITH {E}, {C} SELECT path, substr(content_hash, 1, 8) AS short_hash, starts_with(content_hash, 'size:') AS pseudo, replace(translate(name, '_-', '  '), '.', ' ') AS hint,
    replace(substr(content, 1, 500), chr(10), ' ') AS preview, substr(content, 1, 40) AS excerpt, '/corpus/' || split_part(path, '/', 3) AS parent_dir, split_part(name, '.', 1) AS stem, replace(extension, '"', '\\"') AS escaped
    FROM entities JOIN content USING (path)""".replace("FROM entities JOIN content USING (path)", "FROM entities JOIN (SELECT path, content FROM content) USING (path)"),
)
def z(spark, d):
    both = A.entities(spark, d).join(A.content(spark, d).select("path", "content"), "path")
    return both.select(
        "path", Z.hash_prefix(F.col("content_hash"), 8).alias("short_hash"), Z.is_pseudo_hash(F.col("content_hash")).alias("pseudo"), Z.query_hint(F.col("name")).alias("hint"),
        Z.preview(F.col("content")).alias("preview"), Z.excerpt(F.col("content"), 40).alias("excerpt"), Z.parent(F.col("path")).alias("parent_dir"), Z.stem(F.col("name")).alias("stem"), Z.mermaid_escape(F.col("extension")).alias("escaped"),
    )


@query("z12_parse_date", "SELECT o_orderkey, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) AS day FROM orders")
def z12(spark, d):
    return table(spark, d, "orders").select("o_orderkey", Z.parse_date_column(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


# --- change feed


def _mixed_changes(spark, d) -> DataFrame:
    """Changes of which a third has no hash, a third one that stands for a size; some renames come in one event."""
    c = A.changes(spark, d)
    third = F.col("event_id") % 3
    h = F.when(third == 0, F.lit(None)).when(third == 1, F.concat(F.lit("size:"), F.col("event_id").cast("string"))).otherwise(F.col("content_hash"))
    both = (F.col("action") == "rename_to") & (F.col("event_id") % 2 == 0)
    return c.withColumn("content_hash", h).withColumn("new_path", F.when(both, F.concat("path", F.lit("/new")))).withColumn("action", F.when(both, "rename_both").otherwise(F.col("action")))


@query(
    "w2_direct_actions",
    """WITH c AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'access' WHEN 'click' THEN 'modify' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'rename_both' ELSE 'rename_to' END END AS a,
      '/u/' || user_id AS p, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'size:' || event_id ELSE 'h' || json_extract_string(props, '$.k') END AS h FROM events)
    SELECT CASE WHEN a = 'rename_both' THEN 'rename' WHEN a = 'access' THEN 'touch' WHEN a = 'remove' THEN 'delete' ELSE 'upsert' END AS action, CASE WHEN a = 'rename_both' THEN p || '/new' ELSE p END AS path, CASE WHEN a = 'rename_both' THEN p END AS old_path, h AS content_hash, ts
    FROM c WHERE a IN ('rename_both', 'access') OR (a IS NOT NULL AND (h IS NULL OR h LIKE 'size:%'))""",
)
def w2(spark, d):
    return rename_feed.direct_actions(_mixed_changes(spark, d))


@query(
    "w4_stored_hashes",
    f"""WITH {E}, c AS (SELECT path, CASE WHEN size_bytes % 2 = 0 THEN 'remove' ELSE 'create' END AS action FROM entities) SELECT path, action, CASE WHEN action = 'remove' THEN content_hash ELSE 'new' END AS content_hash FROM c JOIN entities USING (path)""",
)
def w4(spark, d):
    e = A.entities(spark, d)
    made = F.col("size_bytes") % 2 != 0
    events = e.select(F.xxhash64("path").alias("event_id"), F.lit(5).cast("long").alias("ts"), F.when(made, "create").otherwise("remove").alias("action"), "path", F.lit(None).cast("string").alias("new_path"), F.when(made, "new").alias("content_hash"))
    return rename_feed.with_hash(events, e).select("path", "action", "content_hash")


@query(
    "w6_apply_actions",
    f"""WITH {E}, {N} SELECT coalesce(new, e.path) AS path, e.id, CASE WHEN lifecycle = 'dormant' AND new IS NULL THEN {NOW} + 5 ELSE accessed_at END AS accessed_at FROM entities e LEFT JOIN renames ON old = e.path WHERE new IS NOT NULL OR lifecycle <> 'archived'""",
)
def w6(spark, d):
    e, moved = A.entities(spark, d), A.renames(spark, d)
    at = F.lit(NOW + 5).cast("long")
    none = F.lit(None).cast("string")
    rest = e.join(moved.select(F.col("old").alias("path")), "path", "left_anti")
    actions = moved.select(F.lit("rename").alias("action"), F.col("new").alias("path"), F.col("old").alias("old_path"), none.alias("content_hash"), at.alias("ts"))
    actions = actions.union(rest.where("lifecycle = 'archived'").select(F.lit("delete"), "path", none, none, at)).union(rest.where("lifecycle = 'dormant'").select(F.lit("touch"), "path", none, none, at))
    out, _, _ = ingest.apply_actions(e, A.document_relations(spark, d), spark.createDataFrame([], HISTORY), actions, e.limit(0), NOW)
    return out.select("path", "id", "accessed_at")


@query("w8_rescan", f"""WITH {E}, disk AS (SELECT CASE WHEN doc_id % 11 = 0 THEN '/corpus/moved/' || doc_id || '.' || lang ELSE '/corpus/' || source || '/' || doc_id || '.' || lang END AS path, sha256(text || CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END) AS h, doc_id % 140 AS days FROM documents WHERE doc_id % 7 <> 0),
missing AS (SELECT path, content_hash AS h FROM entities WHERE lifecycle <> 'dead' AND path NOT IN (SELECT path FROM disk)), fresh AS (SELECT path, h FROM disk WHERE path NOT IN (SELECT path FROM entities)),
ren AS (SELECT o.path AS old, n.path AS new FROM (SELECT h, min(path) AS path FROM missing GROUP BY h HAVING count(*) = 1) o JOIN (SELECT h, min(path) AS path FROM fresh GROUP BY h HAVING count(*) = 1) n USING (h)),
after AS (SELECT coalesce(new, path) AS path, true AS known FROM entities LEFT JOIN ren ON old = path UNION ALL SELECT path, false FROM fresh WHERE path NOT IN (SELECT new FROM ren))
SELECT path, CASE WHEN days IS NULL THEN 'dead' WHEN days <= 30 THEN 'active' WHEN days <= 90 THEN 'dormant' ELSE 'archived' END AS lifecycle, known FROM after LEFT JOIN disk USING (path)""")
def w8(spark, d):
    i = F.col("doc_id")
    name = F.concat(i.cast("string"), F.lit("."), "lang")
    at = F.when(i % 11 == 0, F.concat(F.lit("/corpus/moved/"), name)).otherwise(F.concat(F.lit("/corpus/"), "source", F.lit("/"), name))
    text = F.concat("text", F.when(i % 13 == 0, "x").otherwise("")).cast("binary")
    then = (F.lit(NOW) - DAY * (i % 140)).cast("long")
    gone = i % 7 == 0  # some files have left the disk
    disk = table(spark, d, "documents").where(~gone).select(at.alias("path"), then.alias("created_at"), then.alias("modified_at"), then.alias("accessed_at"), F.octet_length(text).cast("long").alias("size_bytes"), text.alias("content"))
    e, _, _ = ingest.rescan(A.entities(spark, d), A.document_relations(spark, d), spark.createDataFrame([], HISTORY), disk, NOW)
    return e.select("path", "lifecycle", F.col("id").startswith("doc-").alias("known"))


@query("w9_index_once", f"""WITH {E}, {C}, s AS (SELECT e.path, content, e.lifecycle FROM entities e JOIN content c ON c.path = e.path WHERE e.lifecycle <> 'dead')
  SELECT path, CASE WHEN path LIKE '/corpus/src3/%' THEN 'ignored' WHEN path LIKE '%.fr' THEN 'sensitive' WHEN trim(content, ' ') = '' THEN 'no_text' ELSE 'indexed' END AS outcome FROM s""")
def w9(spark, d):
    texts = spark.createDataFrame([], "path string, name string, content string")
    vectors = spark.createDataFrame([], "path string, content_hash string, text_preview string, vector array<float>, indexed_at long")
    relations = spark.createDataFrame([], "from_path string, to_path string, kind string, created_at long")
    files = A.content(spark, d).select("path", "content")
    got = ingest.index_once(A.entities(spark, d), relations, texts, vectors, files, NOW, paths.IgnoreSet(extra_segments=("src3",)), extra_sensitive=("*.fr",))
    return got["outcomes"].select("path", "outcome")


# a loop over the events of each hash, in order, that carries the held removes
_TRACKED = """c AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) // 5000 AS ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'access' WHEN 'click' THEN 'modify' WHEN 'error' THEN 'remove' ELSE 'rename_to' END AS a, '/u/' || user_id AS p, 'h' || json_extract_string(props, '$.k') AS h FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ts, event_id) AS n FROM c WHERE a <> 'access' AND ts <= @UNTIL),
r(h, n, a, p, ts, expired, old, cancelled, held) AS (
  SELECT DISTINCT h, 0::BIGINT, '', '', 0::BIGINT, []::STRUCT(p VARCHAR, ts BIGINT)[], NULL::VARCHAR, false, []::STRUCT(p VARCHAR, ts BIGINT)[] FROM w
  UNION ALL
  SELECT h, n, a, p, ts, expired, CASE WHEN a <> 'remove' AND len(rest) = 1 THEN rest[1].p END, a <> 'remove' AND len(rest) <> 1 AND len(rest) < len(alive),
    CASE WHEN a = 'remove' THEN list_append(alive, {'p': p, 'ts': ts}) WHEN len(rest) = 1 THEN [] ELSE rest END
  FROM (SELECT w.h, w.n, w.a, w.p, w.ts, list_filter(r.held, lambda x: w.ts - x.ts > 5) AS expired, list_filter(r.held, lambda x: w.ts - x.ts <= 5) AS alive, list_filter(r.held, lambda x: w.ts - x.ts <= 5 AND x.p <> w.p) AS rest FROM r JOIN w ON w.h = r.h AND w.n = r.n + 1)),
gone AS (SELECT h, unnest(expired) AS x FROM r UNION ALL SELECT h, unnest(held) AS x FROM r QUALIFY n = max(n) OVER (PARTITION BY h))"""


@query("w3_rename_replay", f"""WITH RECURSIVE {_TRACKED.replace("@UNTIL", "1000000000000")}
SELECT 'delete' AS action, x.p AS path, CAST(NULL AS VARCHAR) AS old_path, h AS content_hash, x.ts AS ts FROM gone
UNION ALL SELECT CASE WHEN old IS NULL THEN 'upsert' ELSE 'rename' END, p, old, h, ts FROM r WHERE n > 0 AND a <> 'remove'
UNION ALL SELECT 'cancelled', p, NULL, h, ts FROM r WHERE cancelled
UNION ALL SELECT 'touch', p, NULL, h, ts FROM c WHERE a = 'access'""")
def w3(spark, d):
    return rename_feed.replay(_close_changes(spark, d))


def _close_changes(spark, d) -> DataFrame:
    """The changes on a coarser clock, so that creates come within the window of removes."""
    return A.changes(spark, d).withColumn("ts", F.floor(F.col("ts") / 5000))


_FLUSH_AT = 341_300


@query("w4_expiry_flush", f"""WITH RECURSIVE {_TRACKED.replace("@UNTIL", str(_FLUSH_AT))} SELECT x.p AS path, h AS content_hash, x.ts AS ts FROM gone WHERE {_FLUSH_AT} - x.ts > 5""")
def w4_flush(spark, d):
    events = _close_changes(spark, d).where(F.col("ts") <= _FLUSH_AT)
    return rename_feed.replay(events, until=_FLUSH_AT).where("action = 'delete'").select("path", "content_hash", "ts")


@query("a2_duplicate_page", f"WITH {E}, g AS (SELECT content_hash, count(*) AS n, list_sort(list(path)) AS p FROM entities GROUP BY content_hash HAVING count(*) > 1) SELECT content_hash, n, array_to_string(p[1:3], ',') AS paths FROM g ORDER BY n DESC, content_hash LIMIT 20 OFFSET 1")
def a2_page(spark, d):
    return duplicates.duplicate_page(A.entities(spark, d), "/corpus", 20, 1, 3).withColumn("paths", F.array_join("paths", ","))


@query("w7_multi_root_ignore", f"WITH {E} SELECT path, CASE WHEN path LIKE '/corpus/src1/%' THEN path LIKE '%.de' WHEN path LIKE '/corpus/src2/%' THEN false ELSE true END AS ignored FROM entities")
def w7(spark, d):
    roots = spark.createDataFrame([("/corpus/src1", "a"), ("/corpus/src2", "b")], "root string, id string")
    e = A.entities(spark, d)
    own = find.longest_prefix(e, roots)
    sets = {"a": paths.IgnoreSet(rules=("*.de",), root="/corpus/src1"), "b": paths.IgnoreSet()}
    verdict = F.lit(True)
    for k, s in sets.items():
        verdict = F.when(F.col("id") == k, s.ignored(F.col("path"))).otherwise(verdict)
    return e.select("path").join(own, "path", "left").select("path", verdict.alias("ignored"))


@query("health", f"WITH {E}, {L}, {D}, x AS (SELECT count(*) AS n FROM entities a FULL JOIN listing b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size_bytes <> b.size_bytes OR a.content_hash <> b.content_hash) SELECT (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM entities WHERE lifecycle = 'dead') AS n_dead, (SELECT n FROM x) AS n_diff, (SELECT count(*) FROM doc_relations) AS n_relations, (SELECT count(*) FROM embeddings) AS n_vectors, 'warn' AS status")
def health(spark, d):
    return diff.health(A.entities(spark, d), A.document_relations(spark, d), A.vectors(spark, d), A.listing(spark, d))


@query("j4_fusion", f"""WITH {_HYBRID.replace("LIMIT 40", "LIMIT 25")} SELECT path, round(vs, 6) AS vector_score, round(rank, 6) AS fts_rank, round(coalesce(vs * 0.7, 0) + CASE WHEN rank IS NULL THEN 0 ELSE 0.3 / (1 + abs(rank)) END, 6) AS score, source FROM h""")
def j4(spark, d):
    v = search.knn(_document_vectors(spark, d), _query_vector(spark, d), 25)
    f = search.fts_search(search.fts_rows(A.content(spark, d)), "that with", 25)
    got = search.fused(v, f, norm="abs")
    return got.select("path", *[F.round(c, 6).alias(c) for c in ("vector_score", "fts_rank", "score")], "source")


@query("r5_stale_copies", f"WITH {E}, {D} SELECT from_path, to_path, kind FROM doc_relations WHERE from_path IN (SELECT path FROM entities WHERE lifecycle = 'dead') OR to_path IN (SELECT path FROM entities WHERE lifecycle = 'dead')")
def r5(spark, d):
    return graph.stale_relations(A.document_relations(spark, d), A.entities(spark, d).where("lifecycle <> 'dead'"))


@query("r6_dangling_clean", f"WITH {E}, {D}, k AS (SELECT path FROM entities WHERE size_bytes > 500) SELECT 'stale' AS what, from_path AS path, to_path AS other FROM doc_relations WHERE from_path NOT IN (SELECT path FROM k) OR to_path NOT IN (SELECT path FROM k)")
def r6(spark, d):
    e = A.entities(spark, d).where("size_bytes > 500")
    return maintain.clean_plan(e, A.document_relations(spark, d), A.listing(spark, d), NOW, stale_only=True)


@query("o5_impact_order", f"WITH RECURSIVE {R}, w AS (SELECT '/region/2' AS path, 0 AS depth UNION SELECT r.from_path, w.depth + 1 FROM w JOIN relations r ON r.to_path = w.path WHERE w.depth < 2), m AS (SELECT path, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY path) SELECT row_number() OVER (ORDER BY depth, path) AS nth, path, CAST(depth AS INTEGER) AS depth FROM m ORDER BY depth, path LIMIT 200")
def o5(spark, d):
    from loam.plans.session_api import Session

    from pyspark.sql import Window

    s = Session(A.entities(spark, d), A.relations(spark, d), spark.createDataFrame([], HISTORY))
    page = s.get_impact("/region/2", 2)[0].select("path", "depth").limit(200)
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("depth", "path"))  # of a page
    return page.select(nth.cast("long").alias("nth"), "path", "depth")


@query("x4_dot_document", f"""WITH {E}, {D} SELECT 'digraph files {{' AS line UNION ALL SELECT '  "' || path || '";' FROM entities UNION ALL SELECT '  "' || from_path || '" -> "' || to_path || '" [label="' || kind || '"];' FROM doc_relations UNION ALL SELECT '}}'""")
def x4(spark, d):
    to = scratch_path(spark, "export") + "/all.dot"
    export.write("dot", A.entities(spark, d), A.document_relations(spark, d), to)
    return spark.read.text(to).withColumnRenamed("value", "line")


@query("u1_set_differences", f"WITH {E}, {L} SELECT 'new' AS side, path FROM listing WHERE path NOT IN (SELECT path FROM entities) UNION ALL SELECT 'deleted', path FROM entities WHERE path NOT IN (SELECT path FROM listing)")
def u1(spark, d):
    e, disk = A.entities(spark, d).select("path"), A.listing(spark, d).select("path")
    new, gone = disk.join(e, "path", "left_anti"), e.join(disk, "path", "left_anti")
    return new.select(F.lit("new").alias("side"), "path").union(gone.select(F.lit("deleted").alias("side"), "path"))


@query("u4_still_valid", f"WITH {E}, {L} SELECT path FROM entities WHERE path IN (SELECT path FROM listing)")
def u4(spark, d):
    return A.entities(spark, d).select("path").join(A.listing(spark, d).select("path"), "path", "left_semi")


@query("q12_inline_query", f"WITH {E} SELECT path FROM entities WHERE lifecycle = 'active' AND extension = 'en' AND modified_at > 1693526400")
def q12(spark, d):
    p = query_language.parse("state:active ext:.en modified>2023-09-01")
    return A.entities(spark, d).where(find.build_filter(p.state, p.extension, p.created_after, p.modified_after).condition()).select("path")


@query("z4_truncate_bytes", f"WITH {C} SELECT path, substr(content, 1, list_max(list_filter(range(0, 102), lambda k: strlen(substr(content, 1, k)) <= 101))) AS cut FROM content")
def z4(spark, d):
    return A.content(spark, d).select("path", Z.truncate_bytes(F.col("content"), 101).alias("cut"))


@query("z6_slug_and_id", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '! ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha256('/parts/' || p_partkey), 1, 12) AS id FROM part")
def z6(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", Z.unique_id(F.concat("p_name", F.lit("! "), "p_brand"), F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string"))).alias("id"))


@query("z17_query_summary", "SELECT r_regionkey, 'find  \"' || r_name || '\"  state:active  ext:e' || r_regionkey || '  modified>2024-01-0' || (r_regionkey + 1) || '  size>' || r_regionkey || 'mb  limit:20' AS summary FROM region")
def z17(spark, d):
    k = F.col("r_regionkey").cast("string")
    day = F.concat(F.lit("2024-01-0"), (F.col("r_regionkey") + 1).cast("string"))
    saved = table(spark, d, "region").select("r_regionkey", F.lit("find").alias("kind"), F.col("r_name").alias("query"), F.lit("active").alias("state"), F.concat(F.lit("e"), k).alias("extension"), day.alias("modified_after"), F.col("r_regionkey").alias("larger_than_mb"), F.lit(20).alias("limit"))
    return saved.select("r_regionkey", query_language.summary_of(saved).alias("summary"))


@query("z13_least_rotation", f"WITH {E} SELECT path, least(path || ',' || name, name || ',' || path) AS key FROM entities")
def z13(spark, d):
    return A.entities(spark, d).select("path", F.array_join(Z.least_rotation(F.array("path", "name")), ",").alias("key"))


@query("z14_risk", f"WITH {E}, h AS (SELECT extension, source, count(*) AS n FROM (SELECT extension, split_part(path, '/', 3) AS source FROM entities) GROUP BY ALL) SELECT extension, source, CASE WHEN n = 0 THEN 'none' WHEN n <= 3 THEN 'low' WHEN n <= 10 THEN 'medium' ELSE 'high' END AS risk FROM h")
def z14(spark, d):
    n = A.entities(spark, d).groupBy("extension", F.split("path", "/")[2].alias("source")).agg(F.count("*").alias("n"))
    return n.select("extension", "source", Z.risk_level(F.col("n")).alias("risk"))
