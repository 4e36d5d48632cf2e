"""The given tables as the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.lifecycle import compute_state
from loam.schema import DAY, ENTITY_COLUMNS, NOW
from loam.session import table

EDGE_ROWS = 250_000


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities; those labelled toxic are dead (not on disk)."""
    d = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    created = F.lit(NOW) - DAY * (180 + F.col("doc_id") % 180)
    accessed = F.lit(NOW) - DAY * ((F.col("doc_id") * 37) % 150)
    rows = d.join(toxic, "doc_id", "left")
    return rows.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("name"),
        F.col("lang").alias("extension"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        created.alias("created_at"),
        (created + DAY * (F.col("n_chars") % 120)).alias("modified_at"),
        accessed.alias("accessed_at"),
        F.when(F.col("toxic") == 1, "dead").otherwise(compute_state(accessed, NOW)).alias("lifecycle"),
        F.sha2(F.col("text"), 256).alias("content_hash"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("git_author"),
    )


ENTITIES_SQL = f"""
entities AS (
  SELECT 'doc-' || d.doc_id AS id, '/corpus/' || source || '/' || d.doc_id || '.' || lang AS path, d.doc_id || '.' || lang AS name, lang AS extension,
    CAST(strlen(text) AS BIGINT) AS size_bytes, {NOW} - {DAY} * (180 + d.doc_id % 180) AS created_at,
    {NOW} - {DAY} * (180 + d.doc_id % 180) + {DAY} * (n_chars % 120) AS modified_at, {NOW} - {DAY} * ((d.doc_id * 37) % 150) AS accessed_at,
    CASE WHEN toxic = 1 THEN 'dead' WHEN (d.doc_id * 37) % 150 <= 30 THEN 'active' WHEN (d.doc_id * 37) % 150 <= 90 THEN 'dormant' ELSE 'archived' END AS lifecycle,
    sha256(text) AS content_hash, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS git_author
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"""


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, name, content`` of the documents."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("name"),
        F.col("text").alias("content"),
    )


CONTENT_SQL = "content AS (SELECT '/corpus/' || source || '/' || doc_id || '.' || lang AS path, doc_id || '.' || lang AS name, text AS content FROM documents)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later state of the disk, as entities: toxic documents are gone, those of low quality were
    edited, and the pages came in as files."""
    low = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = F.substring("id", 5, 20).cast("long")
    old = entities(spark, sf_dir).where(F.col("lifecycle") != "dead").withColumn("doc_id", ids).join(low, "doc_id", "left")
    edited = F.coalesce(F.col("quality") == 0, F.lit(False))
    old = old.withColumn("size_bytes", F.when(edited, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    old = old.withColumn("content_hash", F.when(edited, F.sha2(F.col("content_hash"), 256)).otherwise(F.col("content_hash")))
    old = old.withColumn("accessed_at", F.when(edited, F.lit(NOW).cast("long")).otherwise(F.col("accessed_at"))).withColumn("lifecycle", F.when(edited, "active").otherwise(F.col("lifecycle")))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("/corpus/web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.lit("html").alias("extension"), F.octet_length("html").cast("long").alias("size_bytes"),
        F.lit(NOW).cast("long").alias("created_at"), F.lit(NOW).cast("long").alias("modified_at"), F.lit(NOW).cast("long").alias("accessed_at"), F.lit("active").alias("lifecycle"),
        F.sha2(F.col("html"), 256).alias("content_hash"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("git_author"),
    )
    return old.select(*ENTITY_COLUMNS).unionByName(pages)


LISTING_SQL = f"""
listing AS (
  SELECT id, path, name, extension, CASE WHEN quality = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, created_at, modified_at,
    CASE WHEN quality = 0 THEN {NOW} ELSE accessed_at END AS accessed_at, CASE WHEN quality = 0 THEN 'active' ELSE lifecycle END AS lifecycle,
    CASE WHEN quality = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash, summary, git_author
  FROM entities LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = CAST(substr(id, 5) AS BIGINT)
  WHERE lifecycle <> 'dead'
  UNION ALL
  SELECT 'page-' || page_id, '/corpus/web/' || page_id || '.html', page_id || '.html', 'html', CAST(strlen(html) AS BIGINT), {NOW}, {NOW}, {NOW}, 'active', sha256(html), NULL, NULL FROM pages)"""


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``old, new``: documents of low quality move to another folder."""
    low = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality") == 0)
    d = table(spark, sf_dir, "documents").join(low, "doc_id")
    key = F.col("doc_id").cast("string")
    return d.select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), key, F.lit("."), "lang").alias("old"), F.concat(F.lit("/attic/"), key, F.lit(".txt")).alias("new"))


RENAMES_SQL = """
renames AS (SELECT '/corpus/' || source || '/' || doc_id || '.' || lang AS old, '/attic/' || doc_id || '.txt' AS new
  FROM documents JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 0) USING (doc_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("/vec/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string")).alias("path"), F.col("embedding").alias("vector"))


VECTORS_SQL = "vectors AS (SELECT '/vec/' || label || '/' || vec_id AS path, embedding AS vector FROM embeddings)"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the trade tables: order to part and customer, customer and supplier to nation, nation to region."""

    def key(kind: str, col: str):
        return F.concat(F.lit(f"/{kind}/"), F.col(col).cast("string"))

    def rows(name: str, a: str, b: str) -> DataFrame:
        """Numbers of both ends, dealt to tasks of a bounded number of rows: a scan's grow with its files."""
        t = table(spark, sf_dir, name).select(a, b)
        n = -(-t.count() // EDGE_ROWS)
        return t.repartition(n, a, b) if n > 1 else t

    def edges(pairs: DataFrame, a, b, kind: str) -> DataFrame:
        return pairs.select(a.alias("from_path"), b.alias("to_path"), F.lit(kind).alias("kind"), F.lit(NOW).cast("long").alias("created_at"))

    parts = [
        # numbers are told apart before paths are made of them
        edges(rows("lineitem", "l_orderkey", "l_partkey").distinct(), key("order", "l_orderkey"), key("part", "l_partkey"), "contains"),
        edges(rows("orders", "o_orderkey", "o_custkey"), key("order", "o_orderkey"), key("customer", "o_custkey"), "placed_by"),
        edges(rows("customer", "c_custkey", "c_nationkey"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "in"),
        edges(rows("supplier", "s_suppkey", "s_nationkey"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "in"),
        edges(table(spark, sf_dir, "nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "in"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RELATIONS_SQL = f"""
relations AS (
  SELECT DISTINCT '/order/' || l_orderkey AS from_path, '/part/' || l_partkey AS to_path, 'contains' AS kind, CAST({NOW} AS BIGINT) AS created_at FROM lineitem
  UNION ALL SELECT '/order/' || o_orderkey, '/customer/' || o_custkey, 'placed_by', {NOW} FROM orders
  UNION ALL SELECT '/customer/' || c_custkey, '/nation/' || c_nationkey, 'in', {NOW} FROM customer
  UNION ALL SELECT '/supplier/' || s_suppkey, '/nation/' || s_nationkey, 'in', {NOW} FROM supplier
  UNION ALL SELECT '/nation/' || n_nationkey, '/region/' || n_regionkey, 'in', {NOW} FROM nation)"""


def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``duplicate_of`` between a document and the first with its content, both ways."""
    e = entities(spark, sf_dir).select("path", "content_hash")
    first = e.groupBy("content_hash").agg(F.min("path").alias("first"))
    away = e.join(first, "content_hash").where("path <> first").select(F.col("path").alias("from_path"), F.col("first").alias("to_path"), F.lit("duplicate_of").alias("kind"), F.lit(NOW).cast("long").alias("created_at"))
    return away.unionByName(away.select(F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"), F.lit("has_copy").alias("kind"), "created_at"))


DOCUMENT_RELATIONS_SQL = f"""
doc_relations AS (
  SELECT path AS from_path, first AS to_path, 'duplicate_of' AS kind, CAST({NOW} AS BIGINT) AS created_at FROM entities JOIN (SELECT content_hash, min(path) AS first FROM entities GROUP BY content_hash) USING (content_hash) WHERE path <> first
  UNION ALL
  SELECT first, path, 'has_copy', {NOW} FROM entities JOIN (SELECT content_hash, min(path) AS first FROM entities GROUP BY content_hash) USING (content_hash) WHERE path <> first)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file changes of a user's folder: the hash is the number in the properties."""
    e = table(spark, sf_dir, "events")
    action = F.create_map(*[F.lit(x) for kv in {"signup": "create", "view": "access", "click": "modify", "error": "remove", "purchase": "rename_to"}.items() for x in kv])
    return e.select("event_id", F.unix_timestamp("ts").alias("ts"), action[F.col("event_type")].alias("action"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.lit(None).cast("string").alias("new_path"), F.concat(F.lit("h"), F.get_json_object("props", "$.k")).alias("content_hash"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits to a customer's file, the newest first; the priority is the author."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("/customer/"), F.col("o_custkey").cast("string")).alias("path"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("author"), "o_orderkey")
    return o.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(F.col("ts").desc(), F.col("o_orderkey").desc())) - 1).drop("o_orderkey")
