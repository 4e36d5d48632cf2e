"""File sources: listings, the entity constructor, text extraction, import edges, git metadata."""

from __future__ import annotations

import io
import mimetypes
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.scalars import basename, extension, parent
from loam.operators.lifecycle import compute_state
from loam.schema import ARCHIVE_DAYS, DORMANT_DAYS, FALLBACK_TEXT_BYTES, MAX_FILE_BYTES, MAX_TEXT_CHARS
from loam.sources import tree
from loam.sources.paths import IGNORED_SEGMENTS, IgnoreSet

# Extensions that are read as text.
CODE_EXTENSIONS = (
    "py", "rs", "ts", "tsx", "js", "jsx", "go", "java", "c", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "kt", "sh", "bash", "zsh", "fish",
    "toml", "yaml", "yml", "json", "xml", "sql", "graphql", "md", "rst", "txt", "css", "scss", "html", "dockerfile", "makefile",
)


def binary_listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, created_at, modified_at, accessed_at, size_bytes, error, content`` of a tree.

    The executors list and read it (``sources.tree``). What needs no contents takes ``stat_listing``.
    """
    return tree.with_content(tree.listing(spark, root))


def stat_listing(spark: SparkSession, root: str, ignore: IgnoreSet | None = None) -> DataFrame:
    """The same without contents; folders that ``ignore`` leaves out by their name aren't entered."""
    return tree.listing(spark, root, (*IGNORED_SEGMENTS, *ignore.extra_segments) if ignore else ())


def content_hash(content: Column, size: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    return F.when(size > max_bytes, F.concat(F.lit("size:"), size.cast("string"))).otherwise(F.sha2(content.cast("binary"), 256))


def to_entities(listing: DataFrame, now: int, ignore: IgnoreSet | None = None, git: DataFrame | None = None, dormant: int = DORMANT_DAYS, archive: int = ARCHIVE_DAYS, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Entity rows of a listing: not ignored, not above the size bound, without an error.

    A listing without contents has its files hashed in blocks, after all filters.
    """
    rows = listing.where(~ignore.ignored(F.col("path"))) if ignore else listing
    rows = rows.where(F.col("size_bytes") <= max_bytes)
    if "error" in rows.columns:
        rows = rows.where(F.col("error").isNull())
    digest = content_hash(F.col("content"), F.col("size_bytes"), max_bytes) if "content" in rows.columns else tree.file_hash(F.col("path"), F.col("size_bytes"), max_bytes)
    rows = rows.select("path", "created_at", "modified_at", "accessed_at", "size_bytes", digest.alias("content_hash"))
    if git is not None:
        g = git.select("path", F.col("created_at").alias("_c"), F.col("modified_at").alias("_m"), F.col("author").alias("git_author"))
        rows = rows.join(g, "path", "left").withColumn("created_at", F.coalesce("_c", "created_at")).withColumn("modified_at", F.coalesce("_m", "modified_at")).drop("_c", "_m")
    else:
        rows = rows.withColumn("git_author", F.lit(None).cast("string"))
    name = basename(F.col("path"))
    return rows.select(
        F.uuid().alias("id"), "path", name.alias("name"), extension(name).alias("extension"), "size_bytes", "created_at", "modified_at", "accessed_at",
        compute_state(F.col("accessed_at"), now, dormant, archive).alias("lifecycle"), "content_hash", F.lit(None).cast("string").alias("summary"), "git_author",
    )


def scan_stats(listing: DataFrame, ignore: IgnoreSet | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One row: total, indexed, skipped, errors. Contents aren't read."""
    rows = listing.where(~ignore.ignored(F.col("path"))) if ignore else listing
    error = F.col("error").isNotNull() if "error" in listing.columns else F.lit(False)
    large = ~error & (F.col("size_bytes") > max_bytes)
    return rows.agg(F.count("*").alias("total"), F.count_if(~large & ~error).alias("indexed"), F.count_if(large).alias("skipped"), F.count_if(error).alias("errors"))


def text_extension(path: Column) -> Column:
    """Whether the name says that a file is text."""
    ext = F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))
    text = [e.lstrip(".") for e, t in mimetypes.types_map.items() if t.startswith("text/")]
    return ext.isin(*sorted({*CODE_EXTENSIONS, *text}))


def _pdf_text(data: bytes) -> str:
    import pypdf

    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)


def _text(data: bytes | None, text: bool, pdf: bool) -> tuple[str | None, str | None]:
    """(text, error) of one file: both null if it has no text, an error if it can't be read as what it says it is."""
    if data is None:
        return None, None
    data = bytes(data)
    if text:
        return data.decode("utf-8", "ignore"), None
    if pdf:
        try:
            return _pdf_text(data), None
        except ImportError:
            return None, "pypdf is not installed"
        except Exception as e:  # whatever a broken file makes the reader raise
            return None, f"{type(e).__name__}: {e}"
    if len(data) < FALLBACK_TEXT_BYTES:
        try:
            return data.decode("utf-8"), None
        except UnicodeDecodeError:
            return None, None
    return None, None


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _decoded(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text and error of (content, reads as text, is PDF)."""
    for content, text, pdf in rows:
        got = [_text(*x) for x in zip(content, text, pdf)]
        yield pd.DataFrame({"text": pd.Series([t for t, _ in got], dtype=object), "error": pd.Series([e for _, e in got], dtype=object)})


def extracted(path: Column, content: Column) -> Column:
    """``text, error`` of a file: a file that can't be read is a row with an error and not a failed run."""
    return _decoded(content, text_extension(path), F.lower(path).endswith(".pdf"))


def extract_text(path: Column, content: Column) -> Column:
    """Up to 32,000 characters of a file's text, null if it has none or can't be read."""
    return F.substring(extracted(path, content)["text"], 1, MAX_TEXT_CHARS)


def text_of(content: Column) -> Column:
    """The same for a column that is text already."""
    return F.substring(content, 1, MAX_TEXT_CHARS)


def _normal(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` components."""

    def step(acc, part):
        return F.when(part == ".", acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def _candidates(files: DataFrame) -> DataFrame:
    """``from_path, nth, rank, candidate, kind``: possible targets of every import, best rank first."""
    f = files.select("path", "content", parent(F.col("path")).alias("dir"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"))

    def matches(lang, pattern: str, group: int):
        return f.where(lang).select("path", "dir", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(group))).alias("nth", "m"))

    py, rs, ts = F.col("ext") == "py", F.col("ext") == "rs", F.col("ext").isin("ts", "tsx", "js", "jsx")
    up = F.sequence(F.lit(0), F.lit(5))

    def walk_up(rows: DataFrame, module: Column) -> DataFrame:
        """The module as a file, then as a package, in the directory and up to five above it."""
        base = rows.select("path", "nth", "anchor", F.regexp_replace(module, r"\.", "/").alias("m"), F.explode(up).alias("level")).where(F.col("m") != "")
        at = base.withColumn("root", F.array_join(F.slice(F.split("anchor", "/"), F.lit(1), F.greatest(F.size(F.split("anchor", "/")) - F.col("level"), F.lit(1))), "/"))
        return at.select("path", "nth", F.col("level"), F.posexplode(F.array(F.concat_ws("/", "root", F.concat("m", F.lit(".py"))), F.concat_ws("/", "root", "m", F.lit("__init__.py")))).alias("form", "candidate")).select(
            F.col("path").alias("from_path"), "nth", (F.col("level") * 2 + F.col("form")).alias("rank"), "candidate", F.lit("imports").alias("kind")
        )

    rel = f.where(py).select("path", "dir", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(from\s+\.+[\w.]*\s+import\s+[\w*]+(?:\s*,\s*[\w*]+)*)"), F.lit(1))).alias("nth", "line"))
    rel = rel.select("path", "dir", "nth", F.regexp_extract("line", r"from\s+(\.+)", 1).alias("dots"), F.regexp_extract("line", r"from\s+\.+([\w.]*)\s", 1).alias("module"), F.regexp_extract("line", r"(?s)\simport\s+(.*)$", 1).alias("names"))
    parts = F.split("dir", "/")
    rel = rel.withColumn("anchor", F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.length("dots") + 1, F.lit(1))), "/"))
    package = walk_up(rel.where(F.col("module") != ""), F.col("module"))
    named = rel.withColumn("anchor", F.when(F.col("module") == "", F.col("anchor")).otherwise(F.concat_ws("/", "anchor", F.regexp_replace("module", r"\.", "/"))))
    named = named.select("path", "anchor", F.col("nth").alias("line"), F.posexplode(F.split("names", ",")).alias("i", "name")).withColumn("nth", F.lit(1_000) + F.col("line") * 100 + F.col("i")).withColumn("name", F.regexp_replace("name", r"\s+", ""))
    names = walk_up(named.where(F.col("name").rlike(r"^\w+$")), F.col("name"))
    # What counts as an import in each language, which edges depend on to the letter.
    absolute = matches(py, r"(?m)^\s*from\s+([A-Za-z][\w.]*)\s+import", 1).withColumn("nth", F.col("nth") + 1_000_000)
    bare = matches(py, r"(?m)^\s*import\s+([A-Za-z][\w.]*)", 1).withColumn("nth", F.col("nth") + 2_000_000)
    plain = walk_up(absolute.union(bare).withColumn("anchor", F.col("dir")), F.col("m"))
    mods = matches(rs, r"(?m)^\s*mod\s+(\w+)\s*;", 1).select(F.col("path").alias("from_path"), "nth", F.posexplode(F.array(F.concat("dir", F.lit("/"), "m", F.lit(".rs")), F.concat("dir", F.lit("/"), "m", F.lit("/mod.rs")))).alias("rank", "candidate"), F.lit("mod").alias("kind"))
    specs = matches(ts, r"""(?m)(?:import|export)\s+.*?from\s+['"]([^'"]+)['"]""", 1).union(matches(ts, r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""", 1).withColumn("nth", F.col("nth") + 1_000_000))
    target = specs.where(F.col("m").startswith(".")).withColumn("base", _normal(F.concat_ws("/", "dir", "m")))
    endings = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")  # fixed values, in order
    scripts = target.select(F.col("path").alias("from_path"), "nth", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in endings])).alias("rank", "candidate"), F.lit("imports").alias("kind"))
    return package.unionByName(names).unionByName(plain).unionByName(mods).unionByName(scripts)


def import_edges(files: DataFrame, known: DataFrame) -> DataFrame:
    """``from_path, to_path, kind`` of ``files(path, content)``: each import's best target among ``known(path)``."""
    met = _candidates(files).join(known.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = met.groupBy("from_path", "nth", "kind").agg(F.min_by("candidate", "rank").alias("to_path"))
    return best.select("from_path", "to_path", "kind").distinct()


def href_edges(pages: DataFrame) -> DataFrame:
    """``from_path, to_path, kind`` of the links in HTML pages, not resolved."""
    return pages.select(F.col("url").alias("from_path"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("to_path"), F.lit("links").alias("kind")).distinct()


def git_metadata(commits: DataFrame) -> DataFrame:
    """``path, created_at, modified_at, author`` from ``commits(path, nth, ts, author)``, the newest first (nth 0).

    The author is the most frequent one, ties to the smallest name; a path with a broken line (null
    time or author) has no metadata.
    """
    broken = commits.where(F.col("ts").isNull() | F.col("author").isNull()).select("path").distinct()
    good = commits.join(broken, "path", "left_anti")
    span = good.groupBy("path").agg(F.max_by("ts", "nth").alias("created_at"), F.min_by("ts", "nth").alias("modified_at"))
    n = good.groupBy("path", "author").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.col("n").desc(), "author"))).where(F.col("r") == 1)
    return span.join(top.select("path", "author"), "path")


def index_run(entities: DataFrame, vectors: DataFrame, texts: DataFrame, content: DataFrame, ignore: IgnoreSet, sensitive: Column) -> DataFrame:
    """``path, outcome`` of an incremental run: ignored, sensitive, up_to_date, error, no_text or indexed.

    ``content`` has ``path, content`` and, if files were read for it, the ``error`` of each.
    """
    v = vectors.select("path", "content_hash", F.lit(True).alias("_v")).distinct()
    t = texts.select("path", F.lit(True).alias("_t")).distinct()
    read = content.select("path", "content", (F.col("error") if "error" in content.columns else F.lit(None).cast("string")).alias("_e"))
    rows = entities.join(v, ["path", "content_hash"], "left").join(t, "path", "left").join(read, "path", "left")
    outcome = (
        F.when(ignore.ignored(F.col("path")), "ignored")
        .when(sensitive.isNotNull(), "sensitive")
        .when(F.col("_v").isNotNull() & F.col("_t").isNotNull(), "up_to_date")
        .when(F.col("_e").isNotNull(), "error")
        .when(F.col("content").isNull() | (F.trim("content") == ""), "no_text")
        .otherwise("indexed")
    )
    return rows.select("path", outcome.alias("outcome"), F.when(outcome == "error", F.col("_e")).alias("error"))


def run_stats(outcomes: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return outcomes.agg(F.count("*").alias("total"), F.count_if(o == "indexed").alias("indexed"), F.count_if(o.isin("up_to_date", "no_text", "ignored", "sensitive")).alias("skipped"), F.count_if(o == "sensitive").alias("sensitive_skipped"), F.count_if(o == "error").alias("errors"))
