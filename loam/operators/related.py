"""Related tests, test commands and change plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.scalars import basename, stem

# What makes a path a likely test.
TEST_DIRS = ("/tests/", "/test/")
TEST_ENDINGS = ("_test.rs", "_tests.rs", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", ".test.js", ".spec.js")
STEM_SHAPES = ("{}_test", "{}_tests", "test_{}", "{}.test", "{}.spec")


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def is_test_path(path: Column) -> Column:
    whole = F.lower(F.translate(path, "\\", "/"))
    name = F.lower(basename(path))
    return _any([F.contains(whole, F.lit(d)) for d in TEST_DIRS] + [name.startswith("test_")] + [name.endswith(e) for e in TEST_ENDINGS])


def has_stem(path: Column, source: Column) -> Column:
    low, s = F.lower(path), F.lower(source)
    return (s != "") & _any([F.contains(low, F.concat(*[s if x == "{}" else F.lit(x) for x in _cut(shape)])) for shape in STEM_SHAPES])


def _cut(shape: str) -> list[str]:
    before, after = shape.split("{}")
    return [x for x in (before, "{}", after) if x]


def same_area(source: Column, test: Column) -> Column:
    """A non-empty part among the source's first four is among the test's first six."""
    head = F.filter(F.slice(F.split(source, "/"), 1, 4), lambda p: p != "")
    return F.arrays_overlap(head, F.slice(F.split(test, "/"), 1, 6))


def related_tests(entities: DataFrame, relations: DataFrame, inputs: list[str], limit: int = 10) -> DataFrame:
    """``path, score, reasons``: likely tests of the inputs, best first.

    ``inputs`` are a stated, short list; the entities are read once for all of them.
    """
    spark = entities.sparkSession
    asked = F.broadcast(spark.createDataFrame([(i,) for i in dict.fromkeys(inputs)], "input string"))
    tests = entities.where(is_test_path(F.col("path"))).select("path")
    base = tests.select("path", F.lit(1).alias("score"), F.lit("test file").alias("reason"))
    pairs = tests.join(asked, F.col("path") != F.col("input"))
    name = pairs.where(has_stem(F.col("path"), stem(basename(F.col("input"))))).select("path", F.lit(10).alias("score"), F.lit("name match").alias("reason"))
    area = pairs.where(same_area(F.col("input"), F.col("path"))).select("path", F.lit(4).alias("score"), F.lit("same area").alias("reason"))
    into = relations.join(asked.withColumnRenamed("input", "to_path"), "to_path").where(is_test_path(F.col("from_path")))
    into = into.select(F.col("from_path").alias("path"), F.lit(15).alias("score"), F.concat("kind", F.lit(" planned file")).alias("reason"))
    out = relations.join(asked.withColumnRenamed("input", "from_path"), "from_path").where(is_test_path(F.col("to_path")))
    out = out.select(F.col("to_path").alias("path"), F.lit(8).alias("score"), F.concat(F.lit("linked by "), "kind").alias("reason"))
    parts = base.union(name).union(area).union(into).union(out)
    ranked = parts.groupBy("path").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return ranked.orderBy(F.col("score").desc(), "path").limit(max(limit, 1))


# The test command of a kind of project, by file ending and by manifest.
TEST_COMMANDS = {(".rs", "Cargo.toml"): "cargo test --workspace --all-targets", (".py", "pyproject.toml"): "uv run --group dev pytest"}


def test_commands(paths: list[str], manifests: tuple[str, ...] = ()) -> list[str]:
    """Commands by the endings of paths or the manifests that are there."""
    return sorted(c for (ending, manifest), c in TEST_COMMANDS.items() if manifest in manifests or any(p.endswith(ending) for p in paths))


def test_command(path: Column) -> Column:
    """The same for a column of paths: each one's command by its ending, null if it has none."""
    out = F.lit(None).cast("string")
    for (ending, _), c in TEST_COMMANDS.items():
        out = F.when(path.endswith(ending), c).otherwise(out)
    return out
