"""Entities, filters, lifecycle, duplicates and maintenance on small fixtures."""

import pytest
from pyspark.sql import functions as F

from loam.functions import scalars as Z
from loam.operators import diff, duplicates, find, lifecycle, maintain
from loam.schema import DAY, HISTORY, RELATION


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("days,state", [(0, "active"), (1, "active"), (30, "active"), (31, "dormant"), (90, "dormant"), (91, "archived"), (-5, "active")])
def test_lifecycle_bounds(spark, days, state):
    now = 1_000_000_000
    assert one(spark, lifecycle.compute_state(F.lit(now - days * DAY), now)) == state


@pytest.mark.parametrize("days,state", [(7, "active"), (8, "dormant"), (15, "archived")])
def test_lifecycle_custom(spark, days, state):
    now = 1_000_000_000
    assert one(spark, lifecycle.compute_state(F.lit(now - days * DAY), now, 7, 14)) == state


def test_upsert_keeps_identity_and_writes_history(spark, entity_rows):
    old = entity_rows(("/a.rs", "h1", "active", {"id": "A", "summary": "s"}), ("/b.rs", "h2"))
    new = entity_rows(("/a.rs", "h9", "dormant", {"id": "Z", "created_at": 5}), ("/c.rs", "h3"))
    rows = {r["path"]: r for r in maintain.upsert(old, new).collect()}
    assert set(rows) == {"/a.rs", "/b.rs", "/c.rs"}
    a = rows["/a.rs"]
    assert (a["id"], a["summary"], a["created_at"], a["lifecycle"], a["content_hash"]) == ("A", "s", 1_000_000, "dormant", "h9")
    events = [(r["path"], r["event"]) for r in maintain.upsert_history(old, new, 7).orderBy("path", "seq").collect()]
    assert events == [("/a.rs", "lifecycle"), ("/a.rs", "modified"), ("/c.rs", "created")]


def test_upsert_twice_is_idempotent(spark, entity_rows):
    new = entity_rows(("/a.rs", "h1"))
    once = maintain.upsert(new.limit(0), new)
    assert maintain.upsert(once, new).count() == 1
    assert maintain.upsert_history(once, new, 7).count() == 0


def test_rename_moves_everything(spark, entity_rows):
    e = entity_rows(("/a.rs", "h1", "dormant", {"summary": "s"}), ("/x.rs", "h2"))
    r = spark.createDataFrame([("/a.rs", "/x.rs", "imports", 1), ("/x.rs", "/a.rs", "imports", 1)], RELATION)
    h = maintain.upsert_history(e.limit(0), e, 1)
    m = spark.createDataFrame([("/a.rs", "/b.py")], "old string, new string")
    e2, r2, h2 = maintain.rename(e, r, h, m, 9)
    row = e2.where("path = '/b.py'").first()
    assert (row["id"], row["name"], row["extension"], row["lifecycle"], row["summary"]) == ("id:/a.rs", "b.py", "py", "dormant", "s")
    assert {(x["from_path"], x["to_path"]) for x in r2.collect()} == {("/b.py", "/x.rs"), ("/x.rs", "/b.py")}
    assert sorted(x["event"] for x in h2.where("path = '/b.py'").collect()) == ["created", "renamed"]
    assert h2.where("path = '/a.rs'").count() == 0


def test_rename_conflict_and_missing(spark, entity_rows):
    e = entity_rows(("/a.rs", "h1", "active", {"summary": "old"}), ("/b.rs", "h2", "active", {"summary": "victim"}))
    m = spark.createDataFrame([("/a.rs", "/b.rs"), ("/nope", "/c")], "old string, new string")
    out = {r["old"]: r["outcome"] for r in maintain.rename_outcome(e, m).collect()}
    assert out == {"/a.rs": "conflict_resolved", "/nope": "old_not_found"}
    r = spark.createDataFrame([("/b.rs", "/z", "imports", 1)], RELATION)
    e2, r2, _ = maintain.rename(e, r, spark.createDataFrame([], HISTORY), m, 9)
    assert [x["summary"] for x in e2.collect()] == ["old"]
    assert r2.count() == 0


def test_rename_chains(spark):
    m = spark.createDataFrame([(f"/{i}", f"/{i + 1}") for i in range(9)] + [("/p", "/q"), ("/q", "/p")], "old string, new string")
    out = {r["old"]: r["new"] for r in maintain.resolve_renames(m).collect()}
    assert all(out[f"/{i}"] == "/9" for i in range(9))


def test_delete_dead_cascades(spark, entity_rows):
    e = entity_rows(("/a", "h", "dead"), ("/b", "h2"))
    r = spark.createDataFrame([("/b", "/a", "imports", 1), ("/b", "/b2", "imports", 1)], RELATION)
    left, edges, events = maintain.delete(e, r, spark.createDataFrame([], HISTORY), maintain.dead(e), 3)
    assert [x["path"] for x in left.collect()] == ["/b"]
    assert [x["to_path"] for x in edges.collect()] == ["/b2"]
    assert [(x["event"], x["old_lifecycle"]) for x in events.collect()] == [("deleted", "dead")]


def test_touch_only_forward(spark, entity_rows):
    e = entity_rows(("/a", "h"), ("/b", "h"))
    t = spark.createDataFrame([("/a", 2_000_000), ("/b", 5)], "path string, ts long")
    assert {r["path"]: r["accessed_at"] for r in maintain.touch(e, t).collect()} == {"/a": 2_000_000, "/b": 1_000_000}


def test_edges_are_a_set(spark):
    r = spark.createDataFrame([("/a", "/b", "imports", 5)], RELATION)
    out = maintain.upsert_edges(r, spark.createDataFrame([("/a", "/b", "imports", 9)], RELATION)).collect()
    assert [(x["kind"], x["created_at"]) for x in out] == [("imports", 5)]


def test_find_and_paging(spark, entity_rows):
    e = entity_rows(("/lab/tiny.csv", "a", "active", {"size_bytes": 1}), ("/lab/wide.csv", "b", "active", {"size_bytes": 5000}), ("/lab/wide.txt", "c", "active", {"size_bytes": 5000}))
    f = find.FindFilter(extension=".csv", larger_than=100)
    assert [r["path"] for r in find.find(e, f).collect()] == ["/lab/wide.csv"]
    page = find.FindFilter(limit=1, offset=1)
    assert len(find.find(e, page).collect()) == 1 and find.count_find(e, page).first()["n"] == 3
    with pytest.raises(ValueError):
        find.list_by_lifecycle(e, "asleep")


def test_scope_is_separator_aware(spark, entity_rows):
    e = entity_rows(("/a/b/x", "1"), ("/a/bc/x", "2"), ("/a/b", "3"))
    assert {r["path"] for r in e.where(find.in_scope(F.col("path"), "/a/b")).collect()} == {"/a/b/x", "/a/b"}
    assert find.narrowed_scope("/a", "/a/b") == "/a/b" and find.narrowed_scope("/a/b", "/a") == "/a/b"
    with pytest.raises(PermissionError):
        find.narrowed_scope("/a", "/b")


def test_duplicates_skip_pseudo_hashes(spark, entity_rows):
    e = entity_rows(("/c1", "deadbeef"), ("/c2", "deadbeef"), ("/u", "x"), ("/s1", "size:9"), ("/s2", "size:9"), ("/n1", None), ("/n2", None))
    out = duplicates.duplicate_groups(e).collect()
    assert [(r["content_hash"], r["n"], r["paths"]) for r in out] == [("deadbeef", 2, ["/c1", "/c2"])]


def test_diff(spark, entity_rows):
    stored = entity_rows(("/tracked", "a"), ("/deleted", "b"), ("/same", None))
    listed = entity_rows(("/tracked", "z"), ("/new", "c"), ("/same", None))
    assert {(r["status"], r["path"]) for r in diff.snapshot_diff(stored, listed).collect()} == {("changed", "/tracked"), ("deleted", "/deleted"), ("new", "/new")}


def test_reconcile(spark, entity_rows):
    e = entity_rows(("/new", "h1"), ("/d1", "h2"), ("/d2", "h2"), ("/there", "h3"))
    idx = spark.createDataFrame([("/old", "h1"), ("/old2", "h2"), ("/there", "h3"), ("/old4", "zz")], "path string, content_hash string")
    assert [(r["old"], r["new"]) for r in diff.reconcile_by_hash(idx, e).collect()] == [("/old", "/new")]
    assert diff.reconcile_by_hash(idx, e, "/elsewhere").count() == 0


@pytest.mark.parametrize("n,text", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (5 * 1024 * 1024, "5.0 MB"), (3 * 1024**3, "3.0 GB")])
def test_human_bytes(spark, n, text):
    assert one(spark, Z.human_bytes(F.lit(n))) == text


def test_scalars(spark):
    assert one(spark, Z.format_ts(F.lit(0))) == "1970-01-01 00:00 UTC"
    assert one(spark, Z.csv_field(F.lit('a"b'))) == '"a""b"'
    assert one(spark, Z.least_rotation(F.array(*[F.lit(x) for x in "cab"]))) == ["a", "b", "c"]
    assert one(spark, Z.extension(F.lit("a.tar.gz"))) == "gz" and one(spark, Z.extension(F.lit(".env"))) is None
    assert Z.parse_date("2026-01-02") == 1767312000
    with pytest.raises(ValueError):
        Z.parse_date("yesterday")
    for total, risk in [(0, "none"), (1, "low"), (3, "low"), (4, "medium"), (10, "medium"), (11, "high"), (100, "high")]:
        assert one(spark, Z.risk_level(F.lit(total))) == risk


@pytest.mark.parametrize("text,n", [("é" * 10, 5), ("abc", 5), ("a€b", 2), ("a€b", 3), ("a€b", 4), ("🎉🎉", 7), ("", 3)])
def test_truncate_bytes(spark, text, n):
    want = text.encode()[:n].decode("utf-8", "ignore")
    assert one(spark, Z.truncate_bytes(F.lit(text), n)) == want
