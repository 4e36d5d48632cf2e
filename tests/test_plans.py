"""Generations, ingest, workspaces and exports."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import export, graph, lifecycle, search
from loam.plans import ingest
from loam.plans import query_language as ql
from loam.plans.catalog import Catalog
from loam.plans.workspaces import Registry
from loam.schema import DAY, ENTITY, HISTORY, RELATION
from loam.session import cut, ensure_checkpoint_dir, scratch, stored
from loam.sources.paths import IgnoreSet


def test_generations(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    with pytest.raises(FileNotFoundError):
        c.read("a")
    assert c.commit(a=spark.range(3), b=spark.range(1)) == 1
    assert c.commit(a=c.read("a").where("id > 0")) == 2
    assert c.read("a").count() == 2 and c.read("b").count() == 1 and c.read("a", 1).count() == 3
    assert c.commit(b=spark.range(5)) == 3 and c.tables() == {"a": 2, "b": 3}  # what carries over isn't copied
    assert not (tmp_path / "cat" / "generation-00000003" / "a").exists()
    assert c.prune(1) == [1, 2] and c.generations() == [3]
    assert c.read("a").count() == 2 and not (tmp_path / "cat" / "generation-00000001").exists()


def test_scratch_owns_what_is_cut(spark, tmp_path):
    """Tables that a query has written on the way are gone when its scope ends; stored tables aren't copied."""
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    held = lambda: {n for n in os.listdir(shared) if n.startswith("cut-")}
    before = held()
    spark.range(10).withColumn("b", F.col("id").cast("string")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    with scratch(spark):
        outer = cut(table.groupBy("b").count())
        with scratch(spark):
            assert cut(outer).count() == 10 and len(held() - before) == 2
        assert len(held() - before) == 1 and outer.count() == 10
        assert stored(table.select("b").where("id > 3")).count() == 6 and len(held() - before) == 1
        assert stored(table.groupBy("b").count()).count() == 10 and len(held() - before) == 2
        hit = graph.reverse_deps(spark.createDataFrame([("a", "b", "k", 1)], RELATION), "b")
        assert [r["path"] for r in hit.collect()] == ["a"]
    assert held() == before


def test_rescan_is_idempotent_and_finds_renames(spark, entity_rows):
    now = 10_000_000
    content = lambda *rows: spark.createDataFrame([(p, now, now, now, len(t), bytearray(t.encode())) for p, t in rows], "path string, created_at long, modified_at long, accessed_at long, size_bytes long, content binary")
    e, r, h = entity_rows(("/x", "x")).limit(0), spark.createDataFrame([], RELATION), spark.createDataFrame([], HISTORY)
    e, r, h = ingest.rescan(e, r, h, content(("/a.rs", "one"), ("/b.rs", "two")), now)
    ids = {x["path"]: x["id"] for x in e.cache().collect()}
    e2, r2, h2 = ingest.rescan(e, r, h, content(("/moved.rs", "one"), ("/b.rs", "two")), now)
    rows = {x["path"]: x for x in e2.cache().collect()}
    assert rows["/moved.rs"]["id"] == ids["/a.rs"] and set(rows) == {"/moved.rs", "/b.rs"}
    assert sorted(x["event"] for x in h2.where("path = '/moved.rs'").collect()) == ["created", "renamed"]
    e3, _, h3 = ingest.rescan(e2, r2, h2, content(("/b.rs", "two")), now)
    assert {x["path"]: x["lifecycle"] for x in e3.collect()} == {"/moved.rs": "dead", "/b.rs": "active"}
    assert h3.where("event = 'lifecycle'").count() == 1


def test_index_once(spark, entity_rows):
    e = entity_rows(("/src/main.py", "hash_main"), ("/src/utils.py", "hash_utils"), ("/src/dead.py", "hash_dead", "dead"), ("/src/nohash.py", None), ("/src/.env", "h5"), ("/src/blank.py", "h6"))
    files = spark.createDataFrame([("/src/main.py", "from utils import x\n"), ("/src/utils.py", "x = 1"), ("/src/.env", "SECRET"), ("/src/blank.py", "  ")], "path string, content string")
    r = spark.createDataFrame([("/src/main.py", "/src/old.py", "imports", 1)], RELATION)
    texts = spark.createDataFrame([], "path string, name string, content string")
    vectors = spark.createDataFrame([], "path string, content_hash string, text_preview string, vector array<float>, indexed_at long")
    got = ingest.index_once(e, r, texts, vectors, files, 5, IgnoreSet())
    assert {x["path"]: x["outcome"] for x in got["outcomes"].collect()} == {"/src/main.py": "indexed", "/src/utils.py": "indexed", "/src/.env": "sensitive", "/src/blank.py": "no_text"}
    assert tuple(got["stats"].first()) == (4, 2, 2, 1, 0)
    assert got["texts"].count() == 2 and got["vectors"].count() == 2
    assert [(x["from_path"], x["to_path"]) for x in got["relations"].collect()] == [("/src/main.py", "/src/utils.py")]
    again = ingest.index_once(e, got["relations"], got["texts"], got["vectors"], files, 6)
    assert again["outcomes"].where("outcome = 'indexed'").count() == 0
    stale = got["vectors"].withColumn("path", F.when(F.col("path") == "/src/main.py", "/gone.py").otherwise(F.col("path")))
    assert ingest.index_once(e, r, got["texts"], stale, files, 7)["vectors"].where("path = '/src/main.py'").count() == 1


def test_index_run_isolates_errors(spark, entity_rows, tmp_path):
    """Bytes are read file by file: a broken PDF and a file that is gone are errors, the rest is indexed, in one commit."""
    e = entity_rows(("/s/a.py", "h1"), ("/s/broken.pdf", "h2"), ("/s/bad.bin", "h3"), ("/s/gone.py", "h4"), ("/s/.env", "h5"), ("/s/latin.txt", "h6"))
    files = [("/s/a.py", b"import os", None), ("/s/broken.pdf", b"%PDF-1.4 nothing", None), ("/s/bad.bin", bytes(range(128, 255)), None), ("/s/gone.py", None, "No such file"), ("/s/.env", b"X=1", None), ("/s/latin.txt", b"caf\xe9", None)]
    files = spark.createDataFrame(files, "path string, content binary, error string")
    c = Catalog(spark, str(tmp_path / "cat"))
    vectors = spark.createDataFrame([], "path string, content_hash string, text_preview string, vector array<float>, indexed_at long")
    c.commit(entities=e, relations=spark.createDataFrame([], RELATION), texts=spark.createDataFrame([], "path string, name string, content string"), vectors=vectors)
    assert ingest.index_into(c, files, 5) == 2
    got = {r["path"]: (r["outcome"], r["error"]) for r in c.read("outcomes").collect()}
    assert {p: o for p, (o, _) in got.items()} == {"/s/a.py": "indexed", "/s/broken.pdf": "error", "/s/bad.bin": "no_text", "/s/gone.py": "error", "/s/.env": "sensitive", "/s/latin.txt": "indexed"}
    assert got["/s/gone.py"][1] == "No such file" and got["/s/broken.pdf"][1] and got["/s/a.py"][1] is None
    assert {r["path"]: r["content"] for r in c.read("texts").collect()} == {"/s/a.py": "import os", "/s/latin.txt": "caf"}
    assert c.tables() == {"entities": 1, "relations": 2, "texts": 2, "vectors": 2, "outcomes": 2}
    assert ingest.index_into(c, files, 6) == 3 and c.read("outcomes").where("outcome = 'up_to_date'").count() == 2
    index = search.TextIndex(spark, str(tmp_path / "index"))
    ingest.index_once(e, spark.createDataFrame([], RELATION), index, vectors, files, 5)
    assert [r["path"] for r in ql.hybrid(e, None, index, "import", mode="fts").collect()] == ["/s/a.py"]


def test_archive_apply_can_be_repeated(spark, entity_rows, tmp_path):
    for n in ("one.txt", "d/two.txt", "half.txt", "taken.txt"):
        (tmp_path / "src" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / n).write_text(n)
    root, to = str(tmp_path / "src"), str(tmp_path / "attic")
    e = entity_rows(*[(f"{root}/{n}", "h", life) for n, life in (("one.txt", "archived"), ("d/two.txt", "archived"), ("half.txt", "archived"), ("taken.txt", "archived"), ("never.txt", "archived"), ("kept.txt", "active"))])
    plan = export.archive_plan(e, root, to)
    for n, text in (("half.txt", "half.txt"), ("taken.txt", "another")):  # a move that was stopped before its end, and another file
        (tmp_path / "attic" / root.lstrip("/") / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "attic" / root.lstrip("/") / n).write_text(text)
    name = lambda rows: {os.path.basename(r["path"]): r["status"] for r in rows.collect()}
    assert name(export.archive_apply(plan.union(plan))) == {"one.txt": "moved", "two.txt": "moved", "half.txt": "moved", "taken.txt": "conflict", "never.txt": "missing"}
    assert not (tmp_path / "src" / "one.txt").exists() and (tmp_path / "attic" / root.lstrip("/") / "d" / "two.txt").read_text() == "d/two.txt"
    assert name(export.archive_apply(plan)) == {"one.txt": "already", "two.txt": "already", "half.txt": "already", "taken.txt": "conflict", "never.txt": "missing"}
    assert (tmp_path / "src" / "taken.txt").read_text() == "taken.txt"


def test_due_table_equals_the_full_refresh(spark, entity_rows, tmp_path, monkeypatch):
    """Days pass, rows that are due are read and no others, and the states are those of a refresh of everything."""
    r = random.Random(2)
    start = 20_000 * DAY + 4321
    rows = [(f"/f{i}", "h", r.choice(["born", "active", "dormant", "archived", "dead"]), {"accessed_at": start - r.randint(-5, 130) * DAY - r.randint(0, DAY)}) for i in range(120)]
    t = lifecycle.DueTable(spark, str(tmp_path / "due"))
    assert t.refresh(start).count() == 0
    t.write(entity_rows(*rows), start)
    now = {p: (life, more["accessed_at"]) for p, _, life, more in rows}
    state = lambda at, a: next(s for s, n in (("active", 30), ("dormant", 90), ("archived", 10**9)) if int((at - a) / DAY) <= n)
    for at in (start, start + 3 * DAY + 100, start + 3 * DAY + 90, start + 40 * DAY, start + 100 * DAY):
        names = [n for d, n in t.folders() if lifecycle.NEVER < d <= at // DAY]
        read = t._rows(names).count()
        want = {p: (life, state(at, a)) for p, (life, a) in now.items() if life != "dead" and life != state(at, a)}
        assert {x["path"]: (x["old_lifecycle"], x["new_lifecycle"]) for x in t.refresh(at).collect()} == want
        now |= {p: (new, now[p][1]) for p, (_, new) in want.items()}
        assert {x["path"]: (x["lifecycle"], x["accessed_at"]) for x in t.read().collect()} == now
        assert len(want) <= read < 120 or at == start
    there = spark.createDataFrame([(p,) for p in list(now)[::2]], "path string")
    changed = {x["path"]: x["new_lifecycle"] for x in t.refresh(start + 100 * DAY, there).collect()}
    kept = set(list(now)[::2])
    assert changed == {p: (state(start + 100 * DAY, a) if p in kept else "dead") for p, (life, a) in now.items() if life != (state(start + 100 * DAY, a) if p in kept else "dead")}
    # stopped before its commit: undone; stopped after it: finished
    before = sorted(map(tuple, t.read().collect()))
    monkeypatch.setattr(t, "_finish", lambda *a: None)
    t.write(t.read(), start + 100 * DAY)
    assert sorted(map(tuple, t.read().collect())) == before
    again = lifecycle.DueTable(spark, str(tmp_path / "due"))
    again._mark(f"{again.PENDING}lost")
    spark.createDataFrame([(*x,) for x in before], ENTITY).withColumn("due", F.lit(1)).withColumn("run", F.lit("lost")).write.mode("append").partitionBy("due", "run").parquet(str(tmp_path / "due"))
    assert sorted(map(tuple, again.read().collect())) == before
    again.refresh(start + 100 * DAY)
    assert sorted(map(tuple, again.read().collect())) == before and not again._marked(again.PENDING) and not again._marked(again.COMMITTED)


def test_apply_actions(spark, entity_rows):
    e = entity_rows(("/a", "h1"), ("/b", "h2"), ("/c", "h3"))
    actions = spark.createDataFrame([("rename", "/a2", "/a", "h1", 5), ("delete", "/b", None, None, 5), ("touch", "/c", None, None, 9_000_000), ("upsert", "/n", None, "h9", 5)], "action string, path string, old_path string, content_hash string, ts long")
    out, _, h = ingest.apply_actions(e, spark.createDataFrame([], RELATION), spark.createDataFrame([], HISTORY), actions, entity_rows(("/n", "h9")), 7)
    assert {x["path"]: (x["id"], x["accessed_at"]) for x in out.collect()} == {"/a2": ("id:/a", 1_000_000), "/c": ("id:/c", 9_000_000), "/n": ("id:/n", 1_000_000)}
    assert sorted(x["event"] for x in h.collect()) == ["created", "deleted", "renamed"]


def test_last_action_of_a_path_decides(spark, entity_rows):
    e = entity_rows(("/a", "h1"), ("/b", "h2"), ("/c", "h3"), ("/d", "h4"), ("/e", "h5"))
    actions = [
        ("upsert", "/made", None, "m", 1), ("delete", "/made", None, "m", 2),  # made and gone
        ("delete", "/b", None, "h2", 3), ("rename", "/b", "/a", "h1", 4),  # another file takes a deleted one's place
        ("rename", "/t", "/c", "h3", 5), ("rename", "/t", "/d", "h4", 6),  # two files move to one place
        ("delete", "/e", None, "h5", 7), ("upsert", "/e", None, "h9", 8),  # gone and made again
    ]
    rows = spark.createDataFrame(actions, "action string, path string, old_path string, content_hash string, ts long")
    files = entity_rows(("/made", "m"), ("/e", "h9", "active", {"id": "new:/e"}))
    out, _, h = ingest.apply_actions(e, spark.createDataFrame([], RELATION), spark.createDataFrame([], HISTORY), rows, files, 7)
    assert {x["path"]: x["id"] for x in out.collect()} == {"/b": "id:/a", "/t": "id:/d", "/e": "new:/e"} and out.count() == 3
    assert {(x["path"], x["event"]) for x in h.collect()} >= {("/b", "renamed"), ("/t", "renamed"), ("/c", "deleted"), ("/e", "deleted"), ("/e", "created")}


def test_workspaces(tmp_path):
    r = Registry.load(tmp_path / "w.json")
    a = r.add("My Repo!", "/repo")
    b = r.add("sub", "/repo/sub/")
    r = Registry.load(tmp_path / "w.json")
    assert a.id.startswith("my-repo-") and r.resolve("/repo/sub/x").id == b.id and r.resolve("/repo/subway").id == a.id
    assert r.resolve("/elsewhere").id == a.id and r.add("again", "/repo").id == a.id


def test_exports(spark, entity_rows, tmp_path):
    e = entity_rows(('/a"q.rs', "h"), ("/b", None), ("/c\nd\t\\é", "h", "dead", {"summary": "line\nline"}))
    r = spark.createDataFrame([("/b", '/a"q.rs', "imports", 1)], RELATION)
    doc = json.loads(export.write("json", e, r))
    assert [x["path"] for x in doc["entities"]] == ['/a"q.rs', "/b", "/c\nd\t\\é"] and doc["relations"] == [{"from": "/b", "to": '/a"q.rs', "kind": "imports"}]
    assert doc["entities"][1]["content_hash"] is None and doc["entities"][2]["summary"] == "line\nline" and doc["entities"][0]["size_bytes"] == 42
    assert export.write("json", e, r) == json.dumps(doc, indent=2, ensure_ascii=False) + "\n"
    export.write("csv", e, r, str(tmp_path / "x" / "out.csv"))
    lines = (tmp_path / "x" / "out.csv").read_text().splitlines()
    assert lines[1] == '"/a""q.rs","a""q.rs","rs",42,1000000,1000000,1000000,"active","h","",""'
    assert '  "/b" -> "/a\\"q.rs" [label="imports"];' in export.write("dot", e, r)
    with pytest.raises(ValueError):
        export.write("xml", e, r)


def test_one_file_from_many_parts(spark, entity_rows, tmp_path, monkeypatch):
    """The executors' parts make the same document as the driver's text, which is never held."""
    e = entity_rows(*[(f"/s/{i % 7}/f{i:03d}.rs", "h%d" % i) for i in range(200)]).repartition(9)
    r = spark.createDataFrame([(f"/s/{i % 7}/f{i:03d}.rs", "/s/0/f000.rs", "imports", 1) for i in range(1, 90)], RELATION).repartition(5)
    for kind in export.EXPORTS:
        for rows, edges in ((e, r), (e.limit(0), r), (e, r.limit(0)), (e.limit(0), r.limit(0))):
            want = export.write(kind, rows, edges)
            with monkeypatch.context() as m:
                m.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
                m.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", None)
                export.write(kind, rows, edges, str(tmp_path / f"out.{kind}"))
            assert (tmp_path / f"out.{kind}").read_text() == want
    assert sorted(n for n in os.listdir(tmp_path) if not n.endswith(".crc")) == ["out.csv", "out.dot", "out.json"]
    export.write_lines(export.entity_lines(e).orderBy("line"), str(tmp_path / "lines.txt"))
    assert (tmp_path / "lines.txt").read_text().splitlines() == sorted(f"active    /s/{i % 7}/f{i:03d}.rs" for i in range(200))
