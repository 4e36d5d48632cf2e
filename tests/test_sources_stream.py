"""File sources on temporary trees, and the rename feed in batch and streaming form."""

import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.sources import git, paths, scan, tree
from loam.streaming import rename


def put(root, **files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def edges_of(spark, root):
    files = scan.binary_listing(spark, str(root)).select("path", F.col("content").cast("string").alias("content"))
    base = str(root)
    return {(r["from_path"].removeprefix(base + "/"), r["to_path"].removeprefix(base + "/"), r["kind"]) for r in scan.import_edges(files, files).collect()}


def test_import_edges(spark, tmp_path):
    put(
        tmp_path,
        **{
            "a/utils.py": "", "a/main.py": "from utils import helper\nimport os\n", "a/sub/rel.py": "from ..common import foo, bar\nfrom . import near\n", "a/common/foo.py": "", "a/common/__init__.py": "", "a/sub/near.py": "",
            "b/scanner.rs": "", "b/foo/mod.rs": "", "b/lib.rs": "mod scanner;\n  mod foo;\nmod none;\n",
            "c/utils.ts": "", "c/lib/index.ts": "", "c/index.ts": "import x from './utils'\nimport y from 'react'\nconst z = require('./lib')\nexport * from '../c/utils'\n", "d/x.yaml": "from utils import y",
        },
    )
    assert edges_of(spark, tmp_path) == {
        ("a/main.py", "a/utils.py", "imports"), ("a/sub/rel.py", "a/common/__init__.py", "imports"), ("a/sub/rel.py", "a/common/foo.py", "imports"), ("a/sub/rel.py", "a/sub/near.py", "imports"),
        ("b/lib.rs", "b/scanner.rs", "mod"), ("b/lib.rs", "b/foo/mod.rs", "mod"), ("c/index.ts", "c/utils.ts", "imports"), ("c/index.ts", "c/lib/index.ts", "imports"),
    }


def test_scan(spark, tmp_path):
    put(tmp_path, **{"a.rs": "x", "node_modules/b.js": "y", "sub/big.txt": "z" * 100, "c.log": "q"})
    ignore = paths.IgnoreSet(rules=("*.log", "!keep.log"), root=str(tmp_path))
    for listing in (scan.binary_listing(spark, str(tmp_path)), scan.stat_listing(spark, str(tmp_path))):
        stats = scan.scan_stats(listing, ignore, max_bytes=50).first()
        assert tuple(stats) == (2, 1, 1, 0)
        row = scan.to_entities(listing, 10**10, ignore, max_bytes=50).collect()
        assert [(r["name"], r["extension"], r["size_bytes"], r["lifecycle"]) for r in row] == [("a.rs", "rs", 1, "archived")]
        assert row[0]["content_hash"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_tree_equals_os_walk(spark, tmp_path):
    """Deep, wide and lopsided folders, links, empty files, a huge sparse file: what ``os.walk`` finds, in several rounds."""
    deep = tmp_path / "r" / "/".join("d%d" % i for i in range(40))
    deep.mkdir(parents=True)
    (deep / "end.txt").write_text("end")
    for i in range(30):
        (tmp_path / "r" / "wide" / ("w%d" % i)).mkdir(parents=True)
        for k in range(i):
            (tmp_path / "r" / "wide" / ("w%d" % i) / ("f%d.txt" % k)).write_text("x" * k)
    (tmp_path / "r" / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "r" / "node_modules" / "x" / "y.js").write_text("y")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "o.txt").write_text("o")
    (tmp_path / "r" / "link").symlink_to(tmp_path / "outside")
    (tmp_path / "r" / "to_file").symlink_to(tmp_path / "outside" / "o.txt")
    with open(tmp_path / "r" / "huge.bin", "wb") as f:
        f.truncate(1 << 40)  # sparse: reading it would take for ever
    want = {}
    for top, _, names in os.walk(tmp_path / "r"):
        for n in names:
            p = os.path.join(top, n)
            if not os.path.islink(p):
                want[p] = (os.stat(p).st_size, int(os.stat(p).st_mtime))
    rows = tree.listing(spark, str(tmp_path / "r"), task_entries=25)
    assert {r["path"]: (r["size_bytes"], r["modified_at"]) for r in rows.collect()} == want and rows.where("error is not null").isEmpty()
    assert {r["path"] for r in tree.listing(spark, str(tmp_path / "r"), ("node_modules",)).collect()} == {p for p in want if "node_modules" not in p}
    assert {r["path"]: r["size_bytes"] for r in tree.listing(spark, f"file://{tmp_path}/r").collect()} == {p: s for p, (s, _) in want.items()}
    ignore = paths.IgnoreSet()
    stats = scan.scan_stats(scan.stat_listing(spark, str(tmp_path / "r"), ignore), ignore).first()
    assert tuple(stats) == (len(want) - 1, len(want) - 2, 1, 0)
    hashed = {r["path"]: r["content_hash"] for r in tree.with_hash(rows).collect()}
    assert hashed[str(deep / "end.txt")] == hashlib.sha256(b"end").hexdigest() and hashed[str(tmp_path / "r" / "huge.bin")] == "size:%d" % (1 << 40)
    counted = tree.with_hash(rows).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in counted and "ArrowEvalPython" in tree.with_hash(rows)._jdf.queryExecution().executedPlan().toString()


def test_tree_errors_and_edges(spark, tmp_path):
    put(tmp_path, **{"a/one.txt": "1", "a/two.txt": "2" * 100})
    rows = scan.stat_listing(spark, str(tmp_path))
    (tmp_path / "a" / "one.txt").unlink()  # gone after it was listed
    read = {os.path.basename(r["path"]): r for r in tree.with_content(rows).collect()}
    assert read["one.txt"]["content"] is None and "No such file" in read["one.txt"]["error"] and bytes(read["two.txt"]["content"]) == b"2" * 100
    assert tree.with_content(rows, 10).where("content is not null").isEmpty()
    assert [r["name"] for r in scan.to_entities(tree.with_content(rows), 5).collect()] == ["two.txt"]
    none = tree.listing(spark, str(tmp_path / "absent")).collect()
    assert len(none) == 1 and none[0]["error"] and scan.scan_stats(tree.listing(spark, str(tmp_path / "absent"))).first()["errors"] == 1
    assert [r["path"] for r in tree.listing(spark, str(tmp_path / "a" / "two.txt")).collect()] == [str(tmp_path / "a" / "two.txt")]
    (tmp_path / "empty").mkdir()
    assert tree.listing(spark, str(tmp_path / "empty")).collect() == []


def test_extract_text(spark):
    rows = [("/a.py", b"print(1)"), ("/b.bin", bytes(range(200, 256))), ("/Dockerfile", b"FROM x"), ("/c.txt", b"a\xffb"), ("/d.md", b"x" * 100_000), ("/e.rs", b""), ("/n.rs", None), ("/f.html", b"<p>")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r["t"] for r in df.select("path", scan.extract_text(F.col("path"), F.col("content")).alias("t")).collect()}
    assert got["/a.py"] == "print(1)" and got["/b.bin"] is None and got["/Dockerfile"] == "FROM x" and got["/c.txt"] == "ab"
    assert len(got["/d.md"]) == 32_000 and got["/e.rs"] == "" and got["/n.rs"] is None and got["/f.html"] == "<p>"


def plain_follow(commits, path):
    """What following one path from the newest commit to the oldest gives; commits are (ts, author, [(status, old, path)])."""
    lines = []
    for ts, author, changes in commits:
        hit = [c for c in changes if c[2] == path]
        if hit:
            lines.append((ts, author))
            moved = sorted(c[1] for c in hit if c[0] in "RC")
            path = moved[-1] if moved else path
    if any(t is None for t, _ in lines):
        return None, None, None
    names = Counter(a for _, a in lines)
    return lines[-1][0], lines[0][0], min(names, key=lambda a: (-names[a], a))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_git_follow(spark, tmp_path, seed):
    """Random histories with chains of renames, copies, swaps, paths used again and broken commits, read from a log in pieces."""
    r = random.Random(seed)
    names = ["src/f%d.py" % i for i in range(8)] + ["dir with space/ünï.txt"]
    commits = []
    for n in range(120):
        changes, used = [], set()
        for p in r.sample(names, r.randint(1, 3)):
            old = r.choice(names)
            kind = r.choice("AMMMDRRC")
            if p in used or (kind in "RC" and old == p):
                continue
            used.add(p)
            changes.append((kind, old if kind in "RC" else None, p))
        broken = n == 7 and seed == 3
        commits.append((None if broken else 10_000 - n, None if broken else r.choice(["Ann", "Bob", "Cy"]), changes))
    text = ""
    for ts, author, changes in commits:
        text += "\x1e" + (f"{ts}\x1f{author}" if ts else "broken") + "\n\n"
        text += "".join(f"{k}{'087' if k in 'RC' else ''}\t{o + chr(9) if o else ''}{p}\n" for k, o, p in changes) + "unreadable line\n"
    (tmp_path / "log.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 900)
    spark.conf.set("spark.sql.files.openCostInBytes", 10)
    try:
        records = git.read_log(spark, str(tmp_path / "log.txt"))
        assert records.select(F.spark_partition_id()).distinct().count() > 1
        got = {x["path"]: tuple(x)[1:] for x in git.follow(records).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    met = {p for _, _, changes in commits for _, _, p in changes}
    assert got == {p: plain_follow(commits, p) for p in met}
    assert (seed != 3) or any(v == (None, None, None) for v in got.values())


def test_git_follow_long_chain(spark):
    """A file renamed a hundred times was created by its first name's first commit."""
    rows = [("p100", None, "M", 0, 1000, "Zed")]
    rows += [(f"p{100 - i}", f"p{99 - i}", "R", 1 + i, 900 - i, "Ann") for i in range(100)]
    rows += [("p0", None, "A", 101, 5, "Zed"), ("other", None, "A", 102, 4, None)]
    got = {x["path"]: tuple(x)[1:] for x in git.follow(spark.createDataFrame(rows, "path string, old_path string, status string, nth long, ts long, author string")).collect()}
    assert got["p100"] == (5, 1000, "Ann") and got["p0"] == (5, 5, "Zed") and got["other"] == (None, None, None) and len(got) == 102


def test_git_metadata(spark):
    c = spark.createDataFrame([("/f", 0, 300, "Alice"), ("/f", 1, 200, "Bob"), ("/f", 2, 100, "Alice"), ("/t", 0, 5, "Zed"), ("/t", 1, 4, "Amy"), ("/x", 0, None, "A")], "path string, nth int, ts long, author string")
    got = {r["path"]: (r["created_at"], r["modified_at"], r["author"]) for r in scan.git_metadata(c).collect()}
    assert got == {"/f": (100, 300, "Alice"), "/t": (4, 5, "Amy")}


@pytest.mark.parametrize("path,ignored", [("/r/.git/x", True), ("/r/node_modules/x", True), ("/r/target/x", True), ("/r/src/x", False), ("/r/src/.venv/x", True), ("/r/mytarget/x", False)])
def test_ignored_segments(spark, path, ignored):
    assert spark.range(1).select(paths.IgnoreSet().ignored(F.lit(path)).alias("x")).first()["x"] is ignored


@pytest.mark.parametrize("path,hit", [("/a/.env", True), ("/a/.env.local", True), ("/a/server.PEM", True), ("/a/id_rsa.pub", True), ("/h/.SSH/config", True), ("/h/.config/gcloud/x", True), ("/h/.config/other/x", False), ("/a/secrets/x.md", True), ("/a/public.key.md", False), ("/a/environment.py", False), ("/a/secrets_manager.py", False), ("/a/credentials", True)])
def test_sensitive(spark, path, hit):
    assert (spark.range(1).select(paths.sensitive_reason(F.lit(path)).alias("x")).first()["x"] is not None) is hit


def test_sensitive_extra_and_order(spark):
    r = spark.range(1).select(paths.sensitive_reason(F.lit("/a/vault.json"), ("vault.json", "*.mysecret")).alias("a"), paths.sensitive_reason(F.lit("/secrets/.env")).alias("b")).first()
    assert r["a"] == "matches sensitive pattern: vault.json" and r["b"] == "in sensitive directory: secrets"


SCHEMA = "event_id long, ts long, action string, path string, new_path string, content_hash string"
CASES = {
    "rename": ([("remove", "/old", 100), ("create", "/new", 105)], [("rename", "/new", "/old")]),
    "late": ([("remove", "/old", 100), ("create", "/new", 106)], [("delete", "/old", None), ("upsert", "/new", None)]),
    "two removes": ([("remove", "/a", 100), ("remove", "/b", 101), ("create", "/c", 102)], [("upsert", "/c", None), ("delete", "/a", None), ("delete", "/b", None)]),
    "same path": ([("remove", "/x", 100), ("create", "/x", 101)], [("cancelled", "/x", None), ("upsert", "/x", None)]),
    "lone remove": ([("remove", "/x", 100)], [("delete", "/x", None)]),
}


def rows_of(events, h="h1", start=0):
    return [(start + i, ts, action, path, None, h) for i, (action, path, ts) in enumerate(events)]


@pytest.mark.parametrize("case", CASES)
def test_replay(spark, case):
    events, want = CASES[case]
    got = rename.replay(spark.createDataFrame(rows_of(events), SCHEMA)).collect()
    assert sorted((r["action"], r["path"], r["old_path"] or "") for r in got) == sorted((a, p, o or "") for a, p, o in want)


def test_replay_hashes(spark):
    rows = rows_of([("remove", "/a", 1)], "h1") + rows_of([("create", "/b", 2)], "h2", 5) + rows_of([("remove", "/s", 1), ("create", "/t", 2)], "size:9", 10) + [(20, 3, "rename_both", "/p", "/q", None), (21, 3, "access", "/p", None, None)]
    got = {(r["action"], r["path"], r["old_path"]) for r in rename.replay(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("delete", "/a", None), ("upsert", "/b", None), ("delete", "/s", None), ("upsert", "/t", None), ("rename", "/q", "/p"), ("touch", "/p", None)}


def test_remove_takes_the_stored_hash(spark, entity_rows):
    e = spark.createDataFrame([(1, 1, "remove", "/a", None, None)], SCHEMA)
    assert rename.with_hash(e, entity_rows(("/a", "stored"))).first()["content_hash"] == "stored"


def test_stream_equals_replay(spark, tmp_path):
    rows, n = [], 0
    for i, events in enumerate(v[0] for v in CASES.values()):
        rows += rows_of(events, f"h{i}", n)
        n += 10
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    spark.createDataFrame([(999, 10_000, "create", "/sentinel", None, "zz")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    seen = []
    stream = rename.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    w = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", out).outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    want = rename.replay(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r["content_hash"], r["action"], r["path"], r["old_path"] or "")
    assert sorted(key(r) for r in seen if r["path"] != "/sentinel") == sorted(map(key, want))


def mixed_rows():
    """Events of every kind: hashed, without a hash, with one that stands for a size."""
    rows, n = [], 0
    for i, events in enumerate(v[0] for v in CASES.values()):
        rows += rows_of(events, f"h{i}", n)
        n += 10
    return rows + [(50, 90, "rename_both", "/p", "/q", None), (51, 91, "access", "/p", None, "hx"), (52, 92, "remove", "/nohash", None, None), (53, 93, "create", "/plain", None, None), (54, 94, "modify", "/big", None, "size:9"), (55, 95, "rename_from", "/big", None, "size:9"), (56, 96, "rename_to", "/moved", None, None)]


def test_stream_keeps_every_action(spark, tmp_path):
    """Mixed events: the stream gives what the batch form gives, for all kinds of actions."""
    src = str(tmp_path / "in")
    rows = mixed_rows()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    spark.createDataFrame([(999, 10_000, "create", "/sentinel", None, "zz")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    seen = []
    stream = rename.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    w = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    want = rename.replay(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r["content_hash"] or "", r["action"], r["path"], r["old_path"] or "")
    assert sorted(key(r) for r in seen if r["path"] != "/sentinel") == sorted(map(key, want))
    assert {r["action"] for r in seen} == {"rename", "upsert", "delete", "touch", "cancelled"}


def test_watch_follows_files_that_came_after_the_start(spark, tmp_path, entity_rows):
    """A file made after the start and then moved is a rename; hashes come from the feed and from the current table."""
    src = str(tmp_path / "in")
    later = []

    def write(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(src)

    write((1, 100, "create", "/new", None, "n1"), (2, 101, "remove", "/new", None, None), (3, 102, "create", "/moved", None, "n1"))
    write((4, 103, "remove", "/stored", None, None), (5, 104, "create", "/stored2", None, "s1"), (6, 105, "access", "/x", None, None))
    write((7, 300, "create", "/sentinel", None, "zz"))

    def run():
        feed = rename.watch(spark, src, SCHEMA, lambda: entity_rows(("/stored", "s1")), lambda df, _: later.extend(df.collect()), str(tmp_path / "c"), {"availableNow": True})
        feed.drain(120)

    run()
    write((8, 400, "remove", "/moved", None, None), (9, 401, "create", "/again", None, "n1"), (10, 900, "create", "/sentinel2", None, "zy"))
    run()
    got = {(r["action"], r["path"], r["old_path"]) for r in later if "sentinel" not in r["path"]}
    assert got == {("upsert", "/new", None), ("rename", "/moved", "/new"), ("rename", "/stored2", "/stored"), ("touch", "/x", None), ("rename", "/again", "/moved")}


def test_late_events_are_given_out(spark, tmp_path):
    """An event behind the watermark is counted as late and still acts, unless its path has seen something newer."""
    src, seen = str(tmp_path / "in"), []
    write = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(src)
    write((1, 100, "create", "/a", None, "h1"), (2, 100, "create", "/b", None, "h2"))
    write((3, 1000, "modify", "/b", None, "h3"))
    write((4, 1001, "create", "/c", None, "h4"))
    write((5, 110, "remove", "/a", None, None), (6, 112, "create", "/a2", None, "h1"), (7, 111, "remove", "/b", None, None))
    write((8, 2000, "create", "/z", None, "zz"))
    stream = rename.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))
    w = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    got = sorted((r["action"], r["path"], r["old_path"] or "", r["ts"]) for r in seen)
    assert got == sorted(
        [("upsert", "/a", "", 100), ("upsert", "/b", "", 100), ("upsert", "/b", "", 1000), ("upsert", "/c", "", 1001), ("upsert", "/z", "", 2000)]
        + [("late", "/a", "", 110), ("late", "/a2", "", 112), ("rename", "/a2", "/a", 112), ("late", "/b", "", 111)]
    )


def test_watch_hot_path_and_log(spark, tmp_path, entity_rows):
    """Thousands of events on one path: each remove has the hash of the path's last change; batches are logged, nothing is re-read."""
    src, seen = str(tmp_path / "in"), []
    r, rows, ts = random.Random(4), [], 0
    for i in range(3000):
        ts += r.choice([1, 2, 9])
        rows.append((i, ts, "create", "/hot", None, f"h{i % 7}") if i % 2 == 0 else (i, ts, "remove", "/hot", None, None))
    for part in range(3):
        spark.createDataFrame(rows[part * 1000 : part * 1000 + 1000], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(9999, 10**6, "create", "/end", None, "zz")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    feed = rename.watch(spark, src, SCHEMA, entity_rows(("/hot", "stored")), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c"), {"availableNow": True}, log=str(tmp_path / "log"))
    feed.drain(240)
    events = spark.createDataFrame(rows, SCHEMA)
    want = rename.replay(rename.with_hash(events, entity_rows(("/hot", "stored")))).collect()
    key = lambda x: tuple(y or "" for y in x)
    assert sorted((tuple(x) for x in seen if x["path"] != "/end"), key=key) == sorted((tuple(x) for x in want), key=key)
    counts = Counter()
    for line in feed.log:
        counts.update({k: v for k, v in line.items() if k not in ("epoch", "upto")})
    assert counts == Counter(x["action"] for x in seen) and feed.log[-1]["upto"] is not None
    assert spark.read.json(str(tmp_path / "log")).agg(F.sum("n")).first()[0] == len(seen)


def test_replay_equals_a_plain_loop(spark):
    """Random events against a single loop over all of them; sessions don't change a thing."""
    import random

    r = random.Random(3)
    rows, ts = [], 0
    for i in range(400):
        ts += r.choice([0, 1, 2, 3, 7])
        rows.append((i, ts, r.choice(["create", "modify", "remove", "rename_from", "rename_to"]), f"/p{r.randint(0, 6)}", None, f"h{r.randint(0, 3)}"))
    held, want = {}, []
    for _, ts, action, path, _, h in rows:
        mine = held.setdefault(h, [])
        want += [("delete", p, None, h, t) for p, t in mine if ts - t > 5]
        mine[:] = [x for x in mine if ts - x[1] <= 5]
        if action in ("remove", "rename_from"):
            mine.append((path, ts))
            continue
        rest = [x for x in mine if x[0] != path]
        if len(rest) == 1:
            want.append(("rename", path, rest[0][0], h, ts))
            rest = []
        else:
            want += [("cancelled", path, None, h, ts)] if len(rest) < len(mine) else []
            want.append(("upsert", path, None, h, ts))
        mine[:] = rest
    want += [("delete", p, None, h, t) for h, mine in held.items() for p, t in mine]
    events = spark.createDataFrame(rows, SCHEMA)
    assert rename.sessions(rename.waiting(events)).select("content_hash", "session").distinct().count() > 40
    key = lambda x: tuple(y or "" for y in x)
    assert sorted((tuple(r) for r in rename.replay(events).collect()), key=key) == sorted(want, key=key)
