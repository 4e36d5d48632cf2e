"""Graph walks, search, the query language and context packs."""

import random
import sqlite3
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loam.operators import export, graph, related, search
from loam.operators.cycles import circuits, elementary_cycles, strong_components
from loam.plans import context, query_language as ql
from loam.plans.session_api import TOOLS, Session
from loam.schema import HISTORY, RELATION


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "imports", 1) for a, b in pairs], RELATION)


def test_reverse_deps(spark):
    r = edges(spark, ("b", "a"), ("c", "b"))
    assert [(x["path"], x["depth"]) for x in graph.reverse_deps(r, "a", 5).orderBy("depth").collect()] == [("b", 1), ("c", 2)]
    assert graph.reverse_deps(r, "a", 1).count() == 1
    assert graph.reverse_deps(r, "a", 0).count() == 0
    loop = graph.reverse_deps(edges(spark, ("a", "b"), ("b", "a")), "a", 5).collect()
    assert [x["path"] for x in loop] == ["b"]


def test_neighbourhood(spark):
    r = edges(spark, ("a", "b"), ("b", "c"))
    near = graph.neighbourhood_nodes(r, "a", 1)
    assert {x["path"] for x in near.collect()} == {"a", "b"}
    far = graph.neighbourhood_nodes(r, "a", 2)
    assert {x["path"] for x in far.collect()} == {"a", "b", "c"}
    assert graph.neighbourhood_edges(r, far, 2).count() == 2
    assert [x["path"] for x in graph.neighbourhood_nodes(r, "z", 2).collect()] == ["z"]


def test_cycles(spark):
    r = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "c"), ("x", "a"))
    assert sorted(x["cycle"] for x in graph.cycles(r).collect()) == [["a", "b", "a"], ["a", "b", "c", "a"]]
    assert graph.cycles(edges(spark, ("a", "b"))).count() == 0


def test_cycles_of_any_length(spark):
    """A ring of eleven nodes with chords, against a depth-first search."""
    names = "abcdefghijk"
    pairs = [(x, names[(i + 1) % 11]) for i, x in enumerate(names)] + [("d", "b"), ("c", "f"), ("k", "e")]
    out = {x: sorted({b for a, b in pairs if a == x}) for x in names}

    def grown(path):
        for y in out[path[-1]]:
            if y == path[0]:
                yield [*path, y]
            elif y > path[0] and y not in path:
                yield from grown([*path, y])

    want = sorted(c for x in names for c in grown([x]))
    assert max(map(len, want)) == 12
    r = edges(spark, *pairs)
    assert sorted(x["cycle"] for x in graph.cycles(r).collect()) == want
    assert sorted(x["cycle"] for x in graph.cycles(r, 3).collect()) == [c for c in want if len(c) <= 4]
    grown_rows = elementary_cycles(r.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")), local_edges=5)
    assert sorted(x["cycle"] for x in grown_rows.collect()) == want


def test_cycles_around_a_ladder(spark, monkeypatch):
    """Two rings with a long acyclic ladder between them: 2 ** 40 ways that lead nowhere back, and few jobs."""
    pairs = [("ra", "rb"), ("rb", "ra"), ("rb", "l0a"), ("l40a", "sa"), ("sa", "sb"), ("sb", "sa")]
    for i in range(40):
        pairs += [(f"l{i}a", f"l{i}b"), (f"l{i}a", f"l{i + 1}a"), (f"l{i}b", f"l{i + 1}a")]
    cuts = []
    from loam.operators import cycles as module

    plain = module.cut
    monkeypatch.setattr(module, "cut", lambda df: cuts.append(1) or plain(df))
    assert sorted(x["cycle"] for x in graph.cycles(edges(spark, *pairs)).collect()) == [["ra", "rb", "ra"], ["sa", "sb", "sa"]]
    assert len(cuts) < 60


@pytest.mark.parametrize("seed", range(3))
def test_strong_components(spark, seed):
    """Random graphs against reachability; a dense one has its cycles counted by depth-first search."""
    r = random.Random(seed)
    names = ["n%02d" % i for i in range(30)]
    pairs = {(r.choice(names), r.choice(names)) for _ in range(40)}
    reach = {n: {b for a, b in pairs if a == n} for n in names}
    for _ in names:
        reach = {n: s | {y for x in s for y in reach[x]} for n, s in reach.items()}
    want = {frozenset(y for y in names if y == x or (y in reach[x] and x in reach[y])) for x in names}
    want = {c for c in want if len(c) > 1}
    rows = strong_components(edges(spark, *sorted(pairs)).select(F.col("from_path").alias("a"), F.col("to_path").alias("b"))).collect()
    got = defaultdict(set)
    for x in rows:
        got[x["component"]].add(x["node"])
    assert {frozenset(v) for v in got.values()} == want and all(k in v for k, v in got.items())
    dense = {i: [j for j in range(7) if j != i and r.random() < 0.7] for i in range(7)}

    def grown(path):
        for y in dense[path[-1]]:
            if y == path[0]:
                yield tuple(path)
            elif y > path[0] and y not in path:
                yield from grown([*path, y])

    assert sorted(tuple(c) for s in range(7) for c in circuits(dense, s)) == sorted(c for s in range(7) for c in grown([s]))


def test_stale(spark, entity_rows):
    e = entity_rows(("a", "1"), ("b", "2"))
    r = edges(spark, ("a", "b"), ("a", "gone"))
    assert [x["to_path"] for x in graph.stale_relations(r, e).collect()] == ["gone"]
    assert [x["to_path"] for x in graph.live_relations(r, e).collect()] == ["b"]


def test_related_tests(spark, entity_rows):
    """Every kind of link counts once, with its reason; ties go by path, and the number of hits is bounded."""
    e = entity_rows(*[(p, "h") for p in ("/ship/hull/keel.ts", "/ship/hull/keel.spec.ts", "/ship/sail/mast.test.ts", "/dock/test/crane.ts", "/dock/yard.ts")])
    r = edges(spark, ("/dock/test/crane.ts", "/ship/hull/keel.ts"), ("/ship/hull/keel.ts", "/ship/tests/deck.ts"), ("/ship/hull/keel.ts", "/dock/yard.ts"))
    got = [(x["path"], x["score"], x["reasons"]) for x in related.related_tests(e, r, ["/ship/hull/keel.ts"]).collect()]
    assert got == [
        ("/dock/test/crane.ts", 16, ["imports planned file", "test file"]),
        ("/ship/hull/keel.spec.ts", 15, ["name match", "same area", "test file"]),
        ("/ship/tests/deck.ts", 8, ["linked by imports"]),
        ("/ship/sail/mast.test.ts", 5, ["same area", "test file"]),
    ]
    assert [x["path"] for x in related.related_tests(e, r, ["/ship/hull/keel.ts", "/dock/yard.ts"], 1).collect()] == ["/dock/test/crane.ts"]
    assert related.test_commands(["hold.rs"], ("pyproject.toml",)) == ["cargo test --workspace --all-targets", "uv run --group dev pytest"] and related.test_commands(["log.txt"]) == []


def test_many_starts_in_one_walk(spark, monkeypatch):
    """Walks from a hundred starts are what single walks give, at the cost of one; scopes filter what was reached."""
    r = random.Random(9)
    names = ["/s/n%02d" % i if i % 3 else "/t/n%02d" % i for i in range(60)]
    pairs = sorted({(r.choice(names), r.choice(names), r.choice(["imports", "mod"])) for _ in range(90)})
    rows = spark.createDataFrame([(*p, 1) for p in pairs], RELATION)

    def plain(start, depth):
        seen, frontier, out = {start}, {start}, set()
        for hop in range(1, depth + 1):
            new = {}
            for a, b, k in pairs:
                if b in frontier and a not in seen:
                    new[a] = min(k, new.get(a, k))
            out |= {(start, a, k, hop) for a, k in new.items()}
            seen, frontier = seen | set(new), set(new)
        return out

    starts = names + ["/none"] + names[:3] + ["/x%d" % i for i in range(70)]
    got = {tuple(x) for x in graph.reverse_deps_many(rows, starts, 3).collect()}
    assert got == set().union(*(plain(s, 3) for s in set(starts)))
    monkeypatch.setattr(graph, "BROADCAST_PATHS", 0)
    assert {tuple(x)[1:] for x in graph.reverse_deps_many(rows, names[:1], 4).select("start", "path", "kind", "depth").collect()} == {x[1:] for x in plain(names[0], 4)}
    hit = graph.reverse_deps_many(rows, names[:4], 2)
    summary = {x["path"]: (x["total"], x["direct"]) for x in graph.impact_of_many(hit, [*names[:4], "/none"]).collect()}
    assert summary == {s: (len(plain(s, 2)), len(plain(s, 1))) for s in [*names[:4], "/none"]}


TEXTS = [("/lab/kiln.txt", "kiln.txt", "clay kiln glaze recipe"), ("/lab/boat.txt", "boat.txt", "oars and a list of knots"), ("/lab/na.md", "na.md", "Naïve kiln walk"), ("/lab/tok.md", "tok.md", "the auth token auth"), ("/lab/odd.md", "odd.md", "token then auth")]


def fts5(query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(path UNINDEXED, name, content)")
    db.executemany("INSERT INTO f VALUES (?,?,?)", TEXTS)
    return [(p, round(r, 6)) for p, r in db.execute("SELECT path, bm25(f) FROM f WHERE f MATCH ? ORDER BY 2, 1", (query,))]


@pytest.mark.parametrize("query,match", [("kiln glaze", "kiln glaze"), ("NAIVE", "naive"), ("auth_token", '"auth token"'), ("list", "list"), ("zebra", "zebra")])
def test_bm25_equals_fts5(spark, query, match):
    t = spark.createDataFrame(TEXTS, "path string, name string, content string")
    assert [(r["path"], round(r["rank"], 6)) for r in search.fts_search(t, query).collect()] == fts5(match)


def test_fts_punctuation_is_no_error(spark):
    t = spark.createDataFrame(TEXTS, "path string, name string, content string")
    assert [r["path"] for r in search.fts_search(t, "kiln.txt").collect()] == ["/lab/kiln.txt"]
    assert search.fts_search(t, "!!!").count() == 0


def test_sanitized_columns(spark):
    asked = ["Auth token!", "a_b-c/d.e", "  (x)  \t y", "naïve ①", "", "!!!"]
    got = spark.createDataFrame([(x,) for x in asked], "q string").select(search.sanitized(F.col("q")).alias("s")).collect()
    assert [r["s"] for r in got] == [search.sanitize(x) for x in asked]


SCHEMA_TEXTS = "path string, name string, content string"


def test_text_index(spark, tmp_path):
    """The stored index gives what a scan of the current texts gives, through changes, removals and compaction."""
    index = search.TextIndex(spark, str(tmp_path / "index"))
    assert index.match("kiln").collect() == [] and index.top("kiln").collect() == [] and index.generations() == []
    index.compact()
    index.add(spark.createDataFrame(TEXTS, SCHEMA_TEXTS))
    now = {p: (p, n, c) for p, n, c in TEXTS}

    def agree(*asked):
        t = spark.createDataFrame(list(now.values()), SCHEMA_TEXTS)
        for q in asked or ("kiln", "auth token", "auth_token", "token-auth", "NAIVE kiln", "zebra", "!!!", "txt a"):
            key = lambda df: sorted((r["path"], round(r["rank"], 6)) for r in df.collect())
            assert key(index.match(q)) == key(search.fts_match(t, q)), q
            assert key(index.top(q, 2)) == key(search.fts_search(t, q, 2)), q
            assert key(index.top(q, 2, "/lab")) == key(search.fts_search(t, q, 2, "/lab")), q

    agree()
    changed = [("/lab/tok.md", "tok.md", "auth token, auth token; auth-token a token"), ("/lab/new.txt", "new.txt", None)]
    index.add(spark.createDataFrame(changed + changed, SCHEMA_TEXTS))
    now |= {r[0]: r for r in changed}
    index.remove(spark.createDataFrame([("/lab/odd.md",), ("/never/there",)], "path string"))
    del now["/lab/odd.md"]
    # a generation that was never finished doesn't count, and its number is taken again
    index._write("postings", 4, index.postings(["auth"]).drop("generation"))
    agree("kiln", "auth_token", "the auth")
    assert [g["generation"] for g in index.generations()] == [1, 2, 3]
    index.compact()
    assert len(index.generations()) == 1 and index.documents().count() == len(now)
    agree("kiln", "token-auth")
    index.add(spark.createDataFrame([("/lab/odd.md", "odd.md", "kiln again")], SCHEMA_TEXTS))
    now["/lab/odd.md"] = ("/lab/odd.md", "odd.md", "kiln again")
    agree("kiln")


def test_postings_leave_their_row_finished(spark):
    """A text's occurrences are grouped in its row: no exchange, and the places of names and contents sorted."""
    from loam.operators import text_index

    texts = spark.createDataFrame([("/a", ["b", "a", "b"], ["a", "c"]), ("/b", [], []), ("/c", [], ["z"])], "path string, n array<string>, c array<string>")
    got = text_index._postings(texts, "path")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    B = text_index.BREAK
    assert sorted((r["path"], r["token"], r["places"]) for r in got.collect()) == [("/a", "a", [1, B]), ("/a", "b", [0, 2]), ("/a", "c", [B + 1]), ("/c", "z", [B])]


def test_text_index_skips_ranges(spark, tmp_path, monkeypatch):
    """Many documents of different lengths: the best are found without the ranges that can't have them."""
    from loam.operators import text_index

    monkeypatch.setattr(text_index, "RANGE_DOCS", 25)
    monkeypatch.setattr(text_index, "FILE_ROWS", 500)
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 10)
    monkeypatch.setattr(text_index, "BROADCAST_ROWS", 5)
    r = random.Random(6)
    words = ["oak", "elm", "ash", "yew", "fir"] + ["w%d" % i for i in range(200)]
    make = lambda i: ("/t/%03d.txt" % i, "%03d.txt" % i, " ".join(r.choice(words[:5] if r.random() < 0.3 else words) for _ in range(r.choice([3, 20, 60, 150]))))
    rows = {t[0]: t for t in map(make, range(300))}
    index = search.TextIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(list(rows.values()), SCHEMA_TEXTS))
    more = {t[0]: t for t in map(make, range(280, 330))}
    index.add(spark.createDataFrame(list(more.values()), SCHEMA_TEXTS))
    rows |= more
    table, spared = spark.createDataFrame(list(rows.values()), SCHEMA_TEXTS), 0
    for q in ("oak", "oak elm", "fir w3", "w7", "yew ash oak"):
        want = [(x["path"], round(x["rank"], 9)) for x in search.fts_search(table, q, 5).collect()]
        assert [(x["path"], round(x["rank"], 9)) for x in index.top(q, 5).collect()] == want, q
        spared += index.all_ranges - index.read_ranges
    assert index.all_ranges == 14 and spared > 10
    plan = index.top("oak", 5)._jdf.queryExecution().executedPlan().toString()
    assert "generation=" in plan or "In(token" in plan or "EqualTo(token" in plan
    files = spark.read.parquet(str(tmp_path / "index" / "postings")).where("token = 'oak'").select("_metadata.file_path").distinct().count()
    assert files >= 2  # a frequent token is split by document


def test_embedder_is_loaded_in_the_task(spark):
    rows = spark.createDataFrame([("/a", "h", "abc"), ("/b", "h", None)], "path string, content_hash string, text string")
    got = {r["path"]: r["vector"] for r in search.vector_rows(rows, load=lambda: lambda t: [float(len(t))]).collect()}
    assert got == {"/a": [3.0], "/b": [0.0]}
    plain = {r["path"]: r["vector"] for r in search.vector_rows(rows).collect()}
    assert plain["/a"] == pytest.approx(search.embed_hashed("abc"))


def test_knn_and_scope(spark):
    v = spark.createDataFrame([("/src/core/a", [1.0, 0.0]), ("/src/core/b", [0.0, 1.0]), ("/src/x", [0.9, 0.1])], "path string, vector array<float>")
    assert [r["path"] for r in search.knn(v, [1.0, 0.0], 2).collect()] == ["/src/core/a", "/src/x"]
    assert {r["path"] for r in search.knn(v, [1.0, 0.0], 5, "/src/core").collect()} == {"/src/core/a", "/src/core/b"}
    assert search.knn(v, [1.0, 0.0], 5, "/none").count() == 0
    assert [r["path"] for r in search.knn_like(v, "/src/core/a", 1).collect()] == ["/src/x"]
    assert search.knn_like(v, "/nope", 1).count() == 0
    assert search.knn(v, [1.0, 0.0], 1, metric="cosine").first()["score"] == pytest.approx(1.0)


def test_fusion_and_explanation(spark):
    v = spark.createDataFrame([("/p/auth.rs", 0.82)], "path string, score double")
    f = spark.createDataFrame([("/p/auth.rs", -0.5), ("/q.rs", -0.1)], "path string, rank double")
    hits = search.explained(search.fused(v, f), "Auth token")
    top = search.ranked(hits, 1).first()
    assert top["score"] == pytest.approx(0.82 * 0.7 + 0.3) and top["source"] == "hybrid" and top["matched_terms"] == ["auth"]
    assert top["reasons"] == ["matched in both vector and FTS channels", "path contains query term(s): auth", "high semantic similarity (0.820)", "strong FTS match (score 1.000)"]
    assert search.ranked(hits, 1, 1).first()["source"] == "fts"
    assert search.ranked(hits, 9, 0, spark.createDataFrame([("/q.rs",)], "path string")).count() == 1


@pytest.mark.parametrize(
    "text,want",
    [
        ("auth token validation", ql.ParsedQuery("auth token validation")),
        ("state:dormant stale notes", ql.ParsedQuery("stale notes", state="dormant")),
        ("ext:rs modified>2026-01-01 auth", ql.ParsedQuery("auth", extension="rs", modified_after="2026-01-01")),
        ("ext:.py", ql.ParsedQuery("", extension="py")),
        ("size>5 big files", ql.ParsedQuery("big files", larger_than_mb=5)),
        ("extension:toml config", ql.ParsedQuery("config", extension="toml")),
        ("foo:bar baz", ql.ParsedQuery("foo:bar baz")),
        ("size>x y", ql.ParsedQuery("y")),
        ("state:a state:b", ql.ParsedQuery("", state="b")),
    ],
)
def test_query_language(text, want):
    assert ql.parse(text) == want


def test_saved_queries(spark, tmp_path, entity_rows):
    s = ql.SavedQueries.load(tmp_path / "q" / "queries.json")
    s.save("old", ql.SavedQuery("find", state="dormant", extension="rs"))
    s.save("s", ql.SavedQuery("search", query="auth token", mode="hybrid", limit=10))
    again = ql.SavedQueries.load(tmp_path / "q" / "queries.json")
    assert again.get("old").summary() == "find  state:dormant  ext:rs  limit:20"
    assert again.get("s").summary() == 'search  "auth token"  mode:hybrid  limit:10'
    assert [x["name"] for x in again.list()] == ["old", "s"]
    again.delete("s")
    with pytest.raises(KeyError):
        again.get("s")
    e = entity_rows(("/a.rs", "h", "dormant"), ("/b.rs", "h", "active"))
    assert [r["path"] for r in again.get("old").run(e).collect()] == ["/a.rs"]


def test_budget_keeps_the_crossing_item(spark):
    items = spark.createDataFrame([(i, "/p", "x" * 100) for i in range(5)], "rank int, path string, snippet string")
    assert context.budgeted(items, 0).count() == 2  # 512 at least: 358, then the one that crosses
    got = context.with_snippets([{"path": "/p"}] * 5, 600, lambda p, n: "y" * n)
    assert [len(x["snippet"]) for x in got] == [600]


def make_session(spark, entity_rows, **more):
    e = entity_rows(("/s/graph.rs", "h1"), ("/s/b.rs", "h2"), ("/s/c.rs", "h2"), ("/t/z.rs", "h2"))
    r = edges(spark, ("/s/b.rs", "/s/graph.rs"), ("/t/z.rs", "/s/graph.rs"))
    t = spark.createDataFrame([("/s/graph.rs", "graph.rs", "entity graph"), ("/t/z.rs", "z.rs", "entity graph")], "path string, name string, content string")
    v = t.select("path", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("vector"), F.lit("p").alias("text_preview"))
    return Session(e, r, spark.createDataFrame([], HISTORY), t, v, t.select("path", "content"), embed=lambda q: [1.0, 0.0], **more)


def test_session_scope(spark, entity_rows):
    s = make_session(spark, entity_rows, scope="/s")
    assert all(hasattr(s, t) for t in TOOLS) and len(TOOLS) == 13
    assert s.get_entity("/s/b.rs").count() == 1
    with pytest.raises(PermissionError):
        s.get_entity("/t/z.rs")
    assert [r["paths"] for r in s.find_duplicates().collect()] == [["/s/b.rs", "/s/c.rs"]]
    hits, summary = s.get_impact("/s/graph.rs")
    assert [r["path"] for r in hits.collect()] == ["/s/b.rs"] and summary.first()["risk"] == "low"
    assert [r["path"] for r in s.search_files("graph", mode="fts", explain=True).collect()] == ["/s/graph.rs"]
    assert s.graph_stats().first()["by_lifecycle"] == {"active": 3}
    assert s.get_file_content("/s/graph.rs").first()["chars"] == 12
    pack = s.build_context(path="/s/b.rs", query="graph")
    assert [i["source"] for i in pack["items"]] == ["seed", "hybrid"]
    assert s.entity_resource("/s/none") == "not found: /s/none"
    assert [r["line"] for r in s.entities_resource().collect()] == sorted(r["line"] for r in s.entities_resource().collect()) and s.entities_resource().count() == 3
    plan = s.change_plan("graph", ["/s/graph.rs", "/s/b.rs"])
    assert [(x["path"], x["total"]) for x in plan["impact"]] == [("/s/graph.rs", 1), ("/s/b.rs", 0)] and plan["candidate_files"]
    every = make_session(spark, entity_rows, global_scope=True).change_plan("graph", [])
    assert {x["path"] for x in plan["candidate_files"]} == {x["path"] for x in every["candidate_files"] if x["path"].startswith("/s/")} and every["impact"] == []
    with pytest.raises(PermissionError):
        s.change_plan("graph", ["/t/z.rs"])
    with pytest.raises(ValueError):
        make_session(spark, entity_rows, scope="/s", global_scope=True)


def test_renderings():
    nodes, es = ["a", "b"], [("a", "b", "imports")]
    assert export.render("text", nodes, es, [["a", "b", "a"]]).endswith("cycles detected (1):\n  a -> b -> a\n")
    assert '  "a" -> "b" [label="imports"];' in export.render("dot", nodes, es)
    assert export.render("mermaid", nodes, es) == 'graph TD\n  n0["a"]\n  n1["b"]\n  n0 -->|imports| n1\n'


def test_relations_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Tasks before the first aggregate hold a bounded number of rows, however large the files; edges stay a set."""
    from loam.sources import adapters

    ends = {"lineitem": ("l_orderkey", "l_partkey"), "orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey"), "nation": ("n_nationkey", "n_regionkey")}
    for name, (a, b) in ends.items():
        spark.range(40).selectExpr(f"id div 2 AS {a}", f"id div 4 AS {b}").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(adapters, "EDGE_ROWS", 10)
    asked, real = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *c: asked.append(n) or real(self, n, *c))
    got = [tuple(r) for r in adapters.relations(spark, str(tmp_path)).select("from_path", "to_path", "kind").collect()]
    assert asked == [4, 4, 4, 4]
    assert len([x for x in got if x[2] == "contains"]) == 20 and len([x for x in got if x[2] == "placed_by"]) == 40
    assert ("/order/3", "/part/1", "contains") in got
