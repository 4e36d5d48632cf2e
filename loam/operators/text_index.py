"""A stored full-text index with block-max skipping.

``add`` writes a generation of new or changed texts, ``remove`` one of paths that are gone. A
generation deals its documents to *ranges* of about ``RANGE_DOCS`` by length, and has

* ``postings``: token, path, places, length and range, in files by sorted (token, range, path) whose
  number follows the input, so a frequent token is split by document;
* ``blocks``: for tokens of ``BLOCK_DOCS`` documents or more, each range's number of documents, largest
  count and least length, which bound the token's score there;
* ``terms``: how the number of documents of each token changes, new ones less the ones they replace;
* ``dead``: the replaced rows of earlier generations;
* ``docs``: path, length and distinct tokens, read by ``add`` and ``remove`` only;
* ``totals``: one row with the changes of the number of documents and of their lengths. It is
  written last and makes the generation count.

A query reads the rows of its own tokens. ``top`` takes the ranges by their bounds, scores the best
ones, and then reads only those whose bound reaches the k-th score so far; documents, counts and
lengths are stored sums, so no query groups or counts the corpus. What the driver holds is the
generations' totals, and for ``top`` a number for each range that has all of the query's words.

Edge cases: null names and texts have no words; a text without words counts as a document; of rows
that repeat a path in one ``add`` the greatest name and text stay; an index without a generation
matches nothing; a generation whose writing failed doesn't count and is overwritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.find import in_scope
from loam.session import cut

RANGE_DOCS = 100_000
FILE_ROWS = 5_000_000
BLOCK_DOCS = 1_000
FIRST_RANGES = 4
BROADCAST_ROWS = 200_000
BREAK = 1_000_000_000  # between a name's places and its content's, so that no phrase spans both

SCHEMAS = {
    "postings": "token string, path string, tf int, places array<int>, dl long, range int",
    "blocks": "token string, range int, n long, tf int, dl long",
    "terms": "token string, df long",
    "dead": "path string, of int",
    "docs": "path string, dl long, tokens array<string>",
    "totals": "docs long, words long, dead long, ranges int, replaces array<int>",
}


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - F.lit(by))


def _postings(texts: DataFrame, *head: str) -> DataFrame:
    """``head, token, places``: the tokens in ``n`` and ``c`` with their sorted places.

    A text's tokens are sorted in its own row and cut into runs, so only finished postings leave it.
    """
    at = lambda tokens, by: F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (i + F.lit(by)).alias("at")))
    marks = texts.select(*head, F.sort_array(F.concat(at(F.col("n"), 0), at(F.col("c"), BREAK))).alias("s"))
    new = lambda x, i: F.when((i == 0) | (x["token"] != F.get(F.col("s"), i - 1)["token"]), i)
    runs = marks.select(*head, "s", F.array_compact(F.transform("s", new)).alias("starts"))
    end = lambda j: F.coalesce(F.get(F.col("starts"), j + 1), F.size("s"))
    run = lambda b, j: F.struct(F.get(F.col("s"), b)["token"].alias("token"), F.slice(F.col("s"), b + 1, end(j) - b)["at"].alias("places"))
    return runs.select(*head, F.explode(F.transform("starts", run)).alias("x")).select(*head, "x.token", "x.places")


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.read_ranges = self.all_ranges = 0  # of the last ``top``

    # --- storage

    def _path(self, part: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}".rstrip("/"))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[dict]:
        """The committed generations' totals, the oldest first."""
        if not self._fs().exists(self._path("totals")):
            return []
        rows = self.spark.read.schema(SCHEMAS["totals"] + ", generation int").parquet(f"{self.folder}/totals").collect()
        gone = {g for r in rows for g in r["replaces"]}
        return sorted((r.asDict() for r in rows if r["generation"] not in gone), key=lambda r: r["generation"])

    def _read(self, part: str, generations: list[int]) -> DataFrame:
        """Rows of the given generations, with ``generation``."""
        folders = [f"{self.folder}/{part}/generation={g}" for g in generations if self._fs().exists(self._path(f"{part}/generation={g}"))]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[part] + ", generation int")
        return self.spark.read.schema(SCHEMAS[part] + ", generation int").option("basePath", f"{self.folder}/{part}").parquet(*folders)

    def _write(self, part: str, generation: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part}/generation={generation}")

    def _next(self) -> int:
        fs, top = self._fs(), self._path("totals")
        known = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top) if "=" in s.getPath().getName()] if fs.exists(top) else []
        return max(known, default=0) + 1

    # --- changes

    def add(self, texts: DataFrame) -> None:
        """Index ``texts(path, name, content)``, in place of what the index has of their paths."""
        from loam.operators.search import tokens_of

        one = texts.groupBy("path").agg(F.max(F.struct("name", "content")).alias("t"))
        split = one.select("path", tokens_of(F.coalesce("t.name", F.lit(""))).alias("n"), tokens_of(F.coalesce("t.content", F.lit(""))).alias("c"))
        self._commit(split.select("path", "n", "c", (F.size("n") + F.size("c")).cast("long").alias("dl")))

    def remove(self, paths: DataFrame) -> None:
        self._commit(None, paths.select("path").distinct())

    def documents(self) -> DataFrame:
        """``path, dl, generation, tokens`` of what counts."""
        known = self.generations()
        rows = self._read("docs", [g["generation"] for g in known])
        return self._alive(rows, known)

    def _alive(self, rows: DataFrame, known: list[dict]) -> DataFrame:
        """Without the rows that a later generation has replaced."""
        n = sum(g["dead"] for g in known)
        if not n:
            return rows
        dead = self._read("dead", [g["generation"] for g in known]).select("path", F.col("of").alias("generation"))
        return rows.join(F.broadcast(dead) if n <= BROADCAST_ROWS else dead, ["path", "generation"], "left_anti")

    def _commit(self, split: DataFrame | None, gone: DataFrame | None = None) -> None:
        generation = self._next()
        n_new = words = n_ranges = 0
        changes = []
        if split is not None:
            fresh = cut(split)
            n_new, words = fresh.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n_ranges = max(1, -(-n_new // RANGE_DOCS))
            placed = cut(fresh.repartitionByRange(n_ranges, "dl", "path").withColumn("range", F.spark_partition_id())) if n_ranges > 1 else fresh.withColumn("range", F.lit(0))
            self._write("docs", generation, fresh.select("path", "dl", F.array_distinct(F.concat("n", "c")).alias("tokens")))
            head = ["path", "dl", "range"]
            postings = cut(_postings(placed, *head).select("token", "path", F.size("places").alias("tf"), "places", "dl", "range"))
            changes.append(self._place(generation, postings).select("token", F.col("n").alias("df")))
            gone = fresh.select("path")
        old = cut(self.documents().join(gone, "path", "left_semi").select("path", "dl", "generation", "tokens"))
        n_old, old_words = old.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._write("dead", generation, old.select("path", F.col("generation").alias("of")))
        changes.append(old.select(F.explode("tokens").alias("token"), F.lit(-1).cast("long").alias("df")))
        terms = reduce(lambda a, b: a.unionByName(b), changes).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        self._write("terms", generation, terms.repartitionByRange("token").sortWithinPartitions("token"))
        self._finish(generation, n_new - n_old, words - old_words, n_old, n_ranges, [])

    def _place(self, generation: int, postings: DataFrame) -> DataFrame:
        """Write postings in sorted files, and the blocks of the frequent tokens; returns those of all tokens."""
        files = max(1, -(-postings.count() // FILE_ROWS))
        self._write("postings", generation, postings.repartitionByRange(files, "token", "range", "path").sortWithinPartitions("token", "range", "path"))
        block = cut(postings.groupBy("token", "range").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl")))
        often = block.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= BLOCK_DOCS).select("token")
        self._write("blocks", generation, block.join(often, "token", "left_semi").repartitionByRange("token").sortWithinPartitions("token"))
        return block

    def _finish(self, generation: int, docs: int, words: int, dead: int, ranges: int, replaces: list[int]) -> None:
        row = [(int(docs), int(words), int(dead), int(ranges), replaces)]
        self._write("totals", generation, self.spark.createDataFrame(row, SCHEMAS["totals"]).coalesce(1))

    def compact(self) -> None:
        """One generation of what counts, in place of all; the old ones' files are removed after it counts."""
        known = self.generations()
        if not known:
            return
        olds, generation = [g["generation"] for g in known], self._next()
        docs = cut(self.documents())
        n, words = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        ranges = max(1, -(-n // RANGE_DOCS))
        self._write("docs", generation, docs.select("path", "dl", "tokens"))
        held = self._alive(self._read("postings", olds), known).drop("range", "generation")
        if ranges > 1:
            placed = cut(docs.select("path", "dl").repartitionByRange(ranges, "dl", "path").select("path", F.spark_partition_id().alias("range")))
            held = held.join(placed, "path")
        else:
            held = held.withColumn("range", F.lit(0))
        postings = cut(held.select("token", "path", "tf", "places", "dl", "range"))
        block = self._place(generation, postings)
        self._write("terms", generation, block.groupBy("token").agg(F.sum("n").alias("df")).repartitionByRange("token").sortWithinPartitions("token"))
        self._finish(generation, n, words, 0, ranges, olds)
        for part in SCHEMAS:
            for g in olds:
                self._fs().delete(self._path(f"{part}/generation={g}"), True)

    # --- queries

    def postings(self, tokens: list[str], known: list[dict] | None = None) -> DataFrame:
        """``token, path, tf, places, dl, range, generation`` of the tokens' rows that count."""
        known = self.generations() if known is None else known
        rows = self._read("postings", [g["generation"] for g in known]).where(F.col("token").isin(tokens))
        return self._alive(rows, known)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "path string, rank double")

    def frequencies(self, tokens: list[str], known: list[dict]) -> dict[str, int]:
        """Documents of each token: sums of the stored changes."""
        rows = self._read("terms", [g["generation"] for g in known]).where(F.col("token").isin(tokens)).groupBy("token").agg(F.sum("df").alias("df")).collect()
        return {t: 0 for t in tokens} | {r["token"]: int(r["df"]) for r in rows}

    def _ranked(self, rows: DataFrame, phrases: list[list[str]], known: list[dict], df: dict[str, int]) -> DataFrame:
        """``path, rank`` of postings that hold all phrases."""
        from loam.operators.search import _bm25

        n_docs, words = (sum(g[c] for g in known) for c in ("docs", "words"))
        tokens = sorted({w for p in phrases for w in p})
        by_doc = rows.groupBy("path").agg(F.max("dl").alias("dl"), *[F.max(F.when(F.col("token") == w, F.struct("tf", "places"))).alias(f"w{i}") for i, w in enumerate(tokens)])

        def count(phrase: list[str]) -> Column:
            at = [F.col(f"w{tokens.index(w)}") for w in phrase]
            if len(at) == 1:
                return F.coalesce(at[0]["tf"], F.lit(0))
            starts = [_moved(x["places"], i) for i, x in enumerate(at)]
            return F.coalesce(F.size(reduce(F.array_intersect, starts)), F.lit(0))

        counted = by_doc.select("path", "dl", *[count(p).cast("long").alias(f"tf{i}") for i, p in enumerate(phrases)])
        all_there = reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(phrases))])
        numbers: list[Column] = [F.lit(df[p[0]]) for p in phrases]
        if any(len(p) > 1 for p in phrases):  # how many hold a phrase isn't stored
            counted = cut(counted)
            n = counted.agg(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(phrases))]).first()
            numbers = [F.lit(int(n[i])) if len(p) > 1 else numbers[i] for i, p in enumerate(phrases)]
        parts = [_bm25(F.col(f"tf{i}"), numbers[i], F.col("dl"), F.lit(n_docs), F.lit(words / n_docs if n_docs else 0.0)) for i in range(len(phrases))]
        return counted.where(all_there).select("path", (-reduce(lambda a, b: a + b, parts)).alias("rank"))

    def match(self, query: str) -> DataFrame:
        """What ``search.fts_match`` gives for the texts that the index holds."""
        from loam.operators.search import query_phrases

        phrases = list({" ".join(p): p for p in query_phrases(query)}.values())
        known = self.generations()
        if not phrases or not known:
            return self._none()
        words = sorted({w for p in phrases for w in p})
        df = self.frequencies(words, known)
        if not all(df.values()):
            return self._none()
        return self._ranked(self.postings(words, known), phrases, known, df)

    def top(self, query: str, k: int = 10, scope: str | None = None) -> DataFrame:
        """``path, rank``: the ``k`` best matches within ``scope``, ties by path.

        A query of single words skips ranges by their bounds. One with a phrase reads all rows of its
        tokens, as the number of documents with the phrase follows from them.
        """
        from loam.operators.search import query_phrases

        best = lambda hits: hits.where(in_scope(F.col("path"), scope)).orderBy("rank", "path").limit(k)
        phrases = list({" ".join(p): p for p in query_phrases(query)}.values())
        known = self.generations()
        if not phrases or not known or any(len(p) > 1 for p in phrases):
            return best(self.match(query))
        words = [p[0] for p in phrases]
        df = self.frequencies(words, known)
        if not all(df.values()):
            return self._none()
        ranges = self._bounded(words, known, df)
        self.all_ranges, self.read_ranges = sum(g["ranges"] for g in known), 0

        def among(chosen: list[tuple]) -> DataFrame:
            self.read_ranges += len(chosen)
            by: dict[int, list[int]] = {}
            for _, g, r in chosen:
                by.setdefault(g, []).append(r)
            inside = reduce(lambda a, b: a | b, [(F.col("generation") == g) & F.col("range").isin(rs) for g, rs in by.items()])
            rows = self._read("postings", sorted(by)).where(F.col("token").isin(words) & inside)
            return best(self._ranked(self._alive(rows, known), phrases, known, df))

        first, rest = ranges[:FIRST_RANGES], ranges[FIRST_RANGES:]
        if not first:
            return self._none()
        if not rest:
            return among(first)
        found = cut(among(first))
        ranks = sorted(r["rank"] for r in found.select("rank").collect())  # k at most
        # a small allowance for the rounding of bounds
        rest = [r for r in rest if r[0] >= -ranks[k - 1] * (1 - 1e-9)] if len(ranks) >= k else rest
        return best(found.unionByName(among(rest))) if rest else found

    def _bounded(self, words: list[str], known: list[dict], df: dict[str, int]) -> list[tuple[float, int, int]]:
        """(bound of the score, generation, range) of the ranges that may hold all words, the best first."""
        from loam.operators.search import _bm25

        n_docs, total = (sum(g[c] for g in known) for c in ("docs", "words"))
        numbers = F.create_map(*[F.lit(x) for w in words for x in (w, df[w])])
        ids = [g["generation"] for g in known]
        score = _bm25(F.col("tf"), numbers[F.col("token")], F.col("dl"), F.lit(n_docs), F.lit(total / n_docs if n_docs else 0.0))
        rows = self._read("blocks", ids).where(F.col("token").isin(words)).select("token", "generation", "range", score.alias("most")).collect()
        bound = {(r["token"], r["generation"], r["range"]): r["most"] for r in rows}
        listed = {(t, g) for t, g, _ in bound}  # where a token is frequent, a range without a block hasn't got it
        least = self.spark.range(1).select(*[_bm25(F.lit(1e12), F.lit(df[w]), F.lit(0), F.lit(n_docs), F.lit(1.0)).alias(f"m{i}") for i, w in enumerate(words)]).first()
        out = []
        for g in known:
            for r in range(g["ranges"]):
                parts = [bound.get((w, g["generation"], r)) if (w, g["generation"]) in listed else least[i] for i, w in enumerate(words)]
                if all(p is not None for p in parts):
                    out.append((sum(parts), g["generation"], r))
        return sorted(out, key=lambda x: (-x[0], x[1], x[2]))
