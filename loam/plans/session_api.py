"""A session over a scope: the thirteen tools and two resources, and the change plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators import duplicates, export, find, graph, lifecycle, related, search
from loam.plans import context, query_language
from loam.schema import NOW
from loam.sources.scan import text_of


@dataclass
class Session:
    """Tables behind one scope; ``content(path, content)`` has the files' texts.

    Single-path requests out of scope are an error; sets are filtered.
    """

    entities: DataFrame
    relations: DataFrame
    history: DataFrame
    texts: DataFrame | search.TextIndex | None = None
    vectors: DataFrame | None = None
    content: DataFrame | None = None
    saved: query_language.SavedQueries | None = None
    scope: str | None = None
    global_scope: bool = False
    now: int = NOW
    embed: object = search.embed_hashed

    def __post_init__(self):
        if self.global_scope and self.scope:
            raise ValueError("a global session has no scope")
        self.scope = None if self.global_scope else self.scope
        inside = find.in_scope(F.col("path"), self.scope)
        self._entities = self.entities.where(inside)
        self._relations = self.relations.where(find.in_scope(F.col("from_path"), self.scope) & find.in_scope(F.col("to_path"), self.scope))

    def _allowed(self, path: str) -> str:
        if self.scope and path != self.scope and not path.startswith(self.scope.rstrip("/") + "/"):
            raise PermissionError(f"{path} is outside the scope {self.scope}")
        return path

    def _metadata(self, state, extension, created_after, modified_after) -> find.FindFilter:
        return find.build_filter(state, extension, created_after, modified_after)

    def search_files(self, query, limit=10, path_prefix=None, mode="vector", state=None, extension=None, created_after=None, modified_after=None, explain=False) -> DataFrame:
        scope = find.narrowed_scope(self.scope, path_prefix)
        hits = query_language.hybrid(self._entities, self.vectors, self.texts, query, limit, 0, mode, scope, self._metadata(state, extension, created_after, modified_after), self.embed, explain=explain)
        return search.ranked(hits, limit)

    def build_context(self, query=None, path=None, path_prefix=None, budget_chars=12_000, limit=10, mode="hybrid", state=None, extension=None) -> dict:
        if path is not None:
            self._allowed(path)
        scope = find.narrowed_scope(self.scope, path_prefix) or (path.rsplit("/", 1)[0] if path else "/")
        text = query if query and query.strip() else (path.rsplit("/", 1)[-1].translate(str.maketrans("_-.", "   ")) if path else None)
        hits, total = [], 0
        if text:
            page = query_language.hybrid(self._entities, self.vectors, self.texts, text, limit, 0, mode, scope, self._metadata(state, extension, None, None), self.embed, explain=True)
            total = page.count()
            hits = [r.asDict() for r in search.ranked(page, limit).collect()]
        if self.vectors is not None and hits:
            stored = {r["path"]: r["text_preview"] for r in self.vectors.where(F.col("path").isin([h["path"] for h in hits])).select("path", "text_preview").collect()}
            hits = [{**h, "text_preview": stored.get(h["path"]) if h.get("vector_score") is not None else None} for h in hits]
        hits = context.with_seed(hits, path, scope)
        texts = {r["path"]: r["content"] for r in self.content.where(F.col("path").isin([h["path"] for h in hits])).select("path", F.substring("content", 1, context.EXCERPT_CHARS).alias("content")).collect()} if self.content is not None and hits else {}
        items = context.with_snippets(hits, budget_chars, lambda p, n: texts[p][:n] if texts.get(p) is not None else None)
        if items:
            rows = self.entities.sparkSession.createDataFrame([(i, x["path"]) for i, x in enumerate(items)], "rank int, path string")
            more = {r["path"]: r.asDict(recursive=True) for r in context.enriched(rows, self._entities, self._relations, self.history, scope).collect()}
            items = [{**x, **{k: more[x["path"]][k] for k in ("lifecycle", "summary", "relations", "recent_history")}} for x in items]
        return {"query": text, "seed_path": path, "scope": scope, "budget_chars": budget_chars, "items": items, "total_candidates": total}

    def get_entity(self, path) -> DataFrame:
        return find.by_path(self._entities, self._allowed(path))

    def list_by_lifecycle(self, state, limit=20) -> DataFrame:
        return find.list_by_lifecycle(self._entities, state, limit)

    def graph_stats(self) -> DataFrame:
        return lifecycle.graph_stats(self._entities, self._relations)

    def get_graph(self, path, depth=1) -> tuple[DataFrame, DataFrame]:
        nodes = graph.neighbourhood_nodes(self._relations, self._allowed(path), depth)
        return nodes, graph.neighbourhood_edges(self._relations, nodes, depth, self.scope)

    def get_file_content(self, path) -> DataFrame:
        rows = self.content.where(F.col("path") == self._allowed(path))
        return rows.select("path", text_of(F.col("content")).alias("content")).withColumn("chars", F.length("content"))

    def get_history(self, path, limit=20) -> DataFrame:
        return graph.history_of(self.history, self._allowed(path), limit)

    def get_impact(self, path, depth=5) -> tuple[DataFrame, DataFrame]:
        self._allowed(path)
        hit = graph.reverse_deps(self.relations, path, depth).where(find.in_scope(F.col("path"), self.scope))
        return hit.orderBy("depth", "path"), graph.impact_of(hit, path)

    def find_duplicates(self, limit: int = 50, offset: int = 0, members: int = 100) -> DataFrame:
        """A page of groups, the largest first, each with its first ``members`` paths; ``n`` counts all."""
        return duplicates.duplicate_page(self.entities, self.scope, limit, offset, members)

    def search_similar(self, path, limit=10, path_prefix=None) -> DataFrame:
        return search.knn_like(self.vectors, self._allowed(path), limit, find.narrowed_scope(self.scope, path_prefix))

    def list_saved_queries(self) -> list[dict]:
        return self.saved.list() if self.saved else []

    def run_saved_query(self, name) -> DataFrame:
        return self.saved.get(name).run(self._entities, self.vectors, self.texts, scope=self.scope)

    def entities_resource(self) -> DataFrame:
        """``line`` of every entity, in order; ``export.write_lines`` makes one file of it."""
        return export.entity_lines(self._entities).orderBy("line")

    def entity_resource(self, path) -> str:
        row = export.entity_text(find.by_path(self._entities, self._allowed(path))).head(1)
        return row[0]["text"] if row else f"not found: {path}"

    def change_plan(self, task: str, files: list[str], limit: int = 10, manifests: tuple[str, ...] = ()) -> dict:
        """Candidate files by full text within the scope, impact of the planned files, related tests and commands.

        ``files`` is a stated list; one walk finds the impact of all of them.
        """
        for f in files:
            self._allowed(f)
        candidates = [r.asDict() for r in search.fts_search(self.texts, task, limit, self.scope).collect()] if self.texts is not None else []
        impact: dict[str, dict] = {}
        if files:
            hit = graph.reverse_deps_many(self.relations, files, 3).where(find.in_scope(F.col("path"), self.scope))
            impact = {r["path"]: r.asDict() for r in graph.impact_of_many(hit, files).collect()}
        tests = [r.asDict() for r in related.related_tests(self._entities, self._relations, files, limit).collect()]
        return {
            "task": task,
            "candidate_files": candidates,
            "planned_files": files,
            "impact": [impact[f] for f in files],
            "related_tests": tests,
            "commands": related.test_commands(files, manifests),
            "order": ["candidate_files", "impact", "planned_files", "related_tests", "commands"],  # how the parts are meant to be used
        }


TOOLS = ("search_files", "build_context", "get_entity", "list_by_lifecycle", "graph_stats", "get_graph", "get_file_content", "get_history", "get_impact", "find_duplicates", "search_similar", "list_saved_queries", "run_saved_query")
