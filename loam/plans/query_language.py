"""The inline query language, the search dispatcher and saved queries."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators import search as S
from loam.operators.find import FindFilter, build_filter, find
from loam.session import cut


@dataclass(frozen=True)
class ParsedQuery:
    free_text: str = ""
    state: str | None = None
    extension: str | None = None
    modified_after: str | None = None
    created_after: str | None = None
    larger_than_mb: int | None = None

    @property
    def has_filters(self) -> bool:
        return any(x is not None for x in (self.state, self.extension, self.modified_after, self.created_after, self.larger_than_mb))


def _megabytes(x: str) -> int | None:
    return int(x) if x.isascii() and x.removeprefix("+").isdigit() else None


#: Token prefixes, the field each sets, and how its value is read.
FIELDS = {
    "state:": ("state", str),
    "ext:": ("extension", lambda x: x.lstrip(".")),
    "extension:": ("extension", lambda x: x.lstrip(".")),
    "modified>": ("modified_after", str),
    "created>": ("created_after", str),
    "size>": ("larger_than_mb", _megabytes),
}


def parse(text: str) -> ParsedQuery:
    """Field tokens become filters, the last of a kind wins; other tokens are free text."""
    got, free = ParsedQuery(), []
    for token in text.split():
        prefix = next((p for p in FIELDS if token.startswith(p)), None)
        if prefix is None:
            free.append(token)
        else:
            name, read = FIELDS[prefix]
            got = replace(got, **{name: read(token[len(prefix) :])})
    return replace(got, free_text=" ".join(free))


@dataclass(frozen=True)
class Page:
    """A page of hits; ``total`` counts the merged candidates after filters."""

    items: DataFrame
    total: int
    limit: int
    offset: int

    @property
    def has_more(self) -> bool:
        return self.offset + self.limit < self.total


def hybrid(entities: DataFrame, vectors: DataFrame | None, texts: DataFrame | S.TextIndex | None, query: str, limit: int = 10, offset: int = 0, mode: str = "hybrid", scope: str | None = None, metadata: FindFilter | None = None, embed=S.embed_hashed, norm: str = "parity", explain: bool = False, query_vector: list[float] | None = None) -> DataFrame:
    """All merged candidates of a query, filtered but not yet paged; see ``search.fused``.

    ``texts`` is a table, which is scanned, or a stored ``TextIndex``.
    Each channel is cut to its candidate limit before the merge, as the scores depend on it.
    """
    if mode not in ("vector", "fts", "hybrid"):
        raise ValueError(f"unknown mode: {mode!r}")
    filtered = metadata is not None and metadata.active
    most = S.candidate_limit(limit, offset, filtered)
    v = S.knn(vectors, query_vector or embed(query), most, scope) if mode != "fts" and vectors is not None else None
    f = None
    if mode != "vector" and texts is not None:
        f = S.fts_search(texts, query, most, scope)
    hits = S.fused(v, f, mode, norm)
    if filtered:
        hits = hits.join(entities.where(metadata.condition()).select("path").distinct(), "path", "left_semi")
    return S.explained(hits, query, mode) if explain else hits


def search_page(entities, vectors, texts, query: str, limit: int = 10, offset: int = 0, **options) -> Page:
    hits = cut(hybrid(entities, vectors, texts, query, limit, offset, **options))  # bounded by the candidate limit
    return Page(S.ranked(hits, limit, offset), hits.count(), limit, offset)


def dispatch(entities, vectors, texts, expression: str, limit: int = 10, offset: int = 0, now: int | None = None, state=None, extension=None, created_after=None, modified_after=None, **options) -> DataFrame:
    """An expression with inline filters. Filters alone are a metadata search, in which inline state
    and extension and given dates win; with free text, given values win over inline ones."""
    p = parse(expression)
    if not p.free_text and p.has_filters:
        f = build_filter(p.state or state, p.extension or extension, created_after or p.created_after, modified_after or p.modified_after, None, p.larger_than_mb, limit, offset, now)
        return find(entities, f)
    f = build_filter(state or p.state, extension or p.extension, created_after or p.created_after, modified_after or p.modified_after, None, p.larger_than_mb, now=now)
    return S.ranked(hybrid(entities, vectors, texts, p.free_text, limit, offset, metadata=f, **options), limit, offset)


@dataclass(frozen=True)
class SavedQuery:
    kind: str
    query: str | None = None
    mode: str | None = None
    state: str | None = None
    extension: str | None = None
    created_after: str | None = None
    modified_after: str | None = None
    larger_than_mb: int | None = None
    limit: int = 20
    description: str | None = None
    created_at: int = 0

    def summary(self) -> str:
        """The kind and everything that is set, two spaces apart."""
        shown = [("{}", json.dumps(self.query, ensure_ascii=False) if self.query is not None else None), ("state:{}", self.state), ("ext:{}", self.extension), ("mode:{}", self.mode), ("modified>{}", self.modified_after), ("created>{}", self.created_after), ("size>{}mb", self.larger_than_mb), ("limit:{}", self.limit)]
        return "  ".join([self.kind, *[f.format(x) for f, x in shown if x is not None]])

    def run(self, entities, vectors=None, texts=None, **options) -> DataFrame:
        f = build_filter(self.state, self.extension, self.created_after, self.modified_after, None, self.larger_than_mb, self.limit)
        if self.kind == "find":
            return find(entities, f)
        mode = self.mode if self.mode in ("vector", "fts", "hybrid") else "vector"
        return S.ranked(hybrid(entities, vectors, texts, self.query or "", self.limit, mode=mode, metadata=f, **options), self.limit)


def summary_of(rows: DataFrame) -> Column:
    """``SavedQuery.summary`` for a table of saved queries, which has the fields as columns."""

    def shown(label: str, name: str, after: str = "") -> Column:
        value = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
        return F.when(value.isNotNull(), F.concat(F.lit(label), value, F.lit(after)))

    text = F.to_json(F.array(F.col("query").cast("string")))
    query = F.when(F.col("query").isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))
    rest = [shown("state:", "state"), shown("ext:", "extension"), shown("mode:", "mode"), shown("modified>", "modified_after"), shown("created>", "created_after"), shown("size>", "larger_than_mb", "mb"), shown("limit:", "limit")]
    return F.concat_ws("  ", F.col("kind"), query, *rest)


@dataclass
class SavedQueries:
    """Named queries in a JSON file."""

    path: Path
    entries: dict[str, SavedQuery] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> SavedQueries:
        path = Path(path)
        raw = json.loads(path.read_text()) if path.exists() else {}
        return cls(path, {k: SavedQuery(**v) for k, v in raw.items()})

    def _write(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        shown = {k: {a: b for a, b in asdict(q).items() if b is not None} for k, q in sorted(self.entries.items())}
        self.path.write_text(json.dumps(shown, indent=2, ensure_ascii=False) + "\n")

    def save(self, name: str, q: SavedQuery) -> None:
        if q.kind not in ("find", "search"):
            raise ValueError(f"unknown kind: {q.kind!r}")
        self.entries[name] = q
        self._write()

    def get(self, name: str) -> SavedQuery:
        if name not in self.entries:
            raise KeyError(f"no saved query named {name!r}")
        return self.entries[name]

    def delete(self, name: str) -> None:
        self.get(name)
        del self.entries[name]
        self._write()

    def list(self) -> list[dict]:
        return [{"name": k, **{a: b for a, b in asdict(q).items() if b is not None}} for k, q in sorted(self.entries.items())]
