"""Exports and renderings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.scalars import csv_field, dot_quote, mermaid_escape
from loam.operators.find import in_scope
from loam.session import cut

CSV_COLUMNS = ("path", "name", "extension", "size_bytes", "created_at", "modified_at", "accessed_at", "lifecycle", "content_hash", "summary", "git_author")
NUMBERS = ("size_bytes", "created_at", "modified_at", "accessed_at")


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """``line``: each row as a JSON object of the columns."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}).alias("line"))


def _pretty(rows: DataFrame, *columns: str) -> DataFrame:
    """``line``: each row as an indented JSON object that a comma follows."""

    def value(c: str) -> Column:
        written = F.to_json(F.array(F.col(c)), {"ignoreNullFields": "false"})  # [value]
        return F.coalesce(F.substring(written, F.lit(2), F.length(written) - 2), F.lit("null"))

    fields = [F.concat(F.lit(f'      "{c}": '), F.when(F.col(c).isNull(), "null").otherwise(value(c))) for c in columns]
    return rows.select(F.concat(F.lit("    {\n"), F.concat_ws(",\n", *fields), F.lit("\n    },")).alias("line"))


def csv_lines(entities: DataFrame) -> DataFrame:
    """``line``: strings quoted, numbers bare, nulls as the empty string."""
    fields: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in NUMBERS else csv_field(F.col(c)) for c in CSV_COLUMNS]
    return entities.select(F.concat_ws(",", *fields).alias("line"))


def dot_lines(paths: DataFrame, relations: DataFrame) -> DataFrame:
    """``line``: nodes and labelled edges of a digraph."""
    nodes = paths.select(F.concat(F.lit("  "), dot_quote(F.col("path")), F.lit(";")).alias("line"))
    edges = relations.select(F.concat(F.lit("  "), dot_quote(F.col("from_path")), F.lit(" -> "), dot_quote(F.col("to_path")), F.lit(" [label="), dot_quote(F.col("kind")), F.lit("];")).alias("line"))
    return nodes.union(edges)


def mermaid_lines(nodes: DataFrame, edges: DataFrame, most: int = 100_000) -> DataFrame:
    """``line`` of a bounded view: aliases number the sorted nodes, so it is one ordered list.

    More than ``most`` nodes are an error, as they would be numbered in one task.
    """
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes: take a neighbourhood, or dot_lines")
    order = Window.partitionBy(F.lit(0)).orderBy("path")
    alias = nodes.select("path", F.concat(F.lit("n"), (F.row_number().over(order) - 1).cast("string")).alias("alias"))
    boxes = alias.select(F.concat(F.lit("  "), "alias", F.lit('["'), mermaid_escape(F.col("path")), F.lit('"]')).alias("line"))
    a = edges.join(alias.select(F.col("path").alias("from_path"), F.col("alias").alias("f")), "from_path", "left")
    b = a.join(alias.select(F.col("path").alias("to_path"), F.col("alias").alias("t")), "to_path", "left")
    arrows = b.select(F.concat(F.lit("  "), F.coalesce("f", F.lit("unknown")), F.lit(" -->|"), mermaid_escape(F.col("kind")), F.lit("| "), F.coalesce("t", F.lit("unknown"))).alias("line"))
    return boxes.union(arrows)


def render(kind: str, nodes: list[str], edges: list[tuple[str, str, str]], cycles: list[list[str]] = ()) -> str:
    """A collected view (50 nodes or so) as text, dot or mermaid."""
    loops = [" -> ".join(c) for c in cycles]
    if kind == "text":
        out = [f"nodes ({len(nodes)}):", *[f"  {n}" for n in nodes]]
        out += ["", f"edges ({len(edges)}):", *[f"  {a} --[{k}]--> {b}" for a, b, k in edges]] if edges else []
        return "\n".join(out + (["", f"cycles detected ({len(loops)}):", *[f"  {c}" for c in loops]] if loops else [])) + "\n"
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if kind == "dot":
        out = ["digraph files {", *[f"  {quote(n)};" for n in nodes], *[f"  {quote(a)} -> {quote(b)} [label={quote(k)}];" for a, b, k in edges], "}"]
        return "\n".join(out + (["// cycles detected:", *[f"// {c}" for c in loops]] if loops else [])) + "\n"
    if kind == "mermaid":
        alias = {n: f"n{i}" for i, n in enumerate(nodes)}
        esc = lambda s: s.replace('"', '\\"')
        out = ["graph TD", *[f'  {alias[n]}["{esc(n)}"]' for n in nodes], *[f"  {alias.get(a, 'unknown')} -->|{esc(k)}| {alias.get(b, 'unknown')}" for a, b, k in edges]]
        return "\n".join(out + (["%% cycles detected:", *[f"%% {c}" for c in loops]] if loops else [])) + "\n"
    raise ValueError(f"unknown rendering: {kind!r}")


def entity_lines(entities: DataFrame) -> DataFrame:
    """``line``: state padded to eight characters and path; sort by it to show."""
    return entities.select(F.concat(F.rpad("lifecycle", 8, " "), F.lit("  "), "path").alias("line"))


def entity_text(entities: DataFrame) -> DataFrame:
    """``path, text``: a ``key: value`` block for each entity."""
    shown = ("path", "name", "extension", "size_bytes", "lifecycle", "created_at", "modified_at", "accessed_at", "content_hash", "summary", "git_author")
    return entities.select("path", F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in shown]).alias("text"))


def archive_plan(entities: DataFrame, prefix: str | None = None, to: str = "/archive") -> DataFrame:
    """``path, target``: where archived entities would move; ``archive_apply`` moves them."""
    rows = entities.where((F.col("lifecycle") == "archived") & in_scope(F.col("path"), prefix))
    return rows.select("path", F.concat(F.lit(to), "path").alias("target"))


def _move(source: str, target: str) -> tuple[str, str | None]:
    """Move one file so that it can be done again: (moved, already, missing, conflict or failed; the error)."""
    import filecmp
    import os
    import shutil

    try:
        if not os.path.lexists(source):
            return ("already" if os.path.lexists(target) else "missing"), None
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if os.path.lexists(target):
            if not filecmp.cmp(source, target, shallow=False):
                return "conflict", None
            os.unlink(source)  # copied before, and stopped before the end
            return "moved", None
        try:
            os.link(source, target)  # fails if another file has come to be there, unlike a rename
        except FileExistsError:
            return "conflict", None
        except OSError:  # another file system, or one without links
            part = f"{target}.part"
            shutil.copy2(source, part)
            os.replace(part, target)
        os.unlink(source)
        return "moved", None
    except OSError as e:
        return "failed", str(e)


def archive_apply(plan: DataFrame) -> DataFrame:
    """``path, target, status, error`` of moving the files of ``plan(path, target)``, on the executors.

    The plan is written first and the moves run once, when this is called. A move can be repeated: what
    a lost task has done counts as ``already``, what it had half done is finished, and a target that
    holds another file is a ``conflict`` and stays. Paths that repeat are moved once. The files must be
    visible to all executors under the same paths.
    """

    def run(batches):
        for b in batches:
            done = [_move(a, t) for a, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([s for s, _ in done]), pa.array([e for _, e in done], pa.string())], names=["path", "target", "status", "error"])

    written = cut(plan.where("path is not null and target is not null").groupBy("path").agg(F.min("target").alias("target")))
    return cut(written.mapInArrow(run, "path string, target string, status string, error string"))


class _Document:
    """One file put together from pieces: strings, and line tables that the executors write.

    Lines are written as parts in their order, and the parts are copied after each other by the file
    system; neither the driver's Python nor one task sees them as a whole.
    """

    def __init__(self, spark, to: str):
        self.spark, self.to = spark, to
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(to).getFileSystem(self.conf)
        self.out = self.fs.create(self.path(f"{to}.unfinished"), True)
        self.temporary: list[str] = []

    def text(self, s: str) -> None:
        self.out.write(s.encode())

    def lines(self, rows: DataFrame, drop_at_end: int = 0) -> bool:
        """Append ``rows(line)`` in their order, without the last bytes of the last one; whether there are any."""
        at = f"{self.to}.parts-{len(self.temporary)}"
        self.temporary.append(at)
        rows.select("line").write.mode("overwrite").text(at)
        parts = sorted((s.getPath().getName(), s) for s in self.fs.listStatus(self.path(at)) if s.getPath().getName().startswith("part-") and s.getLen() > 0)
        copy = self.jvm.org.apache.commons.io.IOUtils.copyLarge  # in blocks
        for i, (_, s) in enumerate(parts):
            source = self.fs.open(s.getPath())
            copy(source, self.out, 0, s.getLen() - (drop_at_end if i == len(parts) - 1 else 0))
            source.close()
        return bool(parts)

    def close(self) -> None:
        self.out.close()
        self.fs.delete(self.path(self.to), False)
        self.fs.rename(self.path(f"{self.to}.unfinished"), self.path(self.to))
        for at in self.temporary:
            self.fs.delete(self.path(at), True)


EXPORTS = ("json", "csv", "dot")


def _pieces(kind: str, entities: DataFrame, relations: DataFrame):
    """The pieces of an export: strings, and (lines in order, bytes to drop at the end, string if there are none)."""
    if kind == "json":
        rels = relations.select(F.col("from_path").alias("from"), F.col("to_path").alias("to"), "kind").orderBy("from", "to", "kind")
        parts = [("entities", _pretty(entities.orderBy("path"), *entities.columns)), ("relations", _pretty(rels, "from", "to", "kind"))]
        yield "{\n"
        for i, (name, lines) in enumerate(parts):
            yield f'  "{name}": ['
            yield lines, 2, "]"
            yield ",\n" if i == 0 else "\n}\n"
    elif kind == "csv":
        yield ",".join(CSV_COLUMNS) + "\n"
        yield csv_lines(entities.orderBy("path")), 0, ""
    else:
        yield "digraph files {\n"
        empty = relations.select(*[F.lit(None).cast("string").alias(c) for c in ("from_path", "to_path", "kind")]).where(F.lit(False))
        yield dot_lines(entities.select("path").orderBy("path"), empty), 0, ""
        yield dot_lines(entities.select("path").where(F.lit(False)), relations.orderBy("from_path", "to_path", "kind")), 0, ""
        yield "}\n"


def write(kind: str, entities: DataFrame, relations: DataFrame, to: str | None = None) -> str | None:
    """Export as ``json``, ``csv`` or ``dot``.

    With ``to``, one file of any size, with its folders, on any file system that Spark reaches: the
    executors write its lines, see ``_Document``. Without, the text is returned, for a terminal, and
    must fit the driver.
    """
    if kind not in EXPORTS:
        raise ValueError(f"unknown export: {kind!r}")
    pieces = _pieces(kind, entities, relations)
    if to is None:
        out = []
        for piece in pieces:
            if isinstance(piece, str):
                out.append(piece)
                continue
            rows, drop, empty = piece
            lines = "".join(f"{r['line']}\n" for r in rows.toLocalIterator())
            out.append(("\n" + lines[: len(lines) - drop] + "\n  ]" if drop else lines) if lines else empty)
        return "".join(out)
    doc = _Document(entities.sparkSession, to)
    for piece in pieces:
        if isinstance(piece, str):
            doc.text(piece)
            continue
        rows, drop, empty = piece
        if drop:
            if rows.isEmpty():
                doc.text(empty)
            else:
                doc.text("\n")
                doc.lines(rows, drop)
                doc.text("\n  ]")
        elif not doc.lines(rows):
            doc.text(empty)
    doc.close()
    return None


def write_lines(lines: DataFrame, to: str) -> None:
    """One file of ``line`` in order, written by the executors and put together by the file system."""
    doc = _Document(lines.sparkSession, to)
    doc.lines(lines)
    doc.close()
