"""Named tables as Parquet generations: readers open the last committed one.

A commit writes the tables that it is given and then one marker file, through the file system that the
root names. The marker says in which generation's folder each table lies, so tables that carry over
are not copied, a reader sees a whole generation or none of it, and a failed commit leaves the old
one. Old generations stay until they are pruned; a folder that a kept one names stays as well.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MARK = "_committed-"


@dataclass
class Catalog:
    spark: SparkSession
    root: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")

    def generations(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removeprefix(MARK)) for n in names if n.startswith(MARK))

    def _folder(self, generation: int, name: str) -> str:
        return f"{self.root.rstrip('/')}/generation-{generation:08d}/{name}"

    def tables(self, generation: int | None = None) -> dict[str, int]:
        """The generation whose folder holds each table of a generation, the last one's by default."""
        known = self.generations()
        if not known:
            raise FileNotFoundError(f"no committed generation under {self.root}")
        fs, _ = self._fs()
        stream = fs.open(self._path(f"{MARK}{known[-1] if generation is None else generation}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._folder(self.tables(generation)[name], name))

    def commit(self, **tables: DataFrame) -> int:
        """Write a new generation; tables that aren't given carry over from the last one where they are."""
        known = self.generations()
        new = (known[-1] if known else 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._folder(new, name))
        held = {**(self.tables() if known else {}), **{name: new for name in tables}}
        out = self._fs()[0].create(self._path(f"{MARK}{new}"), False)
        out.write(json.dumps(held).encode())
        out.close()
        return new

    def prune(self, keep: int = 2) -> list[int]:
        """Delete all but the last ``keep`` generations, markers first, and the folders that no other one names."""
        fs, _ = self._fs()
        known = self.generations()
        gone, kept = known[: -max(1, keep)], known[-max(1, keep) :]
        named = {(g, name) for k in kept for name, g in self.tables(k).items()}
        for g in gone:
            fs.delete(self._path(f"{MARK}{g}"), False)
            top = self._path(f"generation-{g:08d}")
            for s in fs.listStatus(top) if fs.exists(top) else []:
                if (g, s.getPath().getName()) not in named:
                    fs.delete(s.getPath(), True)
            if fs.exists(top) and not fs.listStatus(top):
                fs.delete(top, True)
        return gone
