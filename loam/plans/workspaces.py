"""The workspace registry: named roots in a JSON file, found by the longest prefix."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Workspace:
    id: str
    name: str
    path: str
    created_at: int = 0
    updated_at: int = 0


def slugify(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "workspace"


@dataclass
class Registry:
    file: Path
    default: str | None = None
    workspaces: list[Workspace] = field(default_factory=list)

    @classmethod
    def load(cls, file: str | Path) -> Registry:
        file = Path(file)
        raw = json.loads(file.read_text()) if file.exists() else {}
        return cls(file, raw.get("default"), [Workspace(**w) for w in raw.get("workspaces", [])])

    def write(self) -> None:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        self.file.write_text(json.dumps({"default": self.default, "workspaces": [asdict(w) for w in self.workspaces]}, indent=2) + "\n")

    def add(self, name: str, path: str, now: int = 0) -> Workspace:
        """Register a root, or update the one with the same path."""
        path = path.rstrip("/") or "/"
        for w in self.workspaces:
            if w.path == path:
                w.name, w.updated_at = name, now
                self.write()
                return w
        base = f"{slugify(name)}-{hashlib.sha256(path.encode()).hexdigest()[:12]}"
        taken, k = {w.id for w in self.workspaces}, 2
        new = base
        while new in taken:
            new, k = f"{base}-{k}", k + 1
        self.workspaces.append(Workspace(new, name, path, now, now))
        self.default = self.default or new
        self.write()
        return self.workspaces[-1]

    def resolve(self, path: str) -> Workspace | None:
        """The deepest workspace that is the path or above it, else the default."""
        above = [w for w in self.workspaces if path == w.path or path.startswith(w.path.rstrip("/") + "/")]
        if above:
            return max(above, key=lambda w: len(w.path.split("/")))
        return next((w for w in self.workspaces if w.id == self.default), None)
