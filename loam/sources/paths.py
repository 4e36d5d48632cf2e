"""Which paths are taken in: ignore rules and sensitive files, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.scalars import basename

# Path components that are always ignored.
IGNORED_SEGMENTS = (".git", ".hg", ".svn", "node_modules", "target", ".venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".DS_Store", "dist", "build", ".next", ".nuxt")
# Sensitive directories, and file name patterns in the order in which they are tried.
SENSITIVE_DIRS = (".ssh", ".gnupg", ".aws", ".config/gcloud", "secrets")
SENSITIVE_PATTERNS = (
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.keystore", "*.pkcs12", "*.cer", "*.asc", "*.gpg",
    "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", "id_ecdsa", "id_ecdsa.*", "id_dsa", "id_dsa.*", ".netrc", "credentials",
    "secrets.json", "secrets.yaml", "secrets.yml", "secrets.toml", "secret.json", "secret.yaml", "secret.yml", "secret.toml",
    "*.token", "*.secret", "htpasswd", ".htpasswd",
)


def glob_regex(glob: str, crosses: bool = True) -> str:
    """A regular expression for ``* ? [ ]``; ``crosses`` says whether ``*`` spans ``/``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and not crosses:
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i) and not crosses:
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(".*" if crosses else "[^/]*")
        elif c == "?":
            out.append("." if crosses else "[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class IgnoreSet:
    """Components that are always ignored, further ones, and rules of an ignore file at a root.

    Rules are gitignore lines: the last that matches decides, ``!`` takes back, a trailing ``/``
    stands for directories, a ``/`` elsewhere anchors at the root.
    """

    extra_segments: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    root: str = ""

    def regexes(self) -> list[tuple[str, bool]]:
        out = []
        for line in self.rules:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            line = line[1:] if back else line
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = glob_regex(line.lstrip("/"), crosses=False)
            out.append((rf"^/?{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}$", back))
        return out

    def ignored(self, path: Column) -> Column:
        parts = F.split(path, "/")
        hit = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in IGNORED_SEGMENTS + tuple(self.extra_segments)]))
        rules = self.regexes()
        if not rules:
            return hit
        inside = path.startswith(self.root.rstrip("/") + "/") if self.root else F.lit(True)
        rest = F.substring(path, len(self.root.rstrip("/")) + 1, 1 << 30)
        verdict = reduce(lambda old, r: F.when(rest.rlike(r[0]), F.lit(not r[1])).otherwise(old), rules, F.lit(False))
        return hit | (inside & verdict)


def sensitive_reason(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Why a path is sensitive, or null: directories before name patterns, case aside, first hit wins."""
    low = F.lower(path)
    above = F.concat(F.lit("/"), F.regexp_replace(low, r"[^/]*$", ""))
    name = basename(low)
    tests = [F.when(F.contains(above, F.lit(f"/{d}/")), F.lit(f"in sensitive directory: {d}")) for d in SENSITIVE_DIRS]
    tests += [F.when(name.rlike(f"^(?s:{glob_regex(p.lower())})$"), F.lit(f"matches sensitive pattern: {p}")) for p in SENSITIVE_PATTERNS + tuple(extra)]
    return F.coalesce(*tests)
