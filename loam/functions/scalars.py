"""Scalar functions of the model, as column expressions."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_ts(seconds: Column) -> Column:
    """``2024-02-01 00:00 UTC``."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def human_bytes(n: Column) -> Column:
    """1024-based size with one decimal, ties to even."""
    units = [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for size, unit in reversed(units):
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(size)), 1))).otherwise(out)
    return out


def hash_prefix(h: Column, n: int = 16) -> Column:
    return F.substring(h, 1, n)


def is_pseudo_hash(h: Column) -> Column:
    """Hashes that stand for a size, of files too large to read."""
    return F.coalesce(h.startswith("size:"), F.lit(False))


def truncate_bytes(text: Column, n: int) -> Column:
    """The longest prefix of whole characters within ``n`` UTF-8 bytes.

    Cut after ``n`` bytes; if the cut splits a character, the bytes of that character go.
    """
    raw = F.substring(text.cast("binary"), 1, n)
    cut = F.regexp_replace(F.hex(raw), r"^((?:[0-7].|[CD]...|E.....|F.......)*)(?:[C-F](?:..)*.?)?$", "$1")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.unhex(cut), "UTF-8"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """What follows the last dot, if anything stands before it; else null."""
    e = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(e != "", e)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def query_hint(name: Column) -> Column:
    """A file name as words."""
    return F.translate(name, "_-.", "   ")


def excerpt(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def preview(text: Column, n: int = 500) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))


def csv_field(x: Column) -> Column:
    """Always quoted; null is the empty field."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def dot_quote(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def mermaid_escape(x: Column) -> Column:
    return F.replace(x, F.lit('"'), F.lit('\\"'))


def normal_extension(ext: str | None) -> str | None:
    return ext.lstrip(".") if ext is not None else None


def slugify(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit("workspace")).otherwise(s)


def unique_id(name: Column, path: Column) -> Column:
    """Slug and 12 hex digits of the path's hash."""
    return F.concat(slugify(name), F.lit("-"), F.substring(F.sha2(path, 256), 1, 12))


def risk_level(total: Column) -> Column:
    return F.when(total == 0, "none").when(total <= 3, "low").when(total <= 10, "medium").otherwise("high")


def least_rotation(cycle: Column) -> Column:
    """The smallest rotation of an array: the canonical key of a cycle."""
    n = F.size(cycle)
    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.slice(cycle, i + 1, n), F.slice(cycle, F.lit(1), i))))


def parse_date(x: str) -> int:
    """``YYYY-MM-DD`` as UTC midnight in epoch seconds; a ValueError if it isn't one."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", x):
        raise ValueError(f"not a date (YYYY-MM-DD): {x!r}")
    return int(datetime.strptime(x, "%Y-%m-%d").replace(tzinfo=UTC).timestamp())


def parse_date_column(x: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(x, "yyyy-MM-dd"))
