"""Secret scans over a trigram index, with DataFrame functions only.

Each rule is a regular expression. Its *trigram query*, an AND/OR tree over trigrams (A-Z
lower-cased), is derived from the parsed expression (``trigram_query``): what every match must
contain, from literals, small classes (``[Pp]``), alternatives, optional and repeated parts and the
seams between them. The index holds one posting ``(trigram, document)`` for every trigram of any
query that a document has. Postings are intersected by document: the trigrams that it has decide the
tree, and only documents for which it holds are verified with the rule's expression. A rule without
mandatory trigrams, or one that the parser doesn't know, scans every document.

Postings hold no text; ``postings`` can be written once and passed to ``scan`` as ``index``. Without
it they are made for the call, which reads the texts twice. The candidates' ids are broadcast if
there are at most ``BROADCAST_IDS`` (counted first), else the documents are joined with them by id;
an id repeated over different texts or a null id only widens the candidates, never the result.

A text is read whole. Matches are leftmost and non-overlapping in each kind; those that fail the
rule's length are dropped afterwards, so what they covered stays covered. Positions are code points
with exclusive ends. Work is linear in a text's length and in its spans up to the blocks of
``running`` and ``PIECE``.

Edge cases: a null text is empty; null ids are kept and compared null-safely; repeated rows are
scanned one by one; spans with one start are ordered as the rules are; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.session import cut

BROADCAST_IDS = 1_000_000
RUN = 256  # elements of a running fold that are put together at a time
PIECE = 4096  # characters of a text that a span's text is cut from
SET = 24  # strings that the derivation of a trigram query keeps apart
ALL = ("all",)  # the query that every document satisfies


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched; ``least`` is the shortest ``group`` that counts.

    ``guard`` is a cheap necessary condition for a rule that scans fully.
    """

    kind: str
    pattern: str
    group: int
    least: int
    guard: str | None = None


RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)


@dataclass(frozen=True)
class Part:
    """What is known of the strings that a part of an expression matches, in lower case.

    ``exact`` are all of them, if they are few; else each begins with one of ``heads`` and ends with
    one of ``tails``, and ``query`` holds for each.
    """

    exact: frozenset[str] | None
    heads: frozenset[str] = frozenset([""])
    tails: frozenset[str] = frozenset([""])
    query: tuple = ALL


ANY = Part(None)
EMPTY = Part(frozenset([""]))


def both(a: tuple, b: tuple) -> tuple:
    parts = [x for q in (a, b) for x in (q[1:] if q[0] == "and" else [q]) if q != ALL]
    parts = list(dict.fromkeys(parts))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def either(queries: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(x for q in queries for x in (q[1:] if q[0] == "or" else [q])))
    if ALL in parts or not parts:
        return ALL
    needs = [set(q[1:]) if q[0] == "and" else {q} for q in parts]
    parts = [q for q, own in zip(parts, needs) if not any(other < own for other in needs)]  # what asks for more adds nothing
    return parts[0] if len(parts) == 1 else ("or", *parts)


def contains_one(strings) -> tuple:
    """The query of a text that has one of the strings in it."""
    out = []
    for s in sorted(strings):
        q = ALL
        for i in range(len(s) - 2):
            if s[i : i + 3].isascii():
                q = both(q, ("has", s[i : i + 3]))
        out.append(q)
    return either(out)


def _loosened(p: Part) -> Part:
    """``p`` without its exact strings, which go into heads, tails and the query."""
    if p.exact is None:
        return p
    heads, tails = frozenset(s[:2] for s in p.exact), frozenset(s[-2:] for s in p.exact)
    few = lambda x: x if len(x) <= SET else frozenset([""])
    return Part(None, few(heads), few(tails), contains_one(p.exact))


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= SET:
        return Part(frozenset(x + y for x, y in product(a.exact, b.exact)))
    x, y = _loosened(a), _loosened(b)
    query = both(x.query, y.query)
    seam_a, seam_b = a.exact if a.exact is not None else x.tails, b.exact if b.exact is not None else y.heads
    if len(seam_a) * len(seam_b) <= SET:
        query = both(query, contains_one(s + t for s, t in product(seam_a, seam_b)))
    cut_off = lambda strings, side: frozenset(s[:2] if side else s[-2:] for s in strings)
    heads = cut_off((s + t for s, t in product(a.exact, y.heads)), True) if a.exact is not None and len(a.exact) * len(y.heads) <= SET else x.heads
    tails = cut_off((s + t for s, t in product(x.tails, b.exact)), False) if b.exact is not None and len(b.exact) * len(x.tails) <= SET else y.tails
    if a.exact is None and "" in x.heads:
        heads = frozenset([""])
    if b.exact is None and "" in y.tails:
        tails = frozenset([""])
    return Part(None, heads if len(heads) <= SET else frozenset([""]), tails if len(tails) <= SET else frozenset([""]), query)


def _or(parts: list[Part]) -> Part:
    exact = frozenset().union(*(p.exact or frozenset() for p in parts))
    if all(p.exact is not None for p in parts) and len(exact) <= SET:
        return Part(exact)
    loose = [_loosened(p) for p in parts]
    heads, tails = (frozenset().union(*(getattr(p, side) for p in loose)) for side in ("heads", "tails"))
    few = lambda x: x if len(x) <= SET and "" not in x else frozenset([""])
    return Part(None, few(heads), few(tails), either([p.query for p in loose]))


def _low(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _parsed(items, folded: bool) -> Part:
    """The part that a parsed sequence stands for."""
    out = EMPTY
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            # letters beyond ASCII have several forms in other cases, and the index folds them its own way
            part = Part(frozenset([_low(arg)])) if arg < 128 and not (folded and _low(arg) in "ks") else ANY
        elif name == "IN":
            part = _class(arg, folded)
        elif name == "BRANCH":
            part = _or([_parsed(x, folded) for x in arg[1]])
        elif name == "SUBPATTERN":
            _, add, remove, inner = arg
            part = ANY if add or remove else _parsed(inner, folded)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            one = _parsed(inner, folded)
            if least == 0:
                part = Part(one.exact | {""}) if int(most) == 1 and one.exact is not None and len(one.exact) < SET else ANY
            else:
                part = one
                for _ in range(min(least, 8) - 1):
                    part = _then(part, one)
                if least > 8 or int(most) != least:
                    loose = _loosened(part)
                    part = Part(None, loose.heads, loose.tails, loose.query)
        elif name == "ATOMIC_GROUP":
            part = _parsed(arg, folded)
        elif name == "AT":
            part = EMPTY
        else:  # any character, negated ones, references, assertions: nothing is known
            part = EMPTY if name in ("ASSERT", "ASSERT_NOT") else ANY
        out = _then(out, part)
    return out


def _class(members, folded: bool) -> Part:
    found: set[str] = set()
    for op, arg in members:
        name = str(op)
        codes = [arg] if name == "LITERAL" else range(arg[0], arg[1] + 1) if name == "RANGE" else None
        if codes is None or codes[-1] >= 128 or len(codes) > 2 * SET:
            return ANY
        found |= {_low(c) for c in codes}
    return ANY if len(found) > SET or (folded and found & {"k", "s"}) else Part(frozenset(found))


def trigram_query(rule: Rule) -> tuple:
    """What every match of the rule contains: ``("has", trigram)``, ``("and", ...)``, ``("or", ...)`` or ``ALL``.

    The expression is read by Python's parser. What that doesn't read, or reads with a warning
    (constructs that other dialects take in another way), has no query and scans fully.
    """
    from re import _parser

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        try:
            tree = _parser.parse(rule.pattern)
        except Exception:
            return ALL
    if "&&" in rule.pattern or tree.state.flags & ~(_parser.SRE_FLAG_IGNORECASE | _parser.SRE_FLAG_UNICODE):
        return ALL
    return _loosened(_parsed(tree, bool(tree.state.flags & _parser.SRE_FLAG_IGNORECASE))).query


def trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*map(trigrams, query[1:]))


def holds(query: tuple, has) -> Column:
    """The tree as a column; ``has`` makes the column of a trigram."""
    if query[0] == "has":
        return has(query[1])
    out = holds(query[1], has)
    for q in query[2:]:
        out = out & holds(q, has) if query[0] == "and" else out | holds(q, has)
    return out


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(trigram, doc_id)``: the inverted index over the trigrams that the rules ask for."""
    vocabulary = sorted(set().union(*(trigrams(trigram_query(r)) for r in rules)))
    low = F.lower(F.col("text"))  # folds more than A-Z, which only widens the candidates
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in vocabulary]).cast("array<string>"))
    return docs.where(F.col("text").isNotNull()).select("doc_id", low.alias("low")).select("doc_id", F.explode(present).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, kinds)``: documents that satisfy the trigram query of a rule, by intersected postings."""
    own = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("own"))  # at most the rules' trigrams
    asked = [(r.kind, q) for r in rules if (q := trigram_query(r)) != ALL]
    kinds = [F.when(holds(q, lambda t: F.array_contains("own", t)), F.lit(kind)) for kind, q in asked]
    return own.select("doc_id", F.array_compact(F.array(*kinds).cast("array<string>")).alias("kinds")).where(F.size("kinds") > 0)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, fold) -> Column:
    """What ``fold`` makes of the elements before each one, for an associative fold over longs.

    Blocks of ``RUN`` are folded one by one from what comes before them, so nothing long is copied
    for every element. ``values`` should be cheap to name more than once.
    """
    nil = F.expr("cast(array() as array<bigint>)")

    def before(items: Column, start: Column) -> Column:
        begun = F.struct(nil.alias("out"), start.alias("at"))
        step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), fold(acc["at"], x).alias("at"))
        return F.aggregate(items, begun, step)["out"]

    def blocked(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, fold))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), before(totals, zero).alias("start")), lambda p: before(p["part"], p["start"])))

    last = F.floor((F.size(values) - 1) / F.lit(RUN)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))
    return F.when(F.size(values) > RUN, let(parts, blocked)).otherwise(before(values, zero))


def spans_of(text: Column, rule: Rule, nth: int) -> Column:
    """``array<struct<start, kind number, end>>`` of a rule's matches in ``text``.

    The text falls into pieces between matches; a match starts after the pieces and matches before it.
    """
    pattern = F.lit(rule.pattern)
    length = lambda m: F.length(m).cast("long")
    sizes = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), length)
    gaps = F.transform(F.split(text, rule.pattern, -1), length)  # one more than matches
    rows = F.arrays_zip(gaps.alias("gap"), sizes(0).alias("len"), *([sizes(rule.group).alias("part")] if rule.group else []))
    rows = F.filter(rows, lambda r: r["len"].isNotNull())

    def found(r: Column) -> Column:
        def span(x):
            start = x["before"] + x["row"]["gap"]
            return F.struct(start.alias("start"), F.lit(nth).alias("kind"), (start + x["row"]["len"]).alias("end"))

        steps = let(F.transform(r, lambda x: x["gap"] + x["len"]), lambda v: running(v, F.lit(0).cast("long"), lambda a, b: a + b))
        return F.transform(F.filter(F.arrays_zip(r.alias("row"), steps.alias("before")), lambda x: x["row"]["part" if rule.group else "len"] >= rule.least), span)

    return let(rows, found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), name: str = "spans", index: DataFrame | None = None) -> DataFrame:
    """The columns in ``keep`` and, under ``name``, ``array<struct<start, kind, end>>`` by start, then kind."""
    found = cut(candidates(postings(docs, rules) if index is None else index, rules))
    n = found.count()
    tagged = docs.alias("d").join(F.broadcast(found.alias("c")) if n <= BROADCAST_IDS else found.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left")
    cols = list(dict.fromkeys(keep))
    # what is kept stays in one struct, so its columns may have any name
    base = tagged.select(F.struct(*[F.col(f"d.`{c}`").alias(c) for c in cols]).alias("kept"), F.coalesce(F.col("d.text"), F.lit("")).alias("text"), F.col("c.kinds").alias("kinds"))
    nil = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    for i, r in enumerate(rules):
        may = F.array_contains(F.col("kinds"), r.kind) if trigram_query(r) != ALL else F.lit(True)
        if r.guard:
            may = may & F.col("text").rlike(r.guard)
        base = base.withColumn(f"k{i}", F.when(may, spans_of(F.col("text"), r, i)).otherwise(nil))
    return base.select(*[F.col(f"kept.`{c}`").alias(c) for c in cols], F.array_sort(F.concat(*[F.col(f"k{i}") for i in range(len(rules))])).alias(name))


def named(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_<kind>..., base_sha256, spans``."""
    found = scan(docs, rules).withColumn("text_spans", named(F.col("spans"), rules))

    def count(k: int) -> Column:
        return F.size(F.filter(F.col("spans"), lambda s: s["kind"] == k)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    return found.select("doc_id", *counts, F.sha2(F.col("text_spans").cast("binary"), 256).alias("base_sha256"), F.col("text_spans").alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans of different kinds become one.

    All columns stay; a null text stays null.
    """
    cols = docs.columns
    work = "_spans" + "_" * max(map(len, cols))  # longer than any of theirs
    found = scan(docs, rules, tuple(cols), work)

    zero = F.lit(0).cast("long")

    def clean(blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:  # of the blocks that it lies in, not of the whole text
            first, last = F.floor(start / F.lit(PIECE)).cast("int"), F.floor((end - 1) / F.lit(PIECE)).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.when(end > start, F.substring(near, (start - first * F.lit(PIECE) + 1).cast("int"), (end - start).cast("int"))).otherwise("")

        reach = let(F.transform(work, lambda s: s["end"]), lambda v: running(v, zero, lambda a, b: F.greatest(a, b)))
        rows = F.filter(F.arrays_zip(F.col(work).alias("s"), reach.alias("reach")), lambda r: r["s"]["start"] >= r["reach"])
        kept = F.transform(rows, lambda r: F.concat(piece(r["reach"], r["s"]["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), piece(F.array_max(F.transform(work, lambda s: s["end"])), F.length("text").cast("long")))

    whole = let(F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), clean)
    return found.select(*[F.when(F.size(work) > 0, whole).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in cols])
