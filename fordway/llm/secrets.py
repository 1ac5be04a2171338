r"""Secret scans by a trigram inverted index.

Each rule is a regex with the Boolean query of trigrams that its every match must contain, derived from the regex
itself. The index lists, for each trigram that some rule asks for, the rows whose text has it (ASCII letters folded);
it is a table in the shared folder. The lists are brought together by row, so all rules' intersections and unions are
taken in one pass, and a list that holds every row is no hot key; only rows that meet a rule's query are verified by
the regex. A rule without mandatory trigrams (a bare run of hexadecimal digits) scans all rows.

Matches are leftmost and do not overlap for each kind; a match that fails a rule's length test is dropped and not
tried again from a later character. Positions come from the lengths of the text's parts between matches, so every step
is a built-in function.

Rules besides the three base ones name well-known token formats. Where another rule's match overlaps a base span of
the same place it is still listed, under its own kind. Null texts count as empty: no spans. Repeated rows and ids are
fine: each row is verified by its own text. A null id is an id like any other. Extra columns are not read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: bool = False  # letters in either case
    group: int = 0  # what the length test is for
    least: int = 0  # its least length


# Fixed values. Patterns with a least run in braces match just what the run's own length test would leave.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("key_block", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

ALL = ("all",)  # the query that every text meets
PORTION = 128  # matches listed at a time


def trigram_query(pattern: str) -> tuple:
    """("all",), ("tri", t), ("and", ...) or ("or", ...): what the trigrams of a matching text, folded, must meet.

    Works on exact string sets: a node has either the set of all strings it can match, if that is small, or a query
    with the sets of possible beginnings and ends left out.
    """
    strings, query = _node(list(parser.parse(pattern)))
    return _simple(("and", query, _of_strings(strings))) if strings is not None else _simple(query)


def _of_strings(strings: frozenset[str]) -> tuple:
    if any(len(s) < 3 for s in strings):
        return ALL
    return ("or", *[("and", *[("tri", s[i : i + 3].lower()) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(items: list) -> tuple[frozenset[str] | None, tuple]:
    """Exact strings (None: too many) and a query, for a sequence of parsed items."""
    whole: frozenset[str] | None = frozenset(("",))
    held: frozenset[str] = frozenset(("",))
    query: list[tuple] = []
    for op, arg in items:
        strings, inner = _one(op, arg)
        query.append(inner)
        if strings is not None and len(strings) * len(held) <= 64:
            held = frozenset(a + b for a in held for b in strings)
            whole = whole and frozenset(a + b for a in whole for b in strings) if whole is not None else None
        else:
            query.append(_of_strings(held))
            held, whole = frozenset(strings or ("",)), None
    if whole is None:
        query.append(_of_strings(held))
    return whole, ("and", *query)


def _one(op, arg) -> tuple[frozenset[str] | None, tuple]:
    if op is sre.LITERAL:
        return frozenset((chr(arg),)), ALL
    if op is sre.SUBPATTERN:
        return _node(list(arg[-1]))
    if op is sre.BRANCH:
        sides = [_node(list(x)) for x in arg[1]]
        if all(s is not None for s, _ in sides):
            return frozenset().union(*(s for s, _ in sides)), ALL
        return None, ("or", *[("and", q, _of_strings(s)) if s is not None else q for s, q in sides])
    if op is sre.IN and all(x is sre.LITERAL for x, _ in arg):
        return frozenset(chr(v) for _, v in arg), ALL
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        strings, inner = _node(list(body))
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if low == high == 1:
            return strings, inner
        return None, (("and", inner, _of_strings(strings)) if strings is not None else inner) if low else ALL
    return None, ALL


def _simple(query: tuple) -> tuple:
    """Nested ands and ors in one, each part once; of an or, no part that asks for all that another asks for."""
    if query[0] in ("tri", "all"):
        return query
    parts: list[tuple] = []
    for q in map(_simple, query[1:]):
        parts += [x for x in (q[1:] if q[0] == query[0] else [q]) if x not in parts]
    if query[0] == "and":
        parts = [p for p in parts if p != ALL]
        if not parts:
            return ALL
    elif ALL in parts:
        return ALL
    else:
        asks = [set(p[1:]) if p[0] == "and" else {p} for p in parts]
        parts = [p for k, p in enumerate(parts) if not any(a < asks[k] for a in asks)]
    return parts[0] if len(parts) == 1 else (query[0], *parts)


def trigrams(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams(q) for q in query[1:] if isinstance(q, tuple)))


def meets(query: tuple, held: Column) -> Column:
    """Whether an array of trigrams meets a query."""
    if query[0] == "all":
        return F.lit(True)
    if query[0] == "tri":
        return F.array_contains(held, query[1])
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [meets(q, held) for q in query[1:]])


def java(rule: Rule) -> str:
    return ("(?i)" if rule.fold else "") + rule.pattern


def spans_of(rule: Rule, text: Column) -> Column:
    """Array of (kind, start, end) of a rule's matches in code points."""
    pattern = F.lit(java(rule))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else whole
    between = F.slice(F.split(text, java(rule), -1), 1, F.size(whole))
    steps = F.zip_with(between, F.zip_with(whole, tested, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda b, x: F.struct(F.char_length(b).cast("long").alias("gap"), F.char_length(x.m).cast("long").alias("n"), F.char_length(x.g).alias("tested")))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, tested: int>>)")
    nested = F.expr("cast(array() as array<array<struct<start: bigint, end: bigint, tested: int>>>)")

    def add(acc: Column, s: Column) -> Column:
        start = acc.at + s.gap
        here = F.struct(start.alias("start"), (start + s.n).alias("end"), s.tested.alias("tested"))
        return F.struct((start + s.n).alias("at"), F.concat(acc.here, F.array(here)).alias("here"), acc.found.alias("found"))

    def portion(acc: Column, k: Column) -> Column:
        # a list that grows is copied at each step, so matches are listed by portions and portions by their number
        begun = F.struct(acc.at.alias("at"), none.alias("here"), acc.found.alias("found"))
        return F.aggregate(F.slice(steps, k * PORTION + 1, PORTION), begun, add, lambda x: F.struct(x.at.alias("at"), F.concat(x.found, F.array(x.here)).alias("found")))

    portions = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / PORTION).cast("int"))
    begun = F.struct(F.lit(0).cast("long").alias("at"), nested.alias("found"))
    found = F.when(F.size(whole) > 0, F.flatten(F.aggregate(portions, begun, portion).found)).otherwise(none)
    kept = F.filter(found, lambda s: s.tested >= rule.least)
    return F.transform(kept, lambda s: F.struct(F.lit(rule.kind).alias("kind"), s.start.alias("start"), s.end.alias("end")))


def trigram_index(docs: DataFrame, asked: list[str]) -> DataFrame:
    """trigram, row: the lists of the trigrams asked for, over keyed texts (row, text)."""
    folded = docs.select("row", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in asked]), lambda t: t.isNotNull())
    return folded.select("row", F.explode(held).alias("trigram")).select("trigram", "row")


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and found (all): arrays of (kind, start, end), for every row."""
    ws = Workspace(df.sparkSession, "secrets")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    queries = {r: trigram_query(r.pattern) for r in rules}
    asked = sorted(set().union(*(trigrams(q) for q in queries.values())))
    indexed = [r for r in rules if queries[r] != ALL]
    index = ws.store(trigram_index(docs, asked).distinct(), "trigrams")
    lists = index.groupBy("row").agg(F.collect_set("trigram").alias("held"))
    hit = F.filter(F.array(*[F.when(meets(queries[r], F.col("held")), F.lit(r.kind)) for r in indexed]), lambda k: k.isNotNull())
    candidates = ws.store(lists.select("row", hit.alias("kinds")).where(F.size("kinds") > 0), "candidates")
    ws.keep("candidates")
    none = F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint>>)")
    text = F.col("text")
    # rules that scan all rows do so before the join; texts without any candidate leave theirs behind
    full = [F.when(F.rlike(text, F.lit(java(r))), spans_of(r, text)).otherwise(none) for r in rules if r not in indexed]
    scanned = docs.select("id", "row", "text", F.concat(*full).alias("full") if full else none.alias("full"))
    joined = scanned.join(candidates.hint("merge"), "row", "left")  # grows with the texts: not to be broadcast
    verified = [F.when(F.array_contains("kinds", r.kind), spans_of(r, text)).otherwise(none) for r in indexed]
    order = {r.kind: k for k, r in enumerate(rules)}
    rank = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), s.kind)
    sort = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s.start, rank(s).alias("rank"), s.end, s.kind.alias("kind")))), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    found = joined.select("id", F.concat("full", *verified).alias("all"))
    base = [r.kind for r in rules if r in BASE]
    return found.select(F.col("id").alias(id_col), sort(F.filter("all", lambda s: s.kind.isin(base))).alias("base"), sort(F.col("all")).alias("found"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    from .pii import digest

    return digest(scan(table(spark, sf_dir, "documents")), "doc_id", tuple(r.kind for r in BASE))
