"""Secret scans through a trigram inverted index, DataFrame operations only.

Each rule's regex is turned into a Boolean query over the trigrams that any match must
contain (letters in lower case). Postings of just these trigrams are built over
all documents, intersected for each rule, and the rule's regex then verifies the
candidates. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re._parser as regex_tree
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, lower_ascii, stage


@dataclass(frozen=True)
class Rule:
    """``group`` is the part of a match whose length must reach ``least``; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed patterns of the base kinds, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    # runs that are too short are no matches at all, so the least length stands in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further public credential formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)

#: A query is a list of clauses, all of which must hold; a clause is a set of trigrams and sets of
#: trigrams: it holds if all trigrams of one alternative are there.
Query = list[list[frozenset[str]]]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(tree) -> tuple[list[str] | None, Query]:
    """The finite set of strings that the tree matches, if small, and else the query for it."""
    exact, query = [""], []

    def close() -> None:
        nonlocal exact
        if exact and all(len(s) >= 3 for s in exact):
            query.append([_trigrams(s) for s in exact])
        exact = [""]

    for op, arg in tree:
        name, options, below = str(op), None, []
        if name == "LITERAL":
            options = [chr(arg).lower()]
        elif name == "SUBPATTERN":
            options, below = _strings(arg[3])
        elif name == "BRANCH":
            parts = [_strings(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                options = [s for p in parts for s in p[0]]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            options = sorted({chr(v).lower() for _, v in arg})
        elif name == "MAX_REPEAT" and arg[1] == 1 and arg[0] == 0:
            inner, _ = _strings(arg[2])
            options = None if inner is None else ["", *inner]
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            _, below = _strings(arg[2])
        if options is not None and len(options) * len(exact) <= 64:
            exact = [a + b for a in exact for b in options]
        else:
            close()
            query.extend(below)
    return (exact, query) if not query and _finite(tree) else (None, query + ([[_trigrams(s) for s in exact]] if exact and all(len(s) >= 3 for s in exact) else []))


def _finite(tree) -> bool:
    for op, arg in tree:
        name = str(op)
        if name == "SUBPATTERN" and not _finite(arg[3]):
            return False
        if name == "BRANCH" and not all(_finite(x) for x in arg[1]):
            return False
        if name == "MAX_REPEAT" and (arg[1] != 1 or not _finite(arg[2])):
            return False
        if name not in ("LITERAL", "SUBPATTERN", "BRANCH", "MAX_REPEAT", "IN"):
            return False
        if name == "IN" and not (all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8):
            return False
    return True


def trigram_query(pattern: str) -> Query:
    """The clauses that the lower-cased text of any match meets; empty if there are none."""
    exact, query = _strings(regex_tree.parse(pattern))
    if exact is not None and all(len(s) >= 3 for s in exact):
        query = [[_trigrams(s) for s in exact]]
    return query


ROW = ["doc_id", "text_hash"]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram and the row's keys for those of ``trigrams`` that the lower-cased text holds."""
    low = lower_ascii(F.col("text"))
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]), lambda x: x.isNotNull())
    return docs.select(*ROW, low.alias("low")).select(*ROW, F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The row's keys and the kinds whose trigram query holds in it: postings intersected by document."""
    indexed = [(r, q) for r in rules if (q := trigram_query(r.pattern))]
    by_doc = index.groupBy(*ROW).agg(F.collect_set("trigram").alias("t"))

    def holds(clause: list[frozenset[str]]) -> Column:
        tests = [F.size(F.array_intersect("t", F.array(*map(F.lit, sorted(a))))) == len(a) for a in clause]
        return F.greatest(*tests) if len(tests) > 1 else tests[0]

    kinds = []
    for rule, query in indexed:
        test = holds(query[0])
        for clause in query[1:]:
            test = test & holds(clause)
        kinds.append(F.when(test, F.lit(rule.kind)))
    return by_doc.select(*ROW, F.filter(F.array(*kinds), lambda x: x.isNotNull()).alias("kinds")).filter(F.size("kinds") > 0)


def _pieces(rows: DataFrame, rule: Rule, order: int) -> DataFrame:
    """The row's keys, kind, and in order the lengths of the gap before each match, of the match and of its tested group."""
    gaps = F.split("text", rule.pattern, -1)
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    sized = lambda x: F.transform(x, lambda v: F.length(v))
    zipped = F.arrays_zip(sized(gaps).alias("g"), sized(found).alias("m"), sized(tested).alias("n"))
    each = rows.filter(F.col("text").rlike(rule.pattern)).select(*ROW, F.lit(order).alias("kind"), F.posexplode(zipped).alias("i", "x"))
    return each.select(*ROW, "kind", "i", "x.g", "x.m", "x.n", F.lit(rule.least).alias("least")).filter("m IS NOT NULL")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id, found: every document with its matches as an array of (start, kind number, end), sorted.

    ``docs``: doc_id (null: left out), text; other columns are ignored. Rows are told apart by doc_id and text; repeated rows have a row each. A null or empty text has no matches.
    Matches of one rule don't overlap, those of different rules may. Spans that tie in start come in the order
    of ``rules``. Documents of any length are scanned whole.

    Gaps and matches alternate, so the running sum of their lengths gives the places; it runs over rows, however many matches a text has.
    """
    text = F.coalesce("text", F.lit(""))
    base = keyed(docs).select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    number = {r.kind: i for i, r in enumerate(rules)}
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if queries[r.kind]]
    parts = [_pieces(base, r, number[r.kind]) for r in rules if not queries[r.kind]]
    if indexed:
        trigrams = sorted({t for r in indexed for clause in queries[r.kind] for a in clause for t in a})
        wanted = stage(candidates(postings(base, trigrams), rules))
        near = stage(base.join(wanted, ROW))
        parts += [_pieces(near.filter(F.array_contains("kinds", r.kind)), r, number[r.kind]) for r in indexed]
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    # repeated rows have the same pieces
    pieces = pieces.repartition(*ROW).dropDuplicates([*ROW, "kind", "i"])
    until = Window.partitionBy(*ROW, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("g") + F.col("m")).over(until).cast("int")
    spans = pieces.withColumn("end", end).filter("n >= least").select(*ROW, F.struct((F.col("end") - F.col("m")).alias("start"), "kind", "end").alias("s"))
    found = spans.groupBy(*ROW).agg(F.array_sort(F.collect_list("s")).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return base.select(*ROW).join(found, ROW, "left").select("doc_id", F.coalesce("found", none).alias("found"))


def spans_text(found: Column, rules: tuple[Rule, ...], kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; only those of ``kinds`` if given."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    keep = [i for i, r in enumerate(rules) if kinds is None or r.kind in kinds]
    kept = F.filter(found, lambda x: x["kind"].isin(keep))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
