"""Secret scanning through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is taken apart on the driver and turned into a
Boolean query of trigrams: a text that matches must hold all trigrams of one
of a few sets.  The index lists, for each trigram that occurs in a query, the
documents that hold it in lower case; intersecting the lists by document gives
each rule's candidates, and only their texts are searched by the expression.
Texts are written once with their place, and candidates are marked where they
lie, so no text is shuffled however many match.  Rules without mandatory trigrams (a run of hex digits) search every text.

Spans come from the pieces between matches and the lengths of the matches,
summed in order, so positions are code points and a text of many matches costs
in proportion to them.

Null text counts as empty.  Rows are told apart by their place, so repeated rows and
null doc_ids each get their own result.  Other columns are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLACE, numbered, require_columns, written


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of ``group``; ``base`` rules are counted one by one."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def any_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


KEYWORDS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # the same spans as runs of [0-9a-f]+ of at least 24, without listing the short runs
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
)

# ---------------------------------------------------------------- trigram queries

#: More spellings than this are not carried on; the query is then weaker, never wrong.
MAX_SPELLINGS = 64

Clauses = frozenset[frozenset[str]]
ALWAYS: Clauses = frozenset([frozenset()])


def both(a: Clauses, b: Clauses) -> Clauses:
    return shortest(frozenset(x | y for x, y in product(a, b)))


def shortest(clauses: Clauses) -> Clauses:
    """Without sets that ask for more than another one."""
    return frozenset(x for x in clauses if not any(y < x for y in clauses))


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


class _Walk:
    """Reads an expression from left to right: spellings so far (``whole``: of all of it), and what earlier ones asked for."""

    def __init__(self) -> None:
        self.query, self.spelled, self.whole = ALWAYS, {""}, True

    def flush(self) -> None:
        self.query = both(self.query, shortest(frozenset(grams(s) for s in self.spelled)))
        self.spelled = {""}

    def append(self, spellings: set[str] | None) -> None:
        if spellings is None:
            self.flush()
        elif len(self.spelled) * len(spellings) > MAX_SPELLINGS:
            self.flush()
            self.whole = False
            self.spelled = set(spellings) if len(spellings) <= MAX_SPELLINGS else {""}
        else:
            self.spelled = {a + b for a, b in product(self.spelled, spellings)}


def _spellings(items) -> tuple[set[str] | None, Clauses]:
    """All strings an expression can match, if few (lower case), and a query every match fulfils."""
    walk, exact = _Walk(), True
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            walk.append({chr(arg).lower()})
        elif name == "IN":
            chars: set[str] | None = set()
            for kind, value in arg:
                if str(kind) == "LITERAL" and chars is not None:
                    chars.add(chr(value).lower())
                elif str(kind) == "RANGE" and chars is not None and value[1] - value[0] < 4:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
            if chars is None or len(chars) > 6:
                chars, exact = None, False
            walk.append(chars)
        elif name == "SUBPATTERN":
            some, query = _spellings(arg[-1])
            if some is None:
                exact = False
                walk.flush()
                walk.query = both(walk.query, query)
            else:
                walk.append(some)
        elif name == "BRANCH":
            parts = [_spellings(x) for x in arg[1]]
            if all(some is not None for some, _ in parts):
                walk.append(set().union(*(some for some, _ in parts)))
            else:
                exact = False
                walk.flush()
                walk.query = both(walk.query, shortest(frozenset().union(*(q for _, q in parts))))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            some, query = _spellings(inner)
            if some is not None and int(least) == 0 and int(most) == 1:
                walk.append(some | {""})
            elif some is not None and int(least) == int(most) and int(most) <= 8:
                for _ in range(int(most)):
                    walk.append(some)
            else:
                exact = False
                walk.flush()
                if int(least) > 0:
                    walk.query = both(walk.query, query)
        elif name != "AT":
            exact = False
            walk.flush()
    spelled = walk.spelled if exact and walk.whole else None
    walk.flush()
    return spelled, walk.query


def trigram_query(pattern: str) -> Clauses:
    """Sets of lower-case trigrams of which every match holds at least one whole set.

    A set may be empty: then nothing is mandatory.
    """
    return _spellings(re._parser.parse(pattern))[1]


# ---------------------------------------------------------------- the index


def matches(rule: Rule, number: int) -> Column:
    """All matches of a rule in ``text``: ordinal, characters before it since the last, of it, and of its group."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    group = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split("text", rule.pattern, -1)
    cut = F.struct(whole.alias("whole"), group.alias("part"), between.alias("between"))

    def one(c: Column) -> Column:
        return F.transform(
            c["whole"],
            lambda w, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), F.length(F.get(c["between"], i)).cast("bigint").alias("gap"), F.length(w).cast("bigint").alias("size"), F.length(F.get(c["part"], i)).cast("bigint").alias("part")),
        )

    # one struct, so that each expression is searched for once
    return F.flatten(F.transform(F.array(cut), one))


HIT = "array<struct<rule:int,i:int,gap:bigint,size:bigint,part:bigint>>"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and hits, an array of (start, rule, end), sorted, for every row of ``docs``."""
    require_columns(docs, "doc_id", "text")
    asked = [trigram_query(r.pattern) for r in rules]
    free = [i for i, q in enumerate(asked) if frozenset() in q]
    bound = [i for i in range(len(rules)) if i not in free]
    names = sorted(set().union(*(x for i in bound for x in asked[i]))) if bound else []
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    none = F.array().cast(HIT)

    lower = texts.withColumn("low", F.lower("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(n)) for n, g in enumerate(names)])) if names else F.array().cast("array<int>")
    direct = F.concat(*[F.coalesce(F.when(F.col("text").rlike(rules[i].pattern), matches(rules[i], i)), none) for i in free]) if free else none
    index = numbered(lower.select("doc_id", "text", held.alias("grams"), direct.alias("direct")), "trigrams")

    found = index.rows.where(F.size("direct") > 0).select(*PLACE, F.explode("direct").alias("h"))
    if bound:
        postings = index.rows.select(*PLACE, F.explode("grams").alias("gram"))
        words = range(len(names) // 62 + 1)
        bits = [F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.expr("shiftleft(1L, gram % 62)")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in words]
        lists = postings.groupBy(*PLACE).agg(*bits)

        def holds(clause: frozenset[str]) -> Column:
            masks = [sum(1 << (n % 62) for n, g in enumerate(names) if g in clause and n // 62 == w) for w in words]
            return reduce(Column.__and__, [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("bigint")) == m for w, m in enumerate(masks)])

        flags = {f"r{i}": reduce(Column.__or__, [holds(c) for c in sorted(asked[i], key=sorted)]) for i in bound}
        candidates = lists.select(*PLACE, *[c.alias(n) for n, c in flags.items()]).where(reduce(Column.__or__, [F.col(n) for n in flags]))
        at = index.beside(candidates, "text")
        hits = F.concat(*[F.coalesce(F.when(F.col(f"r{i}"), matches(rules[i], i)), none) for i in bound])
        found = found.unionByName(at.select(*PLACE, F.explode(hits).alias("h")))

    before = Window.partitionBy(*PLACE, "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    least = F.array(*[F.lit(r.least) for r in rules])
    rows = found.select(*PLACE, "h.*").withColumn("end", end).where(F.col("part") >= least[F.col("rule")])
    spans = rows.select(*PLACE, F.struct((F.col("end") - F.col("size")).alias("start"), "rule", "end").alias("span"))
    per_text = spans.groupBy(*PLACE).agg(F.array_sort(F.collect_list("span")).alias("hits"))
    whole = index.beside(per_text, "doc_id", how="left")
    return whole.select("doc_id", F.coalesce("hits", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")).alias("hits"))


def spelled(hits: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of each hit, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", kinds[h["rule"]], h["start"].cast("string"), h["end"].cast("string"))), ",")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the rows of the registered query."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = [
        f"""SELECT doc_id, {i} AS rule, unnest(range(len(w))) AS i, unnest(list_transform(range(len(w)), lambda j: length(p[j + 1]))) AS gap,
                   unnest(list_transform(w, lambda x: length(x))) AS size, unnest(list_transform(g, lambda x: length(x))) AS part
            FROM (SELECT doc_id, regexp_extract_all(t, {text(r.pattern)}) AS w, string_split_regex(t, {text(r.pattern)}) AS p,
                         regexp_extract_all(t, {text(r.pattern)}, {r.group}) AS g FROM d WHERE regexp_matches(t, {text(r.pattern)}))"""
        for i, r in enumerate(rules)
    ]
    base = ", ".join(str(i) for i, r in enumerate(rules) if r.base)
    counts = ", ".join(f"count(*) FILTER (rule = {i}) AS n_{r.kind}" for i, r in enumerate(rules) if r.base)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)
    kinds = " ".join(f"WHEN {i} THEN {text(r.kind)}" for i, r in enumerate(rules))
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
        e AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, rule ORDER BY i)::BIGINT AS stop FROM m),
        s AS (SELECT doc_id, rule, stop - size AS start, (CASE rule {kinds} END) || ':' || (stop - size) || ':' || stop AS span FROM e WHERE part >= CASE rule {least} END),
        a AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, rule) FILTER (rule IN ({base})) AS base,
                     string_agg(span, ',' ORDER BY start, rule) AS spans FROM s GROUP BY doc_id)
        SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
