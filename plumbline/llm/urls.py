"""URL filtering by rules and by a tree of path templates.

A rule names a host and the start of a path; it fits the host and all its
subdomains, and of the rules that fit the longest decides.  URLs no rule fits
are judged by templates:

1.  Per host, segments of the path that vary by nature (numbers, dates, long
    identifiers) become wildcards.  What is left is the path's shape.
2.  Labels are counted by shape over all hosts: by its first segment, its first two, the
    whole of it, and the whole of it within the host's domain (its last two names).  Each
    count is smoothed towards the one before, (blocked + ALPHA * before) / (labels + ALPHA), the first towards
    the share among all labels, at most a half.  So a host without labels is judged
    by what its shapes mean elsewhere.
3.  Level by level, branches below one node of a host's tree are compared by their labels, or where
    they have none by those of their shapes: a branch is told from its siblings by a
    two-proportion test.  Branches that do not differ are merged into one wildcard.  Branches that nothing is
    known of are merged into one as well, and join the other wildcard once it stands for
    MERGED branches.  Past DEPTH only nodes that hold labels of both kinds
    are descended, as far as their paths go; elsewhere what follows becomes one.
4.  Of each template the share of blocked labels is smoothed towards the mean of its shapes,
    and templates at LEAST_PURITY or above are rejected.

Labels are URLs with an action; the registered query takes those the rules
decide.  Only counts by template are joined and merged: the pages of a host that
holds a third of all rows are summed before they are shuffled.

A null URL, or one without ``://``, has an empty host and path and is judged
like any other template.  Repeated rows are judged one by one.  Other columns
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require_columns, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEPTH = 4
MERGED = 3
LEAST_Z = 1.96
ALPHA = 4.0
LEAST_PURITY = 0.8
#: Wildcards hold characters that no generalised literal segment keeps.
NUMBER, DATE, IDENTIFIER, REST, BARE, ALIKE = "{n}", "{d}", "{x}", "{rest}", "{bare}", "{alike}"

Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; null where none does."""

    def fits(rule: Rule) -> Column:
        return ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))

    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(rule_name(r)), rule_name(r))):
        name = F.when(fits(rule), rule_name(rule)).otherwise(name)
        action = F.when(fits(rule), rule[0]).otherwise(action)
    return name, action


def segments(path: Column) -> Column:
    """All segments, those that vary by nature as wildcards."""

    def general(s: Column) -> Column:
        plain = F.translate(s, UPPER + "{}", LOWER + "()")
        return (
            F.when(plain.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), DATE)
            .when(plain.rlike(r"^[0-9]+(\.[a-z0-9]+)?$"), NUMBER)
            .when(plain.rlike(r"^[0-9a-f-]{16,}$") | (plain.rlike("[0-9]") & plain.rlike(r"^[a-z0-9_=-]{12,}$")), IDENTIFIER)
            .otherwise(plain)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def domain(host: Column) -> Column:
    """The last two names of a host, without its port."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    return F.substring_index(bare, ".", -2)


def with_shapes(counts: DataFrame) -> DataFrame:
    """``counts`` (host, segs, n, blocked, allowed) with ``parent``, what the shape says, and ``sb`` and ``sa``, its labels."""
    totals = counts.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("allowed"), F.lit(0)).alias("a")).first()
    labels = totals["b"] + totals["a"]
    rows = counts.withColumns({"domain": domain(F.col("host")), "one": F.slice("segs", 1, 1), "two": F.slice("segs", 1, 2), "parent": F.lit(min(0.5, totals["b"] / labels) if labels else 0.5)})
    for keys in (["one"], ["two"], ["segs"], ["domain", "segs"]):
        sums = rows.where("blocked + allowed > 0").groupBy(*keys).agg(F.sum("blocked").alias("_b"), F.sum("allowed").alias("_a"))
        joined = rows.join(sums, keys, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("_b", "_a")})
        if keys == ["segs"]:
            joined = joined.withColumns({"sb": F.col("_b"), "sa": F.col("_a")})
        rows = joined.withColumn("parent", (F.col("_b") + ALPHA * F.col("parent")) / (F.col("_b") + F.col("_a") + ALPHA)).drop("_b", "_a")
    return rows.select("host", "segs", "n", "blocked", "allowed", "parent", "sb", "sa")


def template_tree(counts: DataFrame) -> DataFrame:
    """``counts`` (host, segs, n, blocked, allowed, parent, sb, sa) with ``template``, the branch each row ends in after merging."""
    tree = counts.withColumns({"template": F.lit(""), "live": F.size("segs") > 0})
    level = 0
    while level < DEPTH or tree.where("live").limit(1).count():
        child = F.get("segs", F.lit(level))
        if level >= DEPTH:
            mixed = tree.where("live").groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
            tree = tree.join(mixed.select("host", "template", ((F.col("b") > 0) & (F.col("a") > 0)).alias("open")), ["host", "template"], "left")
            tree = tree.withColumn("open", F.coalesce("open", F.lit(False)))
            child = F.when(F.col("open"), child).otherwise(REST)
        else:
            tree = tree.withColumn("open", F.lit(True))
        branch = tree.withColumn("child", F.when(F.col("live"), child).otherwise(F.lit("")))
        own = F.sum("blocked") + F.sum("allowed") > 0
        children = branch.groupBy("host", "template", "child").agg(F.when(own, F.sum("blocked")).otherwise(F.sum("sb")).alias("b"), F.when(own, F.sum("allowed")).otherwise(F.sum("sa")).alias("a"))
        nodes = children.groupBy("host", "template").agg(F.sum("b").alias("all_b"), F.sum("a").alias("all_a"))
        both = children.join(nodes, ["host", "template"])
        m, others = F.col("b") + F.col("a"), F.col("all_b") + F.col("all_a") - F.col("b") - F.col("a")
        share = (F.col("all_b") + 0.5) / (m + others + 1.0)
        gap = F.col("b") / m - (F.col("all_b") - F.col("b")) / others
        z = F.abs(gap) / F.sqrt(share * (1 - share) * (1 / m + 1 / others))
        kind = F.when(m == 0, F.lit("bare")).when((others > 0) & (z < LEAST_Z), F.lit("alike")).otherwise(F.lit("own"))
        told = both.withColumn("kind", kind).select("host", "template", "child", "kind")
        alike = told.groupBy("host", "template").agg(F.count_if(F.col("kind") == "alike").alias("alike"))
        name = (
            F.when(F.col("kind") == "own", F.col("child"))
            .when((F.col("kind") == "alike") & (F.col("alike") > 1), F.lit(ALIKE))
            .when((F.col("kind") == "bare") & (F.col("alike") >= MERGED), F.lit(ALIKE))
            .when(F.col("kind") == "bare", F.lit(BARE))
            .otherwise(F.col("child"))
        )
        merged = told.join(alike, ["host", "template"]).select("host", "template", "child", name.alias("name"))
        deeper = F.when(F.col("live"), F.concat_ws("/", "template", "name")).otherwise(F.col("template"))
        live = F.col("live") & F.col("open") & (F.size("segs") > level + 1)
        columns = ["host", "segs", "n", "blocked", "allowed", "parent", "sb", "sa"]
        tree = written(branch.join(merged, ["host", "template", "child"]).select(*columns, deeper.alias("template"), live.alias("live")), f"tree-{level}")
        level += 1
    return tree.drop("live")


def rejected(tree: DataFrame) -> DataFrame:
    """(host, segs, template, purity, reject) for every row of a tree."""
    b, a, weight = F.sum("blocked"), F.sum("allowed"), F.greatest("n", F.col("blocked") + F.col("allowed"))
    parent = F.sum(weight * F.col("parent")) / F.sum(weight)
    # rounded: sums of fractions depend on their order
    stats = tree.groupBy("host", "template").agg(F.round((b + ALPHA * parent) / (b + a + ALPHA), 9).alias("purity"))
    return tree.join(stats, ["host", "template"]).select("host", "segs", "template", "purity", (F.col("purity") >= LEAST_PURITY).alias("reject"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = (), labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of ``pages``.

    ``labels`` (url, action: block or allow) add to those the rules give.
    """
    require_columns(pages, "page_id", "url")

    def read(df: DataFrame, *more: str) -> DataFrame:
        host, path = parts(F.col("url"))
        split = df.select(*more, host.alias("host"), path.alias("path"))
        rule, action = matched(F.col("host"), F.col("path"), rules)
        return split.withColumns({"rule": rule, "action": action, "segs": segments(F.col("path"))})

    rows = read(pages, "page_id")
    counted = rows.select("host", "segs", "action", F.lit(1).alias("n"))
    if labels is not None:
        given = read(labels.select("url", F.col("action").alias("given")), "given")
        counted = counted.unionByName(given.select("host", "segs", F.col("given").alias("action"), F.lit(0).alias("n")))
    sums = [F.sum("n").alias("n"), F.count_if(F.col("action") == "block").alias("blocked"), F.count_if(F.col("action") == "allow").alias("allowed")]
    counts = written(counted.groupBy("host", "segs").agg(*sums), "templates")
    told = written(rejected(template_tree(written(with_shapes(counts), "shapes"))), "rejected")
    verdict = F.coalesce("action", F.when(F.col("reject"), "block").otherwise("allow"))
    return rows.join(told, ["host", "segs"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")

