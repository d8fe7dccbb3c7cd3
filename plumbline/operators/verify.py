"""Citation scoring: does the cited case exist, does it support the claim, and the verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BEGINNINGS, DEFAULTS, LANDMARK_VOLUMES, SCORING_STOP_WORDS, TIERS, EngineConfig
from ..functions import fuzzy
from ..functions import text as fx
from ..models import cosine
from ..storage import written


Search = Callable[[DataFrame], DataFrame]


def covered(text: Column, volumes: Iterable[str] = LANDMARK_VOLUMES) -> Column:
    """Whether the first volume a text cites is among those held."""
    return cited_volume(text).isin(*volumes)


def cited_volume(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)(\d+)\s+U\.?\s*S\.?", 1)


def exact_existence(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """``names`` (name, ...) with matched and match_type EXACT or NOT_FOUND against catalog (name)."""
    keys = catalog.select(fx.name_key(F.col("name")).alias("_key"), F.lit(True).alias("_found")).distinct()
    joined = names.withColumn("_key", fx.name_key(F.col("name"))).join(keys, "_key", "left")
    found = F.coalesce("_found", F.lit(False))
    return joined.select(*names.columns, found.alias("matched"), F.when(found, "EXACT").otherwise("NOT_FOUND").alias("match_type"))


def reporter_matches(cites: DataFrame, catalog: DataFrame) -> DataFrame:
    """(cite, name) pairs of cites (cite, case_name) and entries (name) that hold the cite and share a word with the name.

    Entries meet a cite by its rarest three letters, so a word that many names share joins nothing; a cite of
    fewer letters meets them by a word of its name.
    """
    asked = written(cites.where("cite <> ''").select("cite", "case_name", fx.long_words(F.col("case_name"), SCORING_STOP_WORDS).alias("words")).distinct(), "cites")
    entries = catalog.select("name").distinct().withColumn("entry_words", fx.long_words(F.col("name"), SCORING_STOP_WORDS))

    def letters(text: Column) -> Column:
        low = F.lower(text)
        return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))))

    # letters that no cite has are of no use
    wanted = asked.select(F.explode(letters(F.col("cite"))).alias("key")).distinct()
    held = entries.select("name", "entry_words", F.explode(letters(F.col("name"))).alias("key")).join(wanted, "key", "left_semi")
    counts = held.groupBy("key").agg(F.count("*").alias("df"))
    keyed = asked.select("cite", F.explode(letters(F.col("cite"))).alias("key")).distinct().join(counts, "key", "left")
    rarest = keyed.groupBy("cite").agg(F.min_by("key", F.struct(F.coalesce("df", F.lit(0)), "key")).alias("key"))
    long = asked.join(rarest, "cite").join(held, "key").drop("key")
    short = asked.where(F.length(F.lower("cite")) < 3).withColumn("word", F.explode("words")).join(entries.withColumn("word", F.explode("entry_words")), "word").drop("word")
    found = F.contains(F.lower("name"), F.lower("cite")) & F.arrays_overlap("words", "entry_words")
    return long.unionByName(short.select(*long.columns)).where(found).select("cite", "case_name", "name").distinct()


def subset_matches(names: DataFrame, catalog: DataFrame, score: float = DEFAULTS.subset_score) -> DataFrame:
    """(name, best, score, via_subset): the catalog entry that shares most words with each name.

    All words of the name in the entry give ``score``; else the shared part of all words of both counts.
    """
    asked = names.select("name").distinct().withColumn("words", fx.long_words(F.col("name"), SCORING_STOP_WORDS))
    entries = catalog.select(F.col("name").alias("entry")).distinct().withColumn("entry_words", fx.long_words(F.col("entry"), SCORING_STOP_WORDS))
    pairs = asked.withColumn("word", F.explode("words")).join(entries.withColumn("word", F.explode("entry_words")), "word").drop("word").distinct()
    inside = F.size(F.array_except("words", "entry_words")) == 0
    share = F.size(F.array_intersect("words", "entry_words")) / F.size(F.array_union("words", "entry_words"))
    scored = pairs.withColumns({"via_subset": inside, "score": F.round(F.when(inside, F.lit(score)).otherwise(share), 6)})
    best = F.min_by(F.struct("entry", "score", "via_subset"), F.struct(-F.col("score"), F.col("entry")))
    return scored.groupBy("name").agg(best.alias("b")).select("name", F.col("b.entry").alias("best"), "b.score", "b.via_subset")


def edit_candidates(names: DataFrame, catalog: DataFrame, threshold: float) -> DataFrame:
    """(name, candidate, lev, bound): catalog names whose bound on the ratio reaches ``threshold``.

    Equal names are joined; others meet by rare pairs of letters, which loses none at the thresholds in use.
    """
    asked = names.select("name").distinct()
    entries = catalog.select(F.col("name").alias("entry")).distinct()
    equal = asked.join(entries, asked["name"] == entries["entry"])
    pairs = equal.unionByName(fuzzy.near_pairs(asked, entries, 4.0 * (1.0 - threshold))).withColumnRenamed("entry", "candidate")
    bound = fuzzy.ratio_bound(F.col("name"), F.col("candidate"))
    return pairs.withColumns({"lev": F.levenshtein("name", "candidate").cast("bigint"), "bound": F.round(bound, 6)}).where(F.col("bound") >= threshold)


def existence(citations: DataFrame, catalog: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """``citations`` (case_name, reporter_cite, ...) with existence, matched_name and match_type.

    Exact names and reporter cites are settled by joins; only the names that are left are compared one by
    one, each distinct name once.
    """
    names = citations.select("case_name", F.coalesce("reporter_cite", F.lit("")).alias("reporter_cite")).distinct()
    keyed = names.withColumn("_key", fx.name_key(F.col("case_name")))
    entries = catalog.select(fx.name_key(F.col("name")).alias("_key"), "name").groupBy("_key").agg(F.min("name").alias("exact"))
    first = keyed.join(entries, "_key", "left")
    cited = reporter_matches(first.where("exact IS NULL").select(F.col("reporter_cite").alias("cite"), "case_name"), catalog)
    cited = cited.groupBy(F.col("cite").alias("reporter_cite"), "case_name").agg(F.min("name").alias("by_cite"))
    second = first.join(cited, ["reporter_cite", "case_name"], "left")
    open_names = second.where("exact IS NULL AND by_cite IS NULL AND _key <> ''").select(F.col("_key").alias("name")).distinct()
    close = fuzzy.best_matches(open_names, entries.select(F.col("_key").alias("name")), token_sets=True).select(F.col("name").alias("_key"), "best", (F.col("ratio") / 100.0).alias("_ratio"))
    third = second.join(close, "_key", "left")
    cited_words, entry_words = fx.long_words(F.col("_key"), SCORING_STOP_WORDS), fx.long_words(F.col("best"), SCORING_STOP_WORDS)
    lifted = (F.col("_ratio") < config.existence_strong) & (F.size(cited_words) > 0) & (F.size(F.array_except(cited_words, entry_words)) == 0)
    score = F.when(lifted, F.lit(config.subset_score)).otherwise(F.col("_ratio"))
    fuzzy_hit = score >= config.existence_accept
    settled = third.select(
        "case_name", "reporter_cite",
        F.when(F.col("exact").isNotNull() | F.col("by_cite").isNotNull(), F.lit(1.0)).when(fuzzy_hit, F.round(score, 4)).otherwise(F.lit(0.0)).alias("existence"),
        F.coalesce("exact", "by_cite", F.when(fuzzy_hit, F.col("best")), F.lit("")).alias("matched_name"),
        F.when(F.col("exact").isNotNull(), "EXACT").when(F.col("by_cite").isNotNull(), "REPORTER").when(fuzzy_hit, "FUZZY").otherwise("NOT_FOUND").alias("match_type"),
    )
    return citations.withColumn("reporter_cite", F.coalesce("reporter_cite", F.lit(""))).join(settled, ["case_name", "reporter_cite"], "left")


def overlap_support(claim: Column, window: Column) -> Column:
    """A stand-in for an entailment model: the share of the claim's words that a window holds."""
    asked = F.array_distinct(fx.tokens(claim))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, fx.tokens(window))) / F.size(asked)).otherwise(F.lit(0.0))


def verdict(exists: Column, support: Column, has_evidence: Column, is_covered: Column, config: EngineConfig = DEFAULTS) -> Column:
    """The tier.  Support, not the product, is held against the thresholds."""
    strong = exists >= config.existence_strong
    unknown = F.when(is_covered, "FABRICATED").otherwise("UNVERIFIABLE")
    return (
        F.when(~has_evidence, F.when(strong, "UNVERIFIABLE").otherwise(unknown))
        .when(~strong, unknown)
        .when(support >= config.support_tau, "SUPPORTED")
        .when(support >= config.support_uncertain, "UNCERTAIN")
        .otherwise("MISATTRIBUTED")
    )


def confidence_score(exists: Column, support: Column, has_evidence: Column) -> Column:
    return F.when(has_evidence, F.round(exists * support, 4)).otherwise(F.lit(0.0))


def same_authority(a: Column, b: Column, config: EngineConfig = DEFAULTS) -> Column:
    """Whether two names mean one authority: one holds the other, or their exact ratio is high."""
    x, y = fx.name_key(a), fx.name_key(b)
    inside = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    return inside | (fuzzy.ratio_udf(x, y) >= config.fuzzy_identity)


def opinions(citations: DataFrame, evidence: DataFrame, search: Search | None = None, most: int = 3, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(citation_id, text): the first ``most`` texts of evidence (case_name, doc_id, text) under each citation's name.

    Names that no text has are searched for (``search``: (query_id, query) -> (query_id, rank, doc_id)), and of
    the first ``most`` hits those whose name means the same authority are taken.
    """
    order = "doc_id" if "doc_id" in evidence.columns else "text"
    asked = written(citations.select("citation_id", "case_name", fx.name_key(F.col("case_name")).alias("_key")), "cited")
    # texts that nobody cites stay where they are
    named = evidence.select(fx.name_key(F.col("case_name")).alias("_key"), F.col(order).alias("_order"), "text").where("_key <> ''").join(asked.select("_key").distinct(), "_key", "left_semi")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_order"))
    first = named.withColumn("_n", rank).where(F.col("_n") <= most)
    exact = asked.join(first, "_key").select("citation_id", "text")
    if search is None:
        return exact
    rest = written(asked.join(named.select("_key").distinct(), "_key", "left_anti").where("_key <> ''"), "not-named")
    names = rest.select("_key").distinct().withColumn("query_id", F.xxhash64("_key"))
    hits = search(names.select("query_id", F.col("_key").alias("query"))).where(F.col("rank") <= most)
    near = hits.join(names, "query_id").join(evidence.select("doc_id", "case_name", "text"), "doc_id").where(same_authority(F.col("_key"), F.col("case_name"), config)).select("_key", "text")
    return exact.unionByName(rest.join(near, "_key").select("citation_id", "text"))


def tiered_support(claims: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column] | None, embed: Callable[[Column], Column] | None = None, config: EngineConfig = BEGINNINGS) -> DataFrame:
    """(citation_id, support, window, evidence) of claims (citation_id, holding) by the texts (citation_id, text) of what they cite.

    With a ``scorer`` of (claim, window) the best window of each claim decides, the first of equal ones; without one the
    best cosine of the claim and a window of ``support_chars`` by ``embed``, from 0 to 1; without either support is 0, for then
    nothing speaks for a claim.  Windows go as far as ``config`` says: to the end of the text in ``DEFAULTS``, which reviews use.
    Equal pairs are scored once.  Claims without a text are not in the result.
    """
    from .chunking import character_windows

    # windows carry what is shown of their text, not the text
    shown = fx.snippet(F.col("text")).alias("evidence")
    if scorer is not None:
        windows = character_windows(texts.select("citation_id", shown, "text"), config.window_chars, config.window_step, config.window_reach)
    else:
        windows = character_windows(texts.where(fx.stripped("text") != "").select("citation_id", shown, "text"), config.support_chars, config.support_step, config.support_reach)
    windows = windows.select("citation_id", "evidence", "window")
    matched = windows.join(claims.select("citation_id", "holding"), "citation_id")
    pairs = matched.select("holding", "window").distinct()
    if scorer is not None:
        score = scorer(F.col("holding"), F.col("window"))
    elif embed is not None:
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(embed(F.col("holding")), embed(F.col("window")))))
    else:
        score = F.lit(0.0)
    scored = matched.join(pairs.withColumn("support", score), ["holding", "window"])
    best = F.min_by(F.struct("support", "window"), F.struct(-F.coalesce("support", F.lit(-1.0)), F.col("window")))
    return scored.groupBy("citation_id").agg(best.alias("_b"), F.min("evidence").alias("evidence")).select("citation_id", "_b.support", "_b.window", "evidence")


def score_citations(citations: DataFrame, catalog: DataFrame, evidence: DataFrame, config: EngineConfig = DEFAULTS, volumes: Iterable[str] = LANDMARK_VOLUMES, support: Callable[[Column, Column], Column] | None = overlap_support, search: Search | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """All of it: ``citations`` (citation_id, case_name, reporter_cite, holding) scored against catalog (name) and evidence (case_name, doc_id, text).

    ``support`` scores (claim, window); None falls back on ``embed`` (``tiered_support``).
    """
    found = existence(citations, catalog, config)
    texts = opinions(found.where("holding <> ''"), evidence, search, config=config)
    supports = tiered_support(found, texts, support, embed, config).select("citation_id", "support", "evidence")
    joined = found.join(supports, "citation_id", "left")
    known = F.col("support").isNotNull()
    held = covered(F.concat_ws(" ", "case_name", "reporter_cite", "holding"), volumes)
    return joined.withColumns({"ccs": confidence_score(F.col("existence"), F.col("support"), known), "tier": verdict(F.col("existence"), F.col("support"), known, held, config)})


def report_keys(citations: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """``citations`` with report_key: the name and its place, from 0, among those of its key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return citations.withColumn("report_key", F.concat(F.col(name), F.lit("#"), place.cast("string")))


def tier_counts(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.count_if(F.col("tier") == t).alias(t.lower()) for t in TIERS])


def score_summary(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean and least score per key; a report without a least score has its mean."""
    mean = F.coalesce(F.round(F.avg("ccs"), 4), F.lit(0.0))
    return scores.groupBy(*keys).agg(mean.alias("avg_ccs"), F.coalesce(F.round(F.min("ccs"), 4), mean).alias("min_ccs"))
