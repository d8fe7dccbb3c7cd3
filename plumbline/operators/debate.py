"""Rules of the two-round review: when to go on, what a judge keeps, what counts as independent evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, RECONCILING_STOP_WORDS, EngineConfig
from ..functions import text as fx


def decision_rule(round_no: Column, avg_ccs: Column, min_ccs: Column, gaps: Column, challenge: Column, concede: Column, config: EngineConfig = DEFAULTS, use_defense: bool | Column = True, use_scoring: bool | Column = True, max_rounds: Column | None = None) -> Column:
    """Number of the first rule that applies: 1 conceded, 2 last round, 3 weak with gaps, 4 challenged with gaps, 5 none."""
    avg, low = F.coalesce(avg_ccs, F.lit(1.0)), F.coalesce(min_ccs, avg_ccs, F.lit(1.0))
    weak = F.lit(use_scoring) & ((avg < config.avg_weak) | (low < config.min_weak))
    strong = F.lit(use_defense) & (F.coalesce(challenge, F.lit(0.0)) > config.challenge_strong)
    open_gaps = F.coalesce(gaps, F.lit(0)) >= config.min_gaps
    return (
        F.when(F.lit(use_defense) & F.coalesce(concede, F.lit(False)), 1)
        .when(F.coalesce(round_no, F.lit(0)) >= (config.max_rounds if max_rounds is None else max_rounds) - 1, 2)
        .when(weak & open_gaps, 3)
        .when(strong & open_gaps, 4)
        .otherwise(5)
    )


def decision(rule: Column) -> Column:
    return F.when(rule.isin(3, 4), "CONTINUE").otherwise("TERMINATE")


def judge_confidence(n_verified: Column, verified_mean: Column, n_uncertain: Column, raw: Column, use_scoring: bool | Column = True) -> Column:
    raw = fx.clamp(raw, 0.0)
    unscored = F.when(raw > 0, raw).otherwise(F.lit(0.70))
    some = F.when(raw > 0, F.lit(0.7) * verified_mean + F.lit(0.3) * raw).otherwise(verified_mean)
    unsure = F.when(raw > 0, F.least(raw, F.lit(0.35))).otherwise(F.lit(0.20))
    scored = F.when(n_verified > 0, some).when(n_uncertain > 0, unsure).otherwise(F.least(raw, F.lit(0.20)))
    return F.round(F.when(F.lit(use_scoring), scored).otherwise(unscored), 2)


def verified_scores(report: DataFrame, tiers: tuple[str, ...] = ("SUPPORTED", "VERIFIED"), default: float = 0.85) -> DataFrame:
    """(query_id, name, score, ord): the best score of each name in those tiers; a score of 0 counts as ``default``."""
    rows = report.where(F.col("tier").isin(*tiers)).select("query_id", fx.name_key(fx.clean_name(F.col("case_name"))).alias("name"), F.when(F.col("ccs") > 0, F.col("ccs")).otherwise(F.lit(default)).alias("score"), "ord")
    return rows.where("name <> ''").groupBy("query_id", "name").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))


def reconcile(cited: DataFrame, verified: DataFrame) -> DataFrame:
    """(query_id, case_name, score, via) of cited (query_id, case_name) that verified (query_id, name, score, ord) backs.

    An equal name decides, else the first entry whose words hold all of the other's or share two; a name
    nothing backs is left out.
    """
    asked = cited.select("query_id", "case_name").distinct().withColumn("name", fx.name_key(fx.clean_name(F.col("case_name")))).where("name <> ''")
    exact = asked.join(verified, ["query_id", "name"]).select("query_id", "case_name", "score", F.lit("exact").alias("via"))
    rest = asked.join(exact.select("query_id", "case_name"), ["query_id", "case_name"], "left_anti").withColumn("words", fx.long_words(F.col("name"), RECONCILING_STOP_WORDS)).where("size(words) > 0")
    entries = verified.select("query_id", "score", "ord", fx.long_words(F.col("name"), RECONCILING_STOP_WORDS).alias("entry_words"))
    left, right = F.col("words"), F.col("entry_words")
    backs = (F.size(F.array_except(left, right)) == 0) | (F.size(F.array_except(right, left)) == 0) | (F.size(F.array_intersect(left, right)) >= 2)
    # words that all of one side's are among the other's meet by the rarest of them, others by two words they share
    held = rest.select("query_id", F.explode("words").alias("word")).unionByName(entries.select("query_id", F.explode("entry_words").alias("word"))).groupBy("query_id", "word").agg(F.count("*").alias("df"))

    def by_words(df: DataFrame, words: str, *keep: str) -> DataFrame:
        return df.select(*keep, F.explode(words).alias("word"))

    def by_rarest(df: DataFrame, words: str, *keep: str) -> DataFrame:
        counted = by_words(df, words, *keep).join(held, ["query_id", "word"])
        return counted.groupBy(*keep).agg(F.min_by("word", F.struct("df", "word")).alias("word"))

    def by_pairs(df: DataFrame, words: str, *keep: str) -> DataFrame:
        ordered = F.array_sort(words)
        pairs = F.flatten(F.transform(ordered, lambda x, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda y: F.concat_ws(" ", x, y))))
        return df.select(*keep, F.explode(pairs).alias("word"))

    asked_keys, entry_keys = ("query_id", "case_name", "words"), ("query_id", "score", "ord", "entry_words")
    ways = [(by_rarest, by_words), (by_words, by_rarest), (by_pairs, by_pairs)]
    met = [x(rest, "words", *asked_keys).join(y(entries, "entry_words", *entry_keys), ["query_id", "word"]).drop("word") for x, y in ways]
    by_word = met[0].unionByName(met[1]).unionByName(met[2])
    # entries without words back every name
    wordless = rest.select(*asked_keys).join(entries.where("size(entry_words) = 0"), "query_id")
    near = by_word.unionByName(wordless).where(backs).groupBy("query_id", "case_name").agg(F.min_by("score", "ord").alias("score")).withColumn("via", F.lit("words"))
    return exact.unionByName(near)


def counter_evidence(hits: DataFrame, own: DataFrame, k: int = 4, parent: bool = False) -> DataFrame:
    """(query_id, rank, doc_id): counter hits that the other side's evidence does not hold.

    ``hits`` (query_id, query_ord, rank, doc_id, text) and ``own`` (query_id, doc_id, text).  Two anti
    joins drop equal ids and equal beginnings; the first k of what is left, in query order, stay.
    ``parent`` compares parent_doc_id in place of doc_id.
    """
    key = "parent_doc_id" if parent else "doc_id"
    start = fx.name_key(F.substring("text", 1, 80))
    marked = hits.withColumn("_start", start)
    mine = own.withColumn("_start", start)
    free = marked.join(mine.select("query_id", key).distinct(), ["query_id", key], "left_anti")
    free = free.join(mine.where("_start <> ''").select("query_id", "_start").distinct(), ["query_id", "_start"], "left_anti")
    first = free.groupBy("query_id", "doc_id").agg(F.min(F.struct("query_ord", "rank")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id")


def evidence_overlap(cited: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, eor): the share of cited names (keys, name) that only the own side's text holds.

    ``texts`` (keys, own, counter) has both sides' evidence, lower-cased; names of up to three letters hold nowhere.
    """
    joined = texts.join(cited, list(keys), "left")
    long = F.length("name") > 3
    echo = long & F.contains("own", F.col("name")) & ~F.contains("counter", F.col("name"))
    share = F.avg(F.when(F.col("name").isNotNull(), F.when(echo, 1.0).otherwise(0.0)))
    return joined.groupBy(*keys).agg(F.coalesce(F.round(share, 4), F.lit(0.0)).alias("eor"))
