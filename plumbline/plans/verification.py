"""Queries of citation matching, scoring and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..operators import verify
from .registry import query
from .shared import table

#: Cited part names: as they are, their first word, their last word first, or with a letter doubled and one lost.
CITED_SQL = """
    cited AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1)
                  WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
                  ELSE substring(p_name, 1, 1) || substring(p_name, 1, length(p_name) - 1) END AS name FROM part),
    held AS (SELECT DISTINCT p_name AS name FROM part)"""


def cited_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, way = F.col("p_name"), F.col("p_partkey") % 4
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    other = F.concat(F.substring(name, 1, 1), F.substr(name, F.lit(1), F.length(name) - 1))
    return table(spark, sf_dir, "part").select(F.when(way == 0, name).when(way == 1, first).when(way == 2, F.concat_ws(" ", second, first)).otherwise(other).alias("name")).distinct()


def held_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


_LONG = r"list_distinct(regexp_extract_all(lower({0}), '\b[a-zA-Z]{{3,}}\b'))"


@query("token_subset_match", f"""
    WITH {CITED_SQL}, a AS (SELECT name, {_LONG.format('name')} AS w FROM cited), e AS (SELECT name AS entry, {_LONG.format('name')} AS ew FROM held),
    p AS (SELECT name, entry, len(list_intersect(w, ew)) AS n, len(w) AS nw, len(list_distinct(w || ew)) AS u FROM a, e WHERE list_has_any(w, ew)),
    s AS (SELECT name, entry, n = nw AS via_subset, round(CASE WHEN n = nw THEN 0.9e0 ELSE n / u END, 6) AS score FROM p)
    SELECT name, entry AS best, score, via_subset FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, entry) AS r FROM s) WHERE r = 1""")  # fmt: skip
def token_subset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.subset_matches(cited_names(spark, sf_dir), held_names(spark, sf_dir))


@query("reporter_match", """
    WITH c AS (SELECT DISTINCT p_brand AS cite, p_name AS case_name FROM part), e AS (SELECT DISTINCT p_brand || ' ' || p_name AS name FROM part),
    cw AS (SELECT cite, case_name, unnest(string_split(case_name, ' ')) AS word FROM c), ew AS (SELECT name, unnest(string_split(name, ' ')) AS word FROM e)
    SELECT cite, count(DISTINCT case_name || '|' || name) AS n_matched FROM cw JOIN ew USING (word)
    WHERE length(word) >= 3 AND contains(lower(name), lower(cite)) GROUP BY cite""")  # fmt: skip
def reporter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    cites = parts.select(F.col("p_brand").alias("cite"), F.col("p_name").alias("case_name")).distinct()
    entries = parts.select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct()
    return verify.reporter_matches(cites, entries).groupBy("cite").agg(F.count("*").alias("n_matched"))


@query("fuzzy_lev_candidates", f"""
    WITH {CITED_SQL}, p AS (SELECT c.name, h.name AS candidate, levenshtein(c.name, h.name) AS lev, length(c.name) + length(h.name) AS total FROM cited c, held h)
    SELECT name, candidate, lev, round(1e0 - lev / total, 6) AS bound FROM p WHERE round(1e0 - lev / total, 6) >= 0.85""")  # fmt: skip
def fuzzy_lev_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.edit_candidates(cited_names(spark, sf_dir), held_names(spark, sf_dir), 0.85)


@query("fuzzy_indel_best")
def fuzzy_indel_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact ratio: SQL has no such function; tests hold it against brute force."""
    return fuzzy.best_matches(cited_names(spark, sf_dir), held_names(spark, sf_dir))


@query("fuzzy_edit_best", f"""
    WITH {CITED_SQL}, p AS (SELECT c.name, h.name AS best, round(100e0 * (1e0 - levenshtein(c.name, h.name) / greatest(length(c.name), length(h.name))), 0)::INTEGER AS ratio FROM cited c, held h)
    SELECT name, best, ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, best) AS r FROM p) WHERE r = 1""")  # fmt: skip
def fuzzy_edit_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cited_names(spark, sf_dir).crossJoin(F.broadcast(held_names(spark, sf_dir).withColumnRenamed("name", "entry")))
    scored = pairs.withColumn("ratio", fuzzy.edit_ratio(F.col("name"), F.col("entry")))
    best = F.min_by(F.struct("entry", "ratio"), F.struct(-F.col("ratio"), F.col("entry")))
    return scored.groupBy("name").agg(best.alias("b")).select("name", F.col("b.entry").alias("best"), F.col("b.ratio").alias("ratio"))


@query("citation_existence")
def citation_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, by cite, then by ratio and word sets; the last has no SQL form."""
    cited = cited_names(spark, sf_dir).select(F.col("name").alias("case_name"), F.lit("").alias("reporter_cite"))
    return verify.existence(cited, held_names(spark, sf_dir)).select("case_name", "existence", "matched_name", "match_type")


#: Events as scored citations: the value gives existence, the number support, errors have no evidence.
SCORED_SQL = """
    ev AS (SELECT event_id, user_id, event_type, ts, round(value / 490.02e0, 4) AS existence, CASE WHEN event_type = 'error' THEN NULL ELSE (event_id * 37 % 101) / 101e0 END AS support,
                  user_id % 2 = 0 AS held FROM events),
    scored AS (SELECT *, CASE WHEN support IS NULL THEN 0e0 ELSE round(existence * support, 4) END AS ccs,
                  CASE WHEN support IS NULL AND existence >= 0.85 THEN 'UNVERIFIABLE' WHEN existence < 0.85 AND held THEN 'FABRICATED' WHEN existence < 0.85 THEN 'UNVERIFIABLE'
                       WHEN support >= 0.70 THEN 'SUPPORTED' WHEN support >= 0.40 THEN 'UNCERTAIN' ELSE 'MISATTRIBUTED' END AS tier FROM ev)"""


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    exists = F.round(F.col("value") / 490.02, 4)
    support = F.when(F.col("event_type") != "error", (F.col("event_id") * 37 % 101) / F.lit(101.0))
    rows = rows.select("event_id", "user_id", "event_type", "ts", exists.alias("existence"), support.alias("support"), (F.col("user_id") % 2 == 0).alias("held"))
    known = F.col("support").isNotNull()
    return rows.withColumns({"ccs": verify.confidence_score(F.col("existence"), F.col("support"), known), "tier": verify.verdict(F.col("existence"), F.col("support"), known, F.col("held"))})


@query("ccs_verdict", f"WITH {SCORED_SQL} SELECT event_id AS case_key, existence, support, ccs, tier FROM scored")
def ccs_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(spark, sf_dir).select(F.col("event_id").alias("case_key"), "existence", "support", "ccs", "tier")


_TIER_SUMS = ", ".join(f"count(*) FILTER (tier = '{t}') AS {t.lower()}" for t in ("SUPPORTED", "UNCERTAIN", "MISATTRIBUTED", "FABRICATED", "UNVERIFIABLE"))


@query("tier_pivot", f"WITH {SCORED_SQL} SELECT event_type AS agent, {_TIER_SUMS} FROM scored GROUP BY event_type")
def tier_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.tier_counts(scored_events(spark, sf_dir).withColumnRenamed("event_type", "agent"), "agent")


@query("avg_min_ccs", f"WITH {SCORED_SQL} SELECT user_id AS query_id, round(avg(ccs), 4) AS avg_ccs, round(min(ccs), 4) AS min_ccs FROM scored GROUP BY user_id")
def avg_min_ccs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.score_summary(scored_events(spark, sf_dir).withColumnRenamed("user_id", "query_id"), "query_id")
