"""Whole runs: the benchmark, its single-speaker baseline, the ablation, the stress test and the evaluation row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, OFF_CORPUS_CASES, EngineConfig
from ..engine import Engine
from ..functions import fuzzy
from ..functions import text as fx
from ..models import cosine, embedded
from ..operators import agents, metrics, stress, verify
from ..storage import shared_path, written
from .loop import Session, ablations, draft, named_documents, review_with_scores
from .measures import CASES_SQL, CITES_SQL, DEBATES_SQL, KINDS_SQL, RATIO_SQL, cases, cites, debates, held_names, kinds
from .registry import query
from .shared import documents, questions, table


def engine_of(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine.build(named_documents(documents(spark, sf_dir).select("doc_id", "text")), shared_path(spark, "engine"))


def similarity(results: DataFrame, truth: DataFrame, engine: Engine) -> DataFrame:
    """(query_id, similarity) of answers and truth (query_id, holding), by vectors; null where either is missing."""
    both = results.select("query_id", "answer").join(truth.select("query_id", "holding"), "query_id", "left")
    some = (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("holding", F.lit("")) != "")
    return both.select("query_id", F.when(some, F.round(cosine(embedded(F.col("answer"), engine.embedder), embedded(F.col("holding"), engine.embedder)), 4)).alias("similarity"))


def cards(results: DataFrame, scores: DataFrame, truth: DataFrame, engine: Engine, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Scorecards of results and scores against truth (query_id, target_case, holding), with cas, eor and confidence."""
    targets = truth.select("query_id", "target_case").join(results, "query_id").join(similarity(results, truth, engine), "query_id", "left")
    rows = targets.select(F.col("query_id").alias("case_id"), "target_case", "similarity", (F.col("rule_no") == 1).alias("conceded"), F.col("confidence").alias("judge_confidence"), "n_rejected")
    cited = scores.select(F.col("query_id").alias("case_id"), F.col("case_name").alias("name"))
    found = metrics.scorecards(rows, cited, metrics.classify_names(cited, engine.names(), config), scores.select(F.col("query_id").alias("case_id"), "tier"), config)
    more = results.select(F.col("query_id").alias("case_id"), "eor", "confidence", "decision")
    return found.join(more, "case_id").withColumn("cas", F.col("ass"))


def truth_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's target is the document of its number, its holding the question's own text."""
    return questions(spark, sf_dir).select("query_id", F.concat(F.lit("Case "), F.col("query_id").cast("string")).alias("target_case"), F.col("query").alias("holding"))


@query("benchmark_run")
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review of all questions, their scorecards, and the means of the twelve rates; tests hold the means against the cards."""
    engine = engine_of(spark, sf_dir)
    results, scores = review_with_scores(questions(spark, sf_dir), engine)
    return metrics.macro_means(written(cards(results, scores, truth_of(spark, sf_dir), engine), "cards"))


def baseline(asked: DataFrame, s: Session) -> tuple[DataFrame, DataFrame]:
    """One speaker and no review: (results, scores) from the first four passages; its confidence is fixed."""
    own = written(s.engine.search(asked, s.config).where("rank <= 4").join(s.engine.texts, "doc_id"), "own")
    given = asked.join(agents.passages_of(own), "query_id", "left").withColumn("given", F.concat_ws("\n", "query", "passages"))
    said = written(agents.says(given, "PROSECUTOR", F.col("given"), s.generate, "query_id"), "baseline")
    cited = agents.citations_of(said, "baseline")
    scores = cited.select("query_id", "agent", F.col("place").alias("ordinal"), "case_name", F.lit("UNVERIFIABLE").alias("tier"))
    results = said.select("query_id", F.col("said.argument").alias("answer"), F.lit(0.70).alias("confidence"), F.lit(0.0).alias("eor"), F.lit(5).alias("rule_no"), F.lit("TERMINATE").alias("decision"), F.lit(0).alias("n_rejected"))
    return results, scores


@query("baseline_run")
def baseline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_of(spark, sf_dir)
    results, scores = baseline(questions(spark, sf_dir), Session(engine))
    return metrics.macro_means(written(cards(results, scores, truth_of(spark, sf_dir), engine), "cards"))


@query("draft_run", "SELECT item_id AS query_id, 1 AS rounds, 'TERMINATE' AS decision, 0 AS n_verified FROM benchmark")
def draft_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without scoring and memory every question ends after a round and nothing is verified."""
    found = draft(questions(spark, sf_dir), engine_of(spark, sf_dir))
    return found.select("query_id", "rounds", "decision", F.col("n_verified").cast("int").alias("n_verified"))


@query("ablation_run")
def ablation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant over all questions, of which every tenth is asked twice, and its summary."""
    engine = engine_of(spark, sf_dir)
    asked = questions(spark, sf_dir)
    twice = asked.unionByName(asked.where("query_id % 10 = 0").withColumn("query_id", F.col("query_id") + 1_000_000_000))
    runs = written(ablations(twice, engine), "ablations")
    rates = runs.select("variant", F.lit("OK").alias("status"), metrics.rate(F.coalesce("n_rejected", F.lit(0)), F.coalesce("n_citations", F.lit(0))).alias("hr"), F.coalesce("avg_ccs", F.lit(0.0)).alias("cas"), "confidence")
    cached = runs.groupBy("variant").agg(metrics.count_if(F.col("decision") == "CACHED").alias("n_cached"))
    return metrics.ablation_summary(rates).join(cached, "variant")


def stress_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases, items as invented ones: every citation of the six classes, scored."""
    docs = named_documents(documents(spark, sf_dir).select("doc_id", "text"))
    held = table(spark, sf_dir, "labels").select("doc_id").distinct().join(docs, "doc_id")
    words = F.array_join(F.slice(fx.words(F.col("text")), 1, 12), " ")
    known = held.select(F.col("doc_id").alias("id"), "case_name", F.lit("").alias("reporter_cite"), words.alias("holding"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("not held there "), F.col("doc_id").cast("string"))).otherwise("").alias("distractor"))
    invented = questions(spark, sf_dir).select(F.col("query_id").alias("id"), F.concat(F.lit("Invented Holdings no. "), F.col("query_id").cast("string")).alias("case_name"), F.concat((F.col("query_id") % 500 + 1).cast("string"), F.lit(" U.S. 1")).alias("reporter_cite"), F.lit("that never was").alias("holding"))
    off = spark.createDataFrame([(i, n) for i, n in enumerate(OFF_CORPUS_CASES)], "id long, case_name string").select("id", "case_name", F.lit("").alias("reporter_cite"), F.lit("well known").alias("holding"))
    rows = stress.stress_set(written(known, "stress-cases"), invented, off)
    cited = written(rows.withColumn("citation_id", F.xxhash64("type", "item")), "stress-set")
    return verify.score_citations(cited, docs.select(F.col("case_name").alias("name")), docs)


@query("stress_run")
def stress_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verifier over the labelled citations, by class; existence has no SQL form, tests hold it against brute force."""
    return metrics.stress_summary(stress_scores(spark, sf_dir).select("type", "tier"))


@query("evaluation_row", f"""WITH {CITES_SQL}, {KINDS_SQL}, {CASES_SQL}, {DEBATES_SQL},
    h AS (SELECT count(*) AS n, count(*) FILTER (kind <> 'KNOWN') AS f, count(*) FILTER (kind = 'FABRICATED') AS x, count(*) FILTER (kind = 'OFF_CORPUS') AS o, count(*) FILTER (tier = 'MISATTRIBUTED') AS m FROM named),
    s AS (SELECT coalesce(round(avg(similarity), 4), 0e0) AS ass, count(*) FILTER (similarity > 0.70) AS nc, count(similarity) AS nt, count(*) AS n_cases FROM cases),
    c AS (SELECT count(*) AS k, count(*) FILTER ({RATIO_SQL.format('lower(trim(name))', 'lower(target_case)')} >= 80) AS q, count(*) FILTER (tier = 'SUPPORTED') AS u FROM cites JOIN cases USING (case_id)),
    g AS (SELECT count(*) AS nd, count(*) FILTER (conceded OR (len(judge_names) > 0 AND list_has_all(list_transform(prosecutor_names, lambda x: lower(x)), list_transform(judge_names, lambda x: lower(x)))) OR (judge_confidence >= 0.80 AND avg_ccs >= 0.75)) AS met FROM deb)
    SELECT round(f / n, 4) AS hr, round(x / n, 4) AS cfr, round(o / n, 4) AS oor, round(m / n, 4) AS mar, ass, round(nc / nt, 4) AS cas, round(q / k, 4) AS ap, round(q / n_cases, 4) AS ar, round(u / k, 4) AS haa, round(met / nd, 4) AS dcr FROM h, s, c, g""")  # fmt: skip
def evaluation_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of rates of one batch in one row."""
    cited = cites(spark, sf_dir)
    rates = metrics.hallucination(metrics.with_kinds(cited, kinds(spark, sf_dir)))
    answers = metrics.answers(cases(spark, sf_dir), cited, measure=fuzzy.edit_ratio)
    return metrics.evaluation(rates, answers, metrics.convergence(debates(spark, sf_dir))).select("hr", "cfr", "oor", "mar", "ass", "cas", "ap", "ar", "haa", "dcr")


@query("macro_means", f"""WITH {CASES_SQL} SELECT count(*) AS total, count(*) FILTER (case_id % 9 <> 0) AS completed, count(*) FILTER (case_id % 9 = 0) AS crashed,
    {", ".join(f"round(avg(CASE WHEN case_id % 9 <> 0 THEN (case_id * {i + 3} % 101) / 101e0 END), 4) AS mean_{c}" for i, c in enumerate(metrics.MEANS))} FROM cases""")  # fmt: skip
def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of twelve rates over cards of which some failed."""
    key = F.col("case_id")
    rows = cases(spark, sf_dir).select(F.when(key % 9 == 0, "ERROR").otherwise("OK").alias("status"), *[(key * (i + 3) % 101 / F.lit(101.0)).alias(c) for i, c in enumerate(metrics.MEANS)])
    return metrics.macro_means(rows)


@query("known_names", f"WITH {CITES_SQL} SELECT name FROM held")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored catalog, written and loaded again."""
    folder = shared_path(spark, "catalog")
    held_names(spark, sf_dir).write.parquet(folder)
    return spark.read.parquet(folder)
