"""The review loop over a batch of questions.

A round retrieves evidence for all open questions by both lists, lets one side argue from it, lets the other answer
from evidence of its own, scores what both cite, reflects and decides.  There are two rounds at most, so the loop is
unrolled: questions that go on get a second round, with what was found missing added to them.  A judge keeps what
scoring backs.  With a memory, questions that were answered before are answered from it, and names that
failed before are pointed out to the defense; without one nothing of the kind happens.

Everything between the steps is a table of a row a question or a citation, written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ABLATIONS, DEFAULTS, EngineConfig
from ..engine import Engine, SharedSearch
from ..functions import text as fx
from ..models import Generator, embedded, scripted_generator
from ..operators import agents, debate, dense, memory, verify
from ..operators.ranks import global_ranks
from ..storage import shared_path, written

#: The place of a citation in the order of a session: its question's number, then its own there.
SEQ = "struct<query_id:long,ordinal:long>"
ASKED = "query_id long, query string, jurisdiction string"


@dataclass(frozen=True)
class Memory:
    """verdicts (key, query, answer, confidence, seq) and risks (key, name, total, n, last)."""

    verdicts: DataFrame
    risks: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Memory:
        return cls(spark.createDataFrame([], "key string, query string, answer string, confidence double, seq long"), spark.createDataFrame([], "key string, name string, total double, n long, last struct<seq:" + SEQ + ",tier:string>"))

    def answered(self, asked: DataFrame, engine: Engine, config: EngineConfig) -> DataFrame:
        """(query_id, answer, confidence) of questions close to one that was answered before."""
        stored = self.verdicts.select(F.xxhash64("key").alias("vec_id"), "query", "answer", "confidence")
        vectors = stored.select("vec_id", embedded(F.col("query"), engine.embedder).alias("embedding"))
        queries = asked.where("trim(query) <> ''").select("query_id", embedded(F.col("query"), engine.embedder).alias("embedding"))
        hits = dense.cache_hits(queries, vectors, config.cache_distance, exclude_self=False).where("hit")
        return hits.join(stored, hits["nearest_id"] == stored["vec_id"]).select("query_id", "answer", "confidence")

    def warnings(self, asked: DataFrame, engine: Engine, config: EngineConfig) -> DataFrame:
        """(query_id, warning): names near to a question whose citations failed before."""
        names = self.risks.select(F.xxhash64("key").alias("vec_id"), "name", (F.col("total") / F.col("n")).alias("avg_ccs"))
        vectors = names.select("vec_id", embedded(F.col("name"), engine.embedder).alias("embedding"))
        queries = asked.select("query_id", embedded(F.col("query"), engine.embedder).alias("embedding"))
        risky = memory.high_risk(dense.nearest(queries, vectors, config.risk_k), names.select("vec_id", "avg_ccs"), config.risk_k, config.risk_threshold)
        listed = risky.join(names, "vec_id").groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
        return listed.select("query_id", F.concat(F.lit("Failed before: "), F.array_join("names", "; ")).alias("warning"))

    def with_results(self, results: DataFrame, scores: DataFrame) -> Memory:
        """The memory after a session of results (query_id, query, answer, confidence, n_verified) and scores (query_id, ordinal, case_name, ccs, tier)."""
        kept = memory.verdict_rows(results.withColumn("seq", F.col("query_id")))
        rows = scores.withColumn("seq", F.struct("query_id", F.col("ordinal").cast("bigint").alias("ordinal")))
        names = rows.groupBy(fx.stable_key(F.col("case_name")).alias("key")).agg(F.min("case_name").alias("name"))
        fresh = memory.risk_index(memory.risk_rows(rows)).join(names, "key")
        both = self.risks.unionByName(fresh.select(*self.risks.columns))
        merged = memory.merge_risk(both.drop("name")).join(both.groupBy("key").agg(F.min("name").alias("name")), "key").select(*self.risks.columns)
        return Memory(written(memory.upsert(self.verdicts, kept), "verdicts"), written(merged, "risks"))


@dataclass(frozen=True)
class Session:
    """What a review works with, and which of its parts are on."""

    engine: Engine
    generate: Callable[[], Generator] = scripted_generator
    config: EngineConfig = DEFAULTS
    use_defense: bool = True
    use_scoring: bool = True
    use_memory: bool = True


def cite_rows(said: DataFrame, defended: DataFrame) -> DataFrame:
    """(citation_id, query_id, agent, ordinal, case_name, reporter_cite, holding): both sides' citations, one side's after the other's.

    ``citation_id`` is (query_id, ordinal), so no two citations share one, however many a question has.
    """
    both = agents.citations_of(said, "prosecutor").unionByName(agents.citations_of(defended, "defense"))
    before = said.select("query_id", F.size("said.citations").alias("_before"))
    placed = both.join(before, "query_id").withColumn("ordinal", F.col("place") + F.when(F.col("agent") == "defense", F.col("_before")).otherwise(0))
    return placed.select(F.struct("query_id", F.col("ordinal").cast("bigint").alias("ordinal")).alias("citation_id"), "query_id", "agent", "ordinal", "case_name", "reporter_cite", "holding")


#: What may differ from question to question in one batch.
SWITCHES = ["defense", "scoring", "max_rounds"]


def switched(asked: DataFrame, s: Session) -> DataFrame:
    """``asked`` with SWITCHES: its own, else the session's.  The session's parts that are off are off for all."""
    own = {"defense": F.lit(s.use_defense), "scoring": F.lit(s.use_scoring), "max_rounds": F.lit(s.config.max_rounds)}
    return asked.withColumns({k: v for k, v in own.items() if k not in asked.columns})


def unscored(cited: DataFrame) -> DataFrame:
    return cited.withColumns({"existence": F.lit(1.0), "matched_name": F.col("case_name"), "match_type": F.lit("UNSCORED"), "support": F.lit(0.5), "evidence": F.lit(""), "ccs": F.lit(0.5), "tier": F.lit("UNCERTAIN")})


def run_round(asked: DataFrame, s: Session, round_no: int, warnings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row a question, a row a scored citation) of a round over asked (query_id, query, jurisdiction, more, and SWITCHES if it has them)."""
    config, texts, mixed = s.config, s.engine.texts, "scoring" in asked.columns
    asked = switched(asked, s)
    augmented = fx.augmented(F.col("query"), F.col("more"), F.lit(round_no))
    # the jurisdiction is for the vectors: as words of the lexical side it would find its own name
    queries = asked.select("query_id", augmented.alias("query"), fx.with_jurisdiction(augmented, F.col("jurisdiction")).alias("dense_query"))
    own = written(s.engine.search(queries, config).join(texts, "doc_id"), "own")
    given = asked.join(agents.passages_of(own), "query_id", "left").withColumn("given", F.concat_ws("\n", "query", "passages"))
    said = written(agents.says(given, "PROSECUTOR", F.col("given"), s.generate, "query_id", "query", "defense"), "prosecution")
    defended, counter = said.select("query_id", F.lit(None).cast(agents.SAID).alias("said")).where("false"), None
    if s.use_defense:
        cites = F.transform("said.citations", lambda c: F.struct(c["case_name"], c["holding"]))
        against = said.where("defense AND trim(query) <> ''").select("query_id", F.posexplode(fx.counter_queries(F.col("query"), cites)).alias("query_ord", "counter"))
        against = written(against.withColumn("number", F.monotonically_increasing_id()), "against")
        hits = s.engine.search(against.select(F.col("number").alias("query_id"), F.col("counter").alias("query")), config).withColumnRenamed("query_id", "number")
        hits = hits.join(against.select("number", "query_id", "query_ord"), "number").select("query_id", "query_ord", "rank", "doc_id").join(texts.select("doc_id", "text"), "doc_id")
        counter = written(debate.counter_evidence(hits, own, config.lexical_k).join(texts, "doc_id"), "counter")
        given = said.where("defense").join(agents.passages_of(counter), "query_id", "left")
        if warnings is not None:
            given = given.join(warnings, "query_id", "left")
        note = F.col("warning") if warnings is not None else F.lit(None).cast("string")
        defended = written(agents.says(given.withColumn("given", F.concat_ws("\n", "said.argument", "passages", note)), "DEFENSE", F.col("given"), s.generate, "query_id"), "defense")

    # a question's memory of citations is one table; each citation has a place of its own
    cited = written(cite_rows(said, defended), "citations")
    if not s.use_scoring:
        scored = unscored(cited)
    else:
        checked, left = cited, None
        if mixed:
            off = asked.where("NOT scoring").select("query_id")
            checked, left = written(cited.join(off, "query_id", "left_anti"), "checked"), cited.join(off, "query_id", "left_semi")
        scored = verify.score_citations(checked, s.engine.names(), texts, config, search=lambda q: s.engine.search(q, config))
        if left is not None:
            scored = scored.unionByName(unscored(left))
    scores = written(scored.select("query_id", "agent", "ordinal", "case_name", "existence", "matched_name", "match_type", "support", "ccs", "tier"), "scores")
    sums = scores.groupBy("query_id").agg(
        F.count("*").alias("n_citations"), F.round(F.avg("ccs"), 4).alias("avg_ccs"), F.round(F.min("ccs"), 4).alias("min_ccs"),
        F.count_if(F.col("tier") == "SUPPORTED").alias("n_supported"), F.count_if(F.col("tier") == "UNCERTAIN").alias("n_uncertain"),
    )
    report = asked.select("query_id", "query").join(agents.report_of(scores), "query_id", "left")
    thought = written(agents.says(report, "REFLECTION", F.col("report"), s.generate, "query_id").select("query_id", F.col("said.gaps").alias("gaps"), F.col("said.queries").alias("next")), "reflection")
    answer = defended.select("query_id", F.col("said.challenge").alias("challenge"), F.col("said.concede").alias("concede"))
    rows = asked.select("query_id", "query", "jurisdiction", *SWITCHES).join(sums, "query_id", "left").join(thought, "query_id", "left").join(answer, "query_id", "left")
    if counter is not None:
        rows = rows.join(overlap(own, counter, defended), "query_id", "left")
    else:
        rows = rows.withColumn("eor", F.lit(0.0))
    rows = rows.fillna(0, ["n_citations", "n_supported", "n_uncertain"]).fillna(0.0, ["eor"])
    rule = debate.decision_rule(F.lit(round_no), F.col("avg_ccs"), F.col("min_ccs"), F.coalesce(F.size("gaps"), F.lit(0)), F.col("challenge"), F.col("concede"), config, F.col("defense"), F.col("scoring"), F.col("max_rounds"))
    found = rows.withColumns({"rounds": F.lit(round_no + 1), "rule_no": rule, "n_gaps": F.coalesce(F.size("gaps"), F.lit(0))}).withColumn("decision", debate.decision(F.col("rule_no")))
    return written(found, "round"), scores


def overlap(own: DataFrame, counter: DataFrame, defended: DataFrame) -> DataFrame:
    """(query_id, eor): the share of the defense's names that only the other side's evidence holds."""
    def side(df: DataFrame, name: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "case_name", "text").alias("t"))))
        return df.groupBy("query_id").agg(F.lower(F.array_join(F.transform(parts, lambda x: x["t"]), " ")).alias(name))

    names = agents.citations_of(defended, "defense").select("query_id", F.lower("case_name").alias("name")).distinct()
    texts = defended.select("query_id").join(side(own, "own"), "query_id", "left").join(side(counter, "counter"), "query_id", "left").fillna("", ["own", "counter"])
    return debate.evidence_overlap(names, texts, "query_id")


def judged(rounds: DataFrame, scores: DataFrame, s: Session) -> DataFrame:
    """The last rounds with answer, n_verified and confidence: names of the judge that scoring does not back are left out."""
    report = rounds.select("query_id", "query").join(agents.report_of(scores), "query_id", "left")
    said = written(agents.says(report, "JUDGE", F.concat_ws("\n", "query", "report"), s.generate, "query_id"), "judgement")
    backed = debate.verified_scores(scores.withColumn("ord", F.col("ordinal")))
    names = said.select("query_id", F.explode("said.citations").alias("c")).select("query_id", F.col("c.case_name").alias("case_name"))
    kept = debate.reconcile(names, backed).groupBy("query_id").agg(F.count("*").alias("n_verified"), F.avg("score").alias("verified_mean"))
    answers = said.select("query_id", fx.first_of(F.col("said.verdict"), F.col("said.argument")).alias("answer"), F.col("said.confidence").alias("raw"), F.size("said.citations").alias("n_named"))
    rows = rounds.join(answers, "query_id", "left").join(kept, "query_id", "left").fillna(0, ["n_verified", "n_named"])
    confidence = debate.judge_confidence(F.col("n_verified"), F.col("verified_mean"), F.col("n_uncertain"), F.col("raw"), F.col("scoring"))
    # nothing was cited: there is nothing to be sure of
    sure = F.when((F.col("n_citations") == 0) & F.col("scoring"), F.lit(0.0)).otherwise(confidence)
    return rows.withColumns({"confidence": sure, "n_rejected": F.col("n_named") - F.col("n_verified")})


RESULTS = (
    "query_id long, query string, rounds int, decision string, rule_no int, n_citations long, n_verified long, n_rejected long, n_uncertain long, answer string, confidence double, eor double, avg_ccs double, min_ccs double"
)
SCORES = "query_id long, agent string, ordinal int, case_name string, existence double, matched_name string, match_type string, support double, ccs double, tier string"
COLUMNS = ["query_id", "query", "rounds", "decision", "rule_no", "n_citations", "n_verified", "n_rejected", "n_uncertain", "answer", "confidence", "eor", "avg_ccs", "min_ccs"]


def split_by_cache(asked: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions answered by the cache (query_id, hit, nearest_id) and those that are not."""
    known = hits.where("hit").select("query_id", "nearest_id")
    return asked.join(known, "query_id"), asked.join(known, "query_id", "left_anti")


def session(asked: DataFrame, s: Session, remembered: Memory | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, scores) of asked (query_id, query, jurisdiction): a row a question (COLUMNS), and a row a citation of its last round."""
    if not s.use_memory or remembered is None:
        return reviewed(asked, s, None)
    return answered_or_reviewed(asked, s, written(remembered.answered(asked, s.engine, s.config), "cached"), remembered.warnings(asked, s.engine, s.config))


def answered_or_reviewed(asked: DataFrame, s: Session, cached: DataFrame, warnings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, scores) of asked, of which cached (query_id, answer, confidence) are not reviewed."""
    results, scores = reviewed(asked.join(cached.select("query_id"), "query_id", "left_anti"), s, warnings)
    # columns a cached answer has no figures for are null
    known = asked.join(cached, "query_id").withColumns({"rounds": F.lit(0), "decision": F.lit("CACHED"), "n_citations": F.lit(0).cast("bigint"), "n_verified": F.lit(0).cast("bigint"), "eor": F.lit(0.0)})
    return results.unionByName(known.select(*[F.col(c) if c in known.columns else F.lit(None).cast(results.schema[c].dataType).alias(c) for c in COLUMNS])), scores


def reviewed(open_: DataFrame, s: Session, warnings: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(results, scores) of one or two rounds; steps that have no question are left out."""
    spark = open_.sparkSession
    if not open_.take(1):
        return spark.createDataFrame([], RESULTS), spark.createDataFrame([], SCORES)
    none = F.array().cast("array<string>")
    mixed = [c for c in SWITCHES if c in open_.columns]
    first, scores = run_round(open_.withColumn("more", none), s, 0, warnings)
    again = first.where("decision = 'CONTINUE'")
    if s.config.max_rounds > 1 and again.take(1):
        second, more = run_round(again.select("query_id", "query", "jurisdiction", F.coalesce("next", none).alias("more"), *mixed), s, 1, warnings)
        first = written(first.where("decision <> 'CONTINUE'").unionByName(second), "rounds")
        scores = scores.join(again.select("query_id"), "query_id", "left_anti").unionByName(more)
    return judged(first, scores, s).select(*COLUMNS), scores


def asked_rows(asked: DataFrame) -> DataFrame:
    jurisdiction = F.coalesce("jurisdiction", F.lit("")) if "jurisdiction" in asked.columns else F.lit("")
    return asked.select("query_id", F.coalesce("query", F.lit("")).alias("query"), jurisdiction.alias("jurisdiction"))


def review(asked: DataFrame, s: Session | Engine | DataFrame, remembered: Memory | None = None) -> DataFrame:
    """One row per question of asked; see ``review_with_scores``."""
    return review_with_scores(asked, s, remembered)[0]


def review_with_scores(asked: DataFrame, s: Session | Engine | DataFrame, remembered: Memory | None = None) -> tuple[DataFrame, DataFrame]:
    """A row per question of asked (query_id, query, and jurisdiction if it has one), and a row per citation of its last round.

    Of questions with equal text the first is reviewed; with memory on, the others are answered from what was
    kept of it, if anything was, and reviewed after it otherwise.  ``s`` may be an engine or documents.
    """
    s = as_session(s)
    rows = written(asked_rows(asked), "asked")
    memory_ = (remembered or Memory.empty(rows.sparkSession)) if s.use_memory else None
    firsts = rows.groupBy(fx.name_key(F.col("query")).alias("_key")).agg(F.min("query_id").alias("query_id")).select("query_id")
    results, scores = session(rows.join(firsts, "query_id", "left_semi"), s, memory_ if remembered else None)
    repeats = rows.join(firsts, "query_id", "left_anti")
    results = written(results, "results")
    if not repeats.take(1):
        return results, scores
    later, more = session(repeats, s, memory_.with_results(results.where("decision <> 'CACHED'"), scores) if memory_ else None)
    return results.unionByName(later), scores.unionByName(more)


def draft(asked: DataFrame, s: Session | Engine | DataFrame) -> DataFrame:
    """The review without scoring and memory, in one round: every citation counts as uncertain, and every question ends."""
    s = as_session(s)
    return review(asked, replace(s, config=replace(s.config, max_rounds=1), use_scoring=False, use_memory=False))


def named_documents(docs: DataFrame) -> DataFrame:
    """Documents with the columns an engine is built of; those without a name are called by their id."""
    extra = {"case_name": F.concat(F.lit("Case "), F.col("doc_id").cast("string")), "year": F.lit(0), "reporter_cite": F.lit("")}
    return docs.withColumns({k: v for k, v in extra.items() if k not in docs.columns})


def as_session(s: Session | Engine | DataFrame) -> Session:
    if isinstance(s, Session):
        return s
    engine = s if isinstance(s, Engine) else Engine.build(named_documents(s), shared_path(s.sparkSession, "engine"))
    return Session(engine)


def ablations(asked: DataFrame, s: Session | Engine | DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The review once per variant, over one engine: (variant, query_id, ...).

    All variants are one batch, a row a question and variant with a number of its own, in the order of the questions; a query that
    several variants search for is searched for once.  Each variant that remembers has a memory of its own.
    """
    s = as_session(s)
    spark = s.engine.texts.sparkSession
    rounds = max(v[4] for v in ABLATIONS)
    s = replace(s, engine=SharedSearch.of(s.engine), config=replace(config, max_rounds=rounds), use_defense=True, use_scoring=True, use_memory=True)
    variants = spark.createDataFrame([(i, *v) for i, v in enumerate(ABLATIONS)], "variant_no long, variant string, defense boolean, scoring boolean, memory boolean, max_rounds int")
    numbered = global_ranks(asked_rows(asked), "query_id").crossJoin(F.broadcast(variants))
    number = F.col("rank") * len(ABLATIONS) + F.col("variant_no")
    rows = written(numbered.select(F.col("query_id").alias("own_id"), number.alias("query_id"), "query", "jurisdiction", "variant", *SWITCHES), "asked")
    firsts = rows.groupBy("variant", fx.name_key(F.col("query")).alias("_key")).agg(F.min("query_id").alias("query_id")).select("query_id")
    results, scores = reviewed(rows.join(firsts, "query_id", "left_semi"), s, None)
    results = written(results, "results")
    repeats = rows.join(firsts, "query_id", "left_anti")
    if repeats.take(1):
        repeats = written(repeats, "repeats")
        cached = spark.createDataFrame([], "query_id long, answer string, confidence double")
        warnings = spark.createDataFrame([], "query_id long, warning string")
        for name in [v[0] for v in ABLATIONS if v[3]]:
            own, again = rows.where(F.col("variant") == name).select("query_id"), repeats.where(F.col("variant") == name)
            kept = Memory.empty(spark).with_results(results.join(own, "query_id", "left_semi"), scores.join(own, "query_id", "left_semi"))
            cached, warnings = cached.unionByName(kept.answered(again, s.engine, s.config)), warnings.unionByName(kept.warnings(again, s.engine, s.config))
        results = results.unionByName(answered_or_reviewed(repeats, s, written(cached, "cached"), written(warnings, "warnings"))[0])
    named = results.join(rows.select("query_id", "own_id", "variant"), "query_id")
    return named.select(F.col("own_id").alias("query_id"), *COLUMNS[1:], "variant")
