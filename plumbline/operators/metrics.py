"""Metrics over batches of results.

Names are classified once per distinct name; all rates are conditional sums
over citations, rounded to four digits, 0 where there is nothing to count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, OFF_CORPUS_CASES, TIERS, EngineConfig
from ..functions import fuzzy
from ..functions import text as fx

Ratio = Callable[[Column, Column], Column]


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def classify_names(names: DataFrame, catalog: DataFrame, config: EngineConfig = DEFAULTS, measure: Ratio | None = None) -> DataFrame:
    """(key, kind) of distinct names (name): KNOWN, OFF_CORPUS or FABRICATED.

    Equal names are settled by a join; the others meet entries by rare pairs of letters and are compared by
    ``edit_ratio`` where that is given as ``measure`` (an expression that SQL has too), else by the exact ratio.
    """
    keys = names.select(fx.name_key(F.coalesce("name", F.lit(""))).alias("key")).distinct()
    known = catalog.select(fx.name_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    open_keys = keys.where("key <> ''").join(known, "key", "left_anti")
    sim: Ratio = measure or fuzzy.ratio_udf
    loss = (fuzzy.edit_loss if measure else fuzzy.ratio_loss)(config.fuzzy_known)
    pairs = fuzzy.near_pairs(open_keys.select(F.col("key").alias("name")), known.select(F.col("key").alias("entry")), loss)
    near = pairs.where(sim(F.col("name"), F.col("entry")) >= config.fuzzy_known).select(F.col("name").alias("key")).distinct()
    fake = open_keys.join(near, "key", "left_anti")
    off = F.lit(False)
    for case in OFF_CORPUS_CASES:
        off = off | (sim(F.col("key"), F.lit(case)) >= config.fuzzy_identity)
    fakes = fake.select("key", F.when(off, "OFF_CORPUS").otherwise("FABRICATED").alias("kind"))
    return keys.join(fakes, "key", "left").select("key", F.when(F.col("key") == "", "FABRICATED").otherwise(F.coalesce("kind", F.lit("KNOWN"))).alias("kind"))


def with_kinds(citations: DataFrame, kinds: DataFrame) -> DataFrame:
    """``citations`` (name, ...) with kind."""
    return citations.withColumn("key", fx.name_key(F.coalesce("name", F.lit("")))).join(kinds, "key").drop("key")


def hallucination(citations: DataFrame, *keys: str, reports: DataFrame | None = None, capped: bool = False) -> DataFrame:
    """Rates of citations (keys, kind, tier).  ``reports`` (keys, tier) adds scored citations.

    ``capped``: as a whole, reports add one misattribution at most, and only where citations have none, and
    one unsupported claim at most.
    """
    kind, tier = F.col("kind"), F.col("tier")
    own = citations.groupBy(*keys).agg(
        F.count("*").alias("n_total"), count_if(kind != "KNOWN").alias("n_fake"), count_if(kind == "FABRICATED").alias("n_fabricated"),
        count_if(kind == "OFF_CORPUS").alias("n_off_corpus"), count_if((tier == "MISATTRIBUTED") & (kind != "EMPTY")).alias("n_misattributed"),
    )
    if reports is None:
        own = own.withColumn("n_unsupported", F.lit(0).cast("bigint"))
    else:
        more = reports.groupBy(*keys).agg(count_if(tier == "MISATTRIBUTED").alias("_m"), count_if(tier == "UNVERIFIABLE").alias("_u"))
        own = own.join(more, list(keys), "left") if keys else own.crossJoin(F.broadcast(more))
        m, u = F.coalesce("_m", F.lit(0)), F.coalesce("_u", F.lit(0))
        if capped:
            m = F.when(F.col("n_misattributed") == 0, F.least(m, F.lit(1))).otherwise(F.lit(0))
            u = F.least(u, F.lit(1))
        own = own.withColumns({"n_misattributed": (F.col("n_misattributed") + m).cast("bigint"), "n_unsupported": u.cast("bigint")}).drop("_m", "_u")
    n = F.col("n_total")
    named = {"hr": "n_fake", "cfr": "n_fabricated", "oor": "n_off_corpus", "mar": "n_misattributed", "ucr": "n_unsupported"}
    out = own.withColumns({k: rate(F.col(c), n) for k, c in named.items()})
    return out.withColumn("lhr", rate(F.col("n_fabricated") + F.col("n_misattributed") + F.col("n_unsupported"), n))


def answers(results: DataFrame, citations: DataFrame, config: EngineConfig = DEFAULTS, measure: Ratio = fuzzy.ratio_udf) -> DataFrame:
    """One row: similarity of answers, authority precision and recall, and attribution accuracy.

    results (case_id, target_case, similarity), similarity null where an answer is missing;
    citations (case_id, name, tier).
    """
    sims = results.agg(
        F.coalesce(F.round(F.avg("similarity"), 4), F.lit(0.0)).alias("ass"), count_if(F.col("similarity") > config.answer_similar).alias("n_correct"),
        F.count("similarity").alias("n_total"), F.count("*").alias("n_cases"),
    )
    target = fx.name_key(F.coalesce("target_case", F.lit("")))
    pairs = citations.join(results.select("case_id", target.alias("_target")), "case_id")
    hit = (F.col("_target") != "") & (measure(fx.name_key(F.coalesce("name", F.lit(""))), F.col("_target")) >= config.fuzzy_identity)
    cited = pairs.agg(F.count("*").alias("n_citations"), count_if(hit).alias("n_matched"), count_if(F.col("tier") == "SUPPORTED").alias("n_supported"))
    n = F.col("n_citations")
    return sims.crossJoin(F.broadcast(cited)).select(
        "ass", rate(F.col("n_correct"), F.col("n_total")).alias("cas"), rate(F.col("n_matched"), n).alias("ap"),
        rate(F.col("n_matched"), F.col("n_cases")).alias("ar"), rate(F.col("n_supported"), n).alias("haa"), "n_correct", "n_total",
    )


def convergence(results: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """One row over results (conceded, judge_names, prosecutor_names, judge_confidence, avg_ccs)."""
    low = lambda c: F.transform(c, F.lower)
    agree = (F.size("judge_names") > 0) & (F.size(F.array_except(low(F.col("judge_names")), low(F.col("prosecutor_names")))) == 0)
    sure = (F.col("judge_confidence") >= config.consensus_confidence) & (F.col("avg_ccs") >= config.consensus_ccs)
    gave_in = F.coalesce("conceded", F.lit(False))
    met = F.coalesce(agree, F.lit(False)) | F.coalesce(sure, F.lit(False))
    sums = results.agg(F.count("*").alias("n_total"), count_if(gave_in).alias("n_conceded"), count_if(~gave_in & met).alias("n_consensus"))
    done = F.coalesce(F.col("n_conceded") + F.col("n_consensus"), F.lit(0))
    return sums.select(rate(done, F.col("n_total")).alias("dcr"), done.alias("n_converged"), F.coalesce("n_conceded", F.lit(0)).alias("n_conceded"), F.coalesce("n_consensus", F.lit(0)).alias("n_consensus"), "n_total")


def deliberation(proposed: DataFrame, report: DataFrame, kept: DataFrame, challenges: Column | int = 0) -> DataFrame:
    """One row: flawed citations of proposed (case_id, name), those the judge's kept (case_id, name) leaves out, and their share.

    The first entry of a name in report (case_id, name, tier, ord) decides.  Without flaws the share is 1.
    """
    first = report.groupBy("case_id", "name").agg(F.min_by("tier", F.struct(~F.col("tier").isin("MISATTRIBUTED", "FABRICATED", "UNVERIFIABLE"), F.col("ord"))).alias("tier"))
    flawed = proposed.join(first, ["case_id", "name"]).where(F.col("tier").isin("MISATTRIBUTED", "FABRICATED", "UNVERIFIABLE"))
    fixed = flawed.join(kept.select("case_id", "name", F.lit(True).alias("kept")).distinct(), ["case_id", "name"], "left")
    sums = fixed.agg(F.count("*").alias("flawed"), F.coalesce(count_if(F.col("kept").isNull()), F.lit(0)).alias("corrected"))
    return sums.select("flawed", "corrected", F.when(F.col("flawed") > 0, F.round(F.col("corrected") / F.col("flawed"), 4)).otherwise(F.lit(1.0)).alias("correction_rate"), F.lit(challenges).cast("bigint").alias("challenges"))


def recurrence(votes: DataFrame, catalog: DataFrame, config: EngineConfig = DEFAULTS, measure: Ratio | None = None, failed: DataFrame | None = None) -> DataFrame:
    """One row over votes (pair_id, query_no 1 or 2, name): fakes of the first query that come back in the second.

    Pairs of ``failed`` (pair_id) are left out and counted as errors.
    """
    if failed is not None:
        some = failed.select("pair_id").distinct()
        rest = recurrence(votes.join(some, "pair_id", "left_anti"), catalog, config, measure)
        return rest.crossJoin(F.broadcast(some.agg(F.count("*").alias("errors"))))
    kinds = classify_names(votes, catalog, config, measure)
    named = votes.where("query_no IN (1, 2)").select("pair_id", "query_no", fx.name_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    fakes = named.where("query_no = 1").join(kinds.where("kind <> 'KNOWN'"), "key").select("pair_id", "key")
    later = named.where("query_no = 2").select("pair_id", F.col("key").alias("later"))
    sim = measure or fuzzy.ratio_udf
    same = fakes.join(later, "pair_id").where((F.col("key") == F.col("later")) | (sim(F.col("key"), F.col("later")) >= config.fuzzy_known)).select("pair_id", "key", F.lit(True).alias("again")).distinct()
    marked = fakes.join(same, ["pair_id", "key"], "left")
    per_pair = marked.groupBy("pair_id").agg(F.count("*").alias("fakes"), F.count("again").alias("again"))
    sums = per_pair.agg(F.coalesce(F.sum("fakes"), F.lit(0)).alias("initial"), F.coalesce(F.sum("again"), F.lit(0)).alias("recurred"), F.count("*").alias("hallucinating_pairs"), F.coalesce(count_if(F.col("again") > 0), F.lit(0)).alias("recurred_pairs"))
    return sums.select(rate(F.col("recurred"), F.col("initial")).alias("rhr"), rate(F.col("recurred_pairs"), F.col("hallucinating_pairs")).alias("pair_rhr"), "recurred", "initial", "hallucinating_pairs", "recurred_pairs")


def scorecards(cases: DataFrame, citations: DataFrame, kinds: DataFrame, report: DataFrame, config: EngineConfig = DEFAULTS, measure: Ratio = fuzzy.ratio_udf) -> DataFrame:
    """A row per case of cases (case_id, target_case, similarity, conceded, judge_confidence, n_rejected).

    citations (case_id, name) of all sides count once per name; report (case_id, tier) has the scored ones.
    """
    named = citations.select("case_id", fx.stripped(F.col("name")).alias("name")).where("name <> ''").distinct()
    known = with_kinds(named, kinds).join(cases.select("case_id", fx.name_key(F.coalesce("target_case", F.lit(""))).alias("_target")), "case_id")
    gold = (F.col("_target") != "") & (measure(F.col("_target"), fx.name_key(F.col("name"))) >= config.fuzzy_identity)
    per_case = known.groupBy("case_id").agg(F.count("*").alias("total_cites"), count_if(F.col("kind") != "KNOWN").alias("fake_cites"), count_if(F.col("kind") == "FABRICATED").alias("_fab"), count_if(F.col("kind") == "OFF_CORPUS").alias("_off"), F.max(gold).alias("_gold"))
    scored = report.groupBy("case_id").agg(F.count("*").alias("_report"), count_if(F.col("tier") == "MISATTRIBUTED").alias("_mis"), count_if(F.col("tier") == "SUPPORTED").alias("_sup"))
    zero = F.lit(0).cast("bigint")
    rows = cases.join(per_case, "case_id", "left").join(scored, "case_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("total_cites", "fake_cites", "_fab", "_off", "_report", "_mis", "_sup")})
    n = F.col("total_cites")
    base = F.when(F.col("_report") > 0, F.col("_report")).otherwise(n)
    found = F.when(F.coalesce("_gold", F.lit(False)), 1.0).otherwise(0.0)
    lost = F.coalesce("n_rejected", F.lit(0))
    status = F.coalesce("conceded", F.lit(False)) | (F.coalesce("judge_confidence", F.lit(0.0)) >= config.converged_confidence)
    return rows.select(
        "case_id", rate(F.col("fake_cites"), n).alias("hr"), rate(F.col("_fab"), n).alias("cfr"), rate(F.col("_off"), n).alias("oor"),
        rate(F.col("_mis"), base).alias("mar"), rate(F.col("_sup"), base).alias("haa"), F.coalesce(F.round("similarity", 4), F.lit(0.0)).alias("ass"),
        found.alias("ar"), F.when(n > 0, F.round(found / n, 4)).otherwise(F.lit(0.0)).alias("ap"), rate(lost, n + lost).alias("ucr"),
        F.when(status, "CONVERGED").otherwise("CONTESTED").alias("status"), "total_cites", "fake_cites",
    )


def distinct_names(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, names): the distinct names of rows (key, order, names), in the order they come."""
    lists = F.array_sort(F.collect_list(F.struct(order, "names")))
    return rows.groupBy(key).agg(lists.alias("_l")).select(key, F.array_distinct(F.flatten(F.transform("_l", lambda x: x["names"]))).alias("names"))


MEANS = ("hr", "cfr", "oor", "mar", "ucr", "ass", "cas", "ap", "ar", "haa", "eor", "confidence")


def macro_means(cards: DataFrame) -> DataFrame:
    """One row: the means of all twelve rates over cards that did not fail."""
    ok = F.col("status") != "ERROR"
    means = [F.coalesce(F.round(F.avg(F.when(ok, F.col(c))), 4), F.lit(0.0)).alias(f"mean_{c}") for c in MEANS]
    return cards.agg(F.count("*").alias("total"), count_if(ok).alias("completed"), count_if(~ok).alias("crashed"), *means)


def evaluation(*rows: DataFrame) -> DataFrame:
    """One row of all measures: frames of one row side by side."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(F.broadcast(r.select(*[c for c in r.columns if c not in out.columns])))
    return out


def macro_micro(cards: DataFrame) -> DataFrame:
    """One row: the mean rate of all cases, of the cases that cite anything, and over all citations."""
    some = F.col("total_cites") > 0
    return cards.agg(
        F.count("*").alias("n_cases"), count_if(some).alias("n_citing"), F.round(F.avg("hr"), 4).alias("macro_hr"), F.round(F.avg(F.when(some, F.col("hr"))), 4).alias("macro_citing_hr"),
        rate(F.sum("fake_cites"), F.sum("total_cites")).alias("micro_hr"), F.round(F.avg("ass"), 4).alias("ass"), F.round(F.avg("ap"), 4).alias("ap"), F.round(F.avg("ar"), 4).alias("ar"), F.round(F.avg("haa"), 4).alias("haa"),
    )


def ablation_summary(runs: DataFrame) -> DataFrame:
    """A row per variant of runs (variant, status, hr, cas, confidence); crashed runs count but have no rates."""
    ok = F.col("status") != "ERROR"
    means = [F.round(F.avg(F.when(ok, F.col(c))), 4).alias(f"mean_{n}") for c, n in (("hr", "hr"), ("cas", "cas"), ("confidence", "conf"))]
    return runs.groupBy("variant").agg(F.count("*").alias("total"), count_if(ok).alias("completed"), count_if(~ok).alias("crashed"), *means)


def stress_summary(rows: DataFrame) -> DataFrame:
    """A row per class of rows (type, tier) and one of all ("all"): accepted, rejected and verdicts."""
    accepted = F.col("tier") == "SUPPORTED"
    tiers = [count_if(F.col("tier") == t).alias(t.lower()) for t in TIERS]
    sums = rows.rollup("type").agg(F.grouping("type").alias("_all"), F.count("*").alias("total"), count_if(accepted).alias("accepted"), count_if(~accepted).alias("rejected"), *tiers)
    return sums.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("type")).alias("type"), "total", "accepted", "rejected", *[t.lower() for t in TIERS])


def stress_rates(rows: DataFrame) -> DataFrame:
    """One row: power and the false acceptance, catch and false fabrication rates."""

    def share(kind: str, tier: str) -> Column:
        mine = F.col("type") == kind
        return rate(F.coalesce(count_if(mine & (F.col("tier") == tier)), F.lit(0)), F.coalesce(count_if(mine), F.lit(0)))

    return rows.agg(
        share("correct", "SUPPORTED").alias("power"), share("misattributed", "SUPPORTED").alias("far_misattributed"), share("casehold_distractor", "SUPPORTED").alias("far_distractor"),
        share("fabricated_with_cite", "FABRICATED").alias("fabrication_catch_rate"), share("real_off_corpus", "FABRICATED").alias("false_fabrication_rate"), F.count("*").alias("n"),
    )
