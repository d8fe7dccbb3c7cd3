"""Queries of metrics over result sets built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import OFF_CORPUS_CASES
from ..functions import fuzzy
from ..operators import metrics, stress
from .registry import query
from .shared import table
from .verification import SCORED_SQL, scored_events

#: Orders cite parts: a case is a customer; some names are changed, some are of no catalog, some are well-known cases.
_OFF = [c for c in OFF_CORPUS_CASES if "'" not in c]
_OFF_LIST = ", ".join(f"'{c}'" for c in _OFF)
_OFF_ALL = ", ".join("'" + c.replace("'", "''") + "'" for c in OFF_CORPUS_CASES)
CITES_SQL = f"""
    held AS (SELECT DISTINCT p_name AS name FROM part),
    li AS (SELECT o_custkey AS case_id, l_orderkey * 10 + l_linenumber AS ord, p_name, l_partkey, l_linenumber, l_quantity,
                  CASE l_orderkey % 5 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'MISATTRIBUTED' WHEN 3 THEN 'FABRICATED' ELSE 'UNVERIFIABLE' END AS tier
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    cites AS (SELECT case_id, ord, tier, CASE WHEN l_linenumber = 1 THEN p_name WHEN l_linenumber = 2 THEN ' ' || upper(p_name) WHEN l_linenumber = 3 THEN p_name || 's'
                     WHEN l_linenumber = 4 THEN 'zz ' || p_name WHEN l_linenumber = 5 THEN ([{_OFF_LIST}])[1 + l_partkey % {len(_OFF)}]
                     WHEN l_linenumber = 6 THEN '' ELSE p_name || ' of ' || (l_partkey % 50) END AS name FROM li)"""
RATIO_SQL = "round(100e0 * (1e0 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))), 0)"
KINDS_SQL = f"""
    keys AS (SELECT DISTINCT lower(trim(name)) AS key FROM cites),
    kinds AS (SELECT key, CASE WHEN key = '' THEN 'FABRICATED' WHEN key IN (SELECT name FROM held) OR EXISTS (SELECT 1 FROM held WHERE {RATIO_SQL.format('key', 'name')} >= 85) THEN 'KNOWN'
                     WHEN EXISTS (SELECT 1 FROM unnest([{_OFF_ALL}]) AS t(c) WHERE {RATIO_SQL.format('key', 'c')} >= 80) THEN 'OFF_CORPUS' ELSE 'FABRICATED' END AS kind FROM keys),
    named AS (SELECT case_id, ord, name, tier, kind FROM cites JOIN kinds ON lower(trim(name)) = key)"""


def held_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("case_id"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = lines.join(orders, "l_orderkey").join(parts, "l_partkey")
    line, name = F.col("l_linenumber"), F.col("p_name")
    off = F.get(F.array(*[F.lit(c) for c in _OFF]), (F.col("l_partkey") % len(_OFF)).cast("int"))
    said = (
        F.when(line == 1, name).when(line == 2, F.concat(F.lit(" "), F.upper(name))).when(line == 3, F.concat(name, F.lit("s"))).when(line == 4, F.concat(F.lit("zz "), name))
        .when(line == 5, off).when(line == 6, F.lit("")).otherwise(F.concat(name, F.lit(" of "), (F.col("l_partkey") % 50).cast("string")))
    )
    tiers = F.array(*[F.lit(t) for t in ("SUPPORTED", "UNCERTAIN", "MISATTRIBUTED", "FABRICATED", "UNVERIFIABLE")])
    return rows.select("case_id", (F.col("l_orderkey") * 10 + line).alias("ord"), said.alias("name"), F.get(tiers, (F.col("l_orderkey") % 5).cast("int")).alias("tier"))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classify_names(cites(spark, sf_dir), held_names(spark, sf_dir), measure=fuzzy.edit_ratio)


_RATES = ("hr", "cfr", "oor", "mar", "ucr", "lhr")
_HR_SQL = """
    count(*) AS n_total, count(*) FILTER (kind <> 'KNOWN') AS n_fake, count(*) FILTER (kind = 'FABRICATED') AS n_fabricated, count(*) FILTER (kind = 'OFF_CORPUS') AS n_off_corpus,
    count(*) FILTER (tier = 'MISATTRIBUTED') AS m"""


@query("name_kinds", f"WITH {CITES_SQL}, {KINDS_SQL} SELECT key, kind FROM kinds")
def name_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(spark, sf_dir)


@query("name_kinds_exact")
def name_kinds_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the exact ratio, which SQL lacks."""
    return metrics.classify_names(cites(spark, sf_dir), held_names(spark, sf_dir))


@query("hr_family", f"""WITH {CITES_SQL}, {KINDS_SQL}, {SCORED_SQL}, c AS (SELECT {_HR_SQL} FROM named), r AS (SELECT count(*) FILTER (tier = 'MISATTRIBUTED') AS rm, count(*) FILTER (tier = 'UNVERIFIABLE') AS ru FROM scored),
    t AS (SELECT n_total, n_fake, n_fabricated, n_off_corpus, m + rm AS n_misattributed, ru AS n_unsupported FROM c, r)
    SELECT *, round(n_fake / n_total, 4) AS hr, round(n_fabricated / n_total, 4) AS cfr, round(n_off_corpus / n_total, 4) AS oor, round(n_misattributed / n_total, 4) AS mar,
           round(n_unsupported / n_total, 4) AS ucr, round((n_fabricated + n_misattributed + n_unsupported) / n_total, 4) AS lhr FROM t""")  # fmt: skip
def hr_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = metrics.with_kinds(cites(spark, sf_dir), kinds(spark, sf_dir))
    return metrics.hallucination(named, reports=scored_events(spark, sf_dir).select("tier"))


@query("hr_family_capped", f"""WITH {CITES_SQL}, {KINDS_SQL}, {SCORED_SQL}, c AS (SELECT {_HR_SQL} FROM named), r AS (SELECT count(*) FILTER (tier = 'MISATTRIBUTED') AS rm, count(*) FILTER (tier = 'UNVERIFIABLE') AS ru FROM scored),
    t AS (SELECT n_total, n_fake, n_fabricated, n_off_corpus, CASE WHEN m = 0 THEN least(rm, 1) ELSE m END AS n_misattributed, least(ru, 1) AS n_unsupported FROM c, r)
    SELECT *, round(n_fake / n_total, 4) AS hr, round(n_fabricated / n_total, 4) AS cfr, round(n_off_corpus / n_total, 4) AS oor, round(n_misattributed / n_total, 4) AS mar,
           round(n_unsupported / n_total, 4) AS ucr, round((n_fabricated + n_misattributed + n_unsupported) / n_total, 4) AS lhr FROM t""")  # fmt: skip
def hr_family_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With reports counted at most once, as a whole."""
    named = metrics.with_kinds(cites(spark, sf_dir), kinds(spark, sf_dir))
    return metrics.hallucination(named, reports=scored_events(spark, sf_dir).select("tier"), capped=True)


#: A customer is a case: its target is a part name, its answer's similarity comes from its balance.
CASES_SQL = """
    cases AS (SELECT c_custkey AS case_id, p_name AS target_case, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE round(abs(c_acctbal) / 10000e0, 6) END AS similarity, c_custkey % 6 = 0 AS conceded,
                     round((c_custkey % 97) / 97e0, 6) AS judge_confidence, c_custkey % 3 AS n_rejected FROM customer JOIN part ON p_partkey = c_custkey)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), "p_name")
    return table(spark, sf_dir, "customer").join(parts, "c_custkey").select(
        key.alias("case_id"), F.col("p_name").alias("target_case"), F.when(key % 10 != 0, F.round(F.abs("c_acctbal") / 10000.0, 6)).alias("similarity"), (key % 6 == 0).alias("conceded"),
        F.round((key % 97) / 97.0, 6).alias("judge_confidence"), (key % 3).alias("n_rejected"),
    )


@query("cas_family", f"""WITH {CITES_SQL}, {CASES_SQL},
    s AS (SELECT coalesce(round(avg(similarity), 4), 0e0) AS ass, count(*) FILTER (similarity > 0.70) AS n_correct, count(similarity) AS n_total, count(*) AS n_cases FROM cases),
    c AS (SELECT count(*) AS n, count(*) FILTER ({RATIO_SQL.format('lower(trim(name))', 'lower(target_case)')} >= 80) AS m, count(*) FILTER (tier = 'SUPPORTED') AS u FROM cites JOIN cases USING (case_id))
    SELECT ass, round(n_correct / n_total, 4) AS cas, round(m / n, 4) AS ap, round(m / n_cases, 4) AS ar, round(u / n, 4) AS haa, n_correct, n_total FROM s, c""")  # fmt: skip
def cas_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.answers(cases(spark, sf_dir), cites(spark, sf_dir), measure=fuzzy.edit_ratio)


#: What the judge of a case keeps and what the other side proposed, by event type.
DEBATES_SQL = f"""{SCORED_SQL},
    deb AS (SELECT user_id, count(*) FILTER (event_type = 'signup') % 5 = 0 AS conceded, coalesce(list(DISTINCT 'Case ' || (event_id % 7)) FILTER (tier = 'SUPPORTED'), []) AS judge_names,
                   coalesce(list(DISTINCT 'case ' || (event_id % 7)) FILTER (event_type = 'click'), []) AS prosecutor_names, round(avg(existence), 4) AS judge_confidence, round(max(ccs), 4) AS avg_ccs FROM scored GROUP BY user_id)"""


def debates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir)
    number = (F.col("event_id") % 7).cast("string")
    return rows.groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "signup") % 5 == 0).alias("conceded"), F.collect_set(F.when(F.col("tier") == "SUPPORTED", F.concat(F.lit("Case "), number))).alias("judge_names"),
        F.collect_set(F.when(F.col("event_type") == "click", F.concat(F.lit("case "), number))).alias("prosecutor_names"), F.round(F.avg("existence"), 4).alias("judge_confidence"), F.round(F.max("ccs"), 4).alias("avg_ccs"),
    )


@query("dcr", f"""WITH {DEBATES_SQL},
    x AS (SELECT conceded, (len(judge_names) > 0 AND list_has_all(prosecutor_names, list_transform(judge_names, lambda n: lower(n)))) OR (judge_confidence >= 0.80 AND avg_ccs >= 0.75) AS met FROM deb),
    s AS (SELECT count(*) AS n_total, count(*) FILTER (conceded) AS n_conceded, count(*) FILTER (NOT conceded AND met) AS n_consensus FROM x)
    SELECT round((n_conceded + n_consensus) / n_total, 4) AS dcr, n_conceded + n_consensus AS n_converged, n_conceded, n_consensus, n_total FROM s""")  # fmt: skip
def dcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.convergence(debates(spark, sf_dir))


@query("deliberation", f"""WITH {SCORED_SQL},
    p AS (SELECT user_id AS case_id, 'Case ' || event_id AS name, tier, event_id FROM scored), kept AS (SELECT case_id, name FROM p WHERE tier = 'SUPPORTED' OR event_id % 3 = 0),
    f AS (SELECT p.case_id, p.name, k.name IS NULL AS fixed FROM p LEFT JOIN kept k USING (case_id, name) WHERE tier IN ('MISATTRIBUTED', 'FABRICATED', 'UNVERIFIABLE'))
    SELECT count(*) AS flawed, count(*) FILTER (fixed) AS corrected, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (fixed) / count(*), 4) ELSE 1e0 END AS correction_rate,
           (SELECT count(*) FILTER (event_type = 'error') FROM scored) AS challenges FROM f""")  # fmt: skip
def deliberation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir).select(F.col("user_id").alias("case_id"), F.concat(F.lit("Case "), F.col("event_id").cast("string")).alias("name"), "tier", F.col("event_id").alias("ord"), "event_type")
    kept = rows.where("tier = 'SUPPORTED' OR ord % 3 = 0")
    found = metrics.deliberation(rows.select("case_id", "name"), rows, kept)
    return found.drop("challenges").crossJoin(rows.agg(F.count_if(F.col("event_type") == "error").alias("challenges")))


@query("rhr", f"""WITH {CITES_SQL}, {KINDS_SQL},
    votes AS (SELECT DISTINCT case_id // 2 AS pair_id, 1 + case_id % 2 AS query_no, lower(trim(name)) AS key FROM cites WHERE trim(name) <> ''),
    f AS (SELECT pair_id, key FROM votes JOIN kinds USING (key) WHERE query_no = 1 AND kind <> 'KNOWN'),
    m AS (SELECT f.pair_id, f.key, EXISTS (SELECT 1 FROM votes v WHERE v.pair_id = f.pair_id AND v.query_no = 2 AND (v.key = f.key OR {RATIO_SQL.format('f.key', 'v.key')} >= 85)) AS again FROM f),
    p AS (SELECT pair_id, count(*) AS fakes, count(*) FILTER (again) AS again FROM m GROUP BY pair_id)
    SELECT round(sum(again) / sum(fakes), 4) AS rhr, round(count(*) FILTER (again > 0) / count(*), 4) AS pair_rhr, sum(again)::BIGINT AS recurred, sum(fakes)::BIGINT AS initial,
           count(*) AS hallucinating_pairs, count(*) FILTER (again > 0) AS recurred_pairs FROM p""")  # fmt: skip
def rhr(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = cites(spark, sf_dir).select(F.floor(F.col("case_id") / 2).alias("pair_id"), (F.col("case_id") % 2 + 1).alias("query_no"), "name")
    return metrics.recurrence(votes, held_names(spark, sf_dir), measure=fuzzy.edit_ratio)


CARDS_SQL = f"""{CITES_SQL}, {KINDS_SQL}, {CASES_SQL},
    uniq AS (SELECT DISTINCT case_id, trim(name) AS name, kind FROM named WHERE trim(name) <> ''),
    pc AS (SELECT case_id, count(*) AS n, count(*) FILTER (kind <> 'KNOWN') AS fake, count(*) FILTER (kind = 'FABRICATED') AS fab, count(*) FILTER (kind = 'OFF_CORPUS') AS off,
                  max(CASE WHEN {RATIO_SQL.format('lower(target_case)', 'lower(name)')} >= 80 THEN 1e0 ELSE 0e0 END) AS gold FROM uniq JOIN cases USING (case_id) GROUP BY case_id),
    rp AS (SELECT case_id, count(*) AS rn, count(*) FILTER (tier = 'MISATTRIBUTED') AS mis, count(*) FILTER (tier = 'SUPPORTED') AS sup FROM cites GROUP BY case_id),
    j AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(fake, 0) AS fake, coalesce(fab, 0) AS fab, coalesce(off, 0) AS off, coalesce(gold, 0e0) AS gold, coalesce(rn, 0) AS rn, coalesce(mis, 0) AS mis, coalesce(sup, 0) AS sup
          FROM cases c LEFT JOIN pc USING (case_id) LEFT JOIN rp USING (case_id)),
    b AS (SELECT *, CASE WHEN rn > 0 THEN rn ELSE n END AS base FROM j),
    cards AS (SELECT case_id, CASE WHEN n > 0 THEN round(fake / n, 4) ELSE 0e0 END AS hr, CASE WHEN n > 0 THEN round(fab / n, 4) ELSE 0e0 END AS cfr, CASE WHEN n > 0 THEN round(off / n, 4) ELSE 0e0 END AS oor,
                     CASE WHEN base > 0 THEN round(mis / base, 4) ELSE 0e0 END AS mar, CASE WHEN base > 0 THEN round(sup / base, 4) ELSE 0e0 END AS haa, coalesce(round(similarity, 4), 0e0) AS ass,
                     gold AS ar, CASE WHEN n > 0 THEN round(gold / n, 4) ELSE 0e0 END AS ap, CASE WHEN n + n_rejected > 0 THEN round(n_rejected / (n + n_rejected), 4) ELSE 0e0 END AS ucr,
                     CASE WHEN conceded OR judge_confidence >= 0.70 THEN 'CONVERGED' ELSE 'CONTESTED' END AS status, n AS total_cites, fake AS fake_cites FROM b)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = cites(spark, sf_dir)
    return metrics.scorecards(cases(spark, sf_dir), said, kinds(spark, sf_dir), said.select("case_id", "tier"), measure=fuzzy.edit_ratio)


@query("scorecard", f"WITH {CARDS_SQL} SELECT * FROM cards")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir)


@query("macro_vs_micro", f"""WITH {CARDS_SQL}
    SELECT count(*) AS n_cases, count(*) FILTER (total_cites > 0) AS n_citing, round(avg(hr), 4) AS macro_hr, round(avg(hr) FILTER (total_cites > 0), 4) AS macro_citing_hr,
           round(sum(fake_cites) / sum(total_cites), 4) AS micro_hr, round(avg(ass), 4) AS ass, round(avg(ap), 4) AS ap, round(avg(ar), 4) AS ar, round(avg(haa), 4) AS haa FROM cards""")  # fmt: skip
def macro_vs_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_micro(cards(spark, sf_dir))


@query("ablation_summary", """
    WITH r AS (SELECT o_orderpriority AS variant, CASE WHEN o_orderkey % 11 = 0 THEN 'ERROR' ELSE 'OK' END AS status, o_totalprice / 500000e0 AS hr, (o_orderkey % 89) / 89e0 AS cas, (o_custkey % 83) / 83e0 AS confidence FROM orders)
    SELECT variant, count(*) AS total, count(*) FILTER (status <> 'ERROR') AS completed, count(*) FILTER (status = 'ERROR') AS crashed, round(avg(hr) FILTER (status <> 'ERROR'), 4) AS mean_hr,
           round(avg(cas) FILTER (status <> 'ERROR'), 4) AS mean_cas, round(avg(confidence) FILTER (status <> 'ERROR'), 4) AS mean_conf FROM r GROUP BY variant""")  # fmt: skip
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), F.when(key % 11 == 0, "ERROR").otherwise("OK").alias("status"), (F.col("o_totalprice") / 500000.0).alias("hr"), ((key % 89) / 89.0).alias("cas"), ((F.col("o_custkey") % 83) / 83.0).alias("confidence"))
    return metrics.ablation_summary(runs)


_KINDS = ("correct", "misattributed", "casehold_distractor", "fabricated_with_cite", "fabricated_no_cite", "real_off_corpus")
_STRESS_SQL = f"{SCORED_SQL}, st AS (SELECT ([{', '.join(repr(k) for k in _KINDS)}])[1 + event_id % 6] AS type, tier FROM scored)"
_STRESS_SUMS = ", ".join(f"count(*) FILTER (tier = '{t}') AS {t.lower()}" for t in ("SUPPORTED", "UNCERTAIN", "MISATTRIBUTED", "FABRICATED", "UNVERIFIABLE"))


def stress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(spark, sf_dir).select(F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 6).cast("int")).alias("type"), "tier")


@query("stress_summary", f"WITH {_STRESS_SQL} SELECT coalesce(type, 'all') AS type, count(*) AS total, count(*) FILTER (tier = 'SUPPORTED') AS accepted, count(*) FILTER (tier <> 'SUPPORTED') AS rejected, {_STRESS_SUMS} FROM st GROUP BY ROLLUP (type)")
def stress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stress_summary(stress_rows(spark, sf_dir))


@query("stress_rates", f"""WITH {_STRESS_SQL}
    SELECT round(count(*) FILTER (type = 'correct' AND tier = 'SUPPORTED') / count(*) FILTER (type = 'correct'), 4) AS power, round(count(*) FILTER (type = 'misattributed' AND tier = 'SUPPORTED') / count(*) FILTER (type = 'misattributed'), 4) AS far_misattributed,
           round(count(*) FILTER (type = 'casehold_distractor' AND tier = 'SUPPORTED') / count(*) FILTER (type = 'casehold_distractor'), 4) AS far_distractor, round(count(*) FILTER (type = 'fabricated_with_cite' AND tier = 'FABRICATED') / count(*) FILTER (type = 'fabricated_with_cite'), 4) AS fabrication_catch_rate,
           round(count(*) FILTER (type = 'real_off_corpus' AND tier = 'FABRICATED') / count(*) FILTER (type = 'real_off_corpus'), 4) AS false_fabrication_rate, count(*) AS n FROM st""")  # fmt: skip
def stress_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stress_rates(stress_rows(spark, sf_dir))


@query("stress_set", """
    WITH c AS (SELECT s_suppkey AS id, s_name AS case_name, s_suppkey || ' U.S. ' || s_nationkey AS cite, 'holding ' || s_suppkey AS holding, CASE WHEN s_suppkey % 2 = 0 THEN 'ending ' || s_suppkey ELSE '' END AS distractor FROM supplier),
    r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM c),
    inv AS (SELECT n_nationkey::BIGINT AS id, 'Invented ' || n_name AS case_name, CASE WHEN n_nationkey % 2 = 0 THEN '999 U.S. ' || n_nationkey ELSE '' END AS cite, 'claim' AS holding FROM nation),
    off AS (SELECT r_regionkey::BIGINT AS id, 'Real ' || r_name AS case_name, '' AS cite, 'known' AS holding FROM region)
    SELECT 'correct' AS type, id AS item, case_name, cite AS reporter_cite, holding FROM c UNION ALL
    SELECT 'misattributed', a.id, a.case_name, a.cite, b.holding FROM r a JOIN r b ON b.rn = (a.rn + 5) % a.n UNION ALL
    SELECT 'casehold_distractor', id, case_name, cite, distractor FROM c WHERE distractor <> '' UNION ALL
    SELECT 'fabricated_with_cite', id, case_name, cite, holding FROM inv WHERE cite <> '' UNION ALL
    SELECT 'fabricated_no_cite', id, case_name, '', holding FROM inv UNION ALL SELECT 'real_off_corpus', id, case_name, cite, holding FROM off""")  # fmt: skip
def stress_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("case_name"), F.concat_ws(" ", key, F.lit("U.S."), F.col("s_nationkey").cast("string")).alias("reporter_cite"), F.concat(F.lit("holding "), key).alias("holding"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ending "), key)).otherwise("").alias("distractor"))
    nation = F.col("n_nationkey")
    invented = table(spark, sf_dir, "nation").select(nation.alias("id"), F.concat(F.lit("Invented "), F.col("n_name")).alias("case_name"), F.when(nation % 2 == 0, F.concat(F.lit("999 U.S. "), nation.cast("string"))).otherwise("").alias("reporter_cite"), F.lit("claim").alias("holding"))
    real = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("Real "), F.col("r_name")).alias("case_name"), F.lit("").alias("reporter_cite"), F.lit("known").alias("holding"))
    return stress.stress_set(held, invented, real)


@query("late_lines", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First seen by key: the last shipped line of each order."""
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").withColumn("r", F.row_number().over(order)).where("r = 1").select("l_orderkey", "l_linenumber")
