"""Queries of the review loop, of memory and of generated JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import salvage
from ..functions import text as fx
from ..operators import debate, dense, memory, ranks
from ..storage import shared_path
from ..streaming import running
from .loop import review
from .registry import query
from .shared import BM25_SQL, DENSE_SQL, documents, lexical_top, questions, table, vector_queries, vectors
from .verification import CITED_SQL, SCORED_SQL, cited_names, held_names, scored_events

#: A user's day is a report: its events are the scored citations, errors the gaps.
DAYS_SQL = f"""{SCORED_SQL},
    days AS (SELECT user_id, ts::DATE AS day, count(*) AS n, round(avg(ccs), 4) AS avg_ccs, round(min(ccs), 4) AS min_ccs, count(*) FILTER (event_type = 'error') AS gaps,
                    max(coalesce(support, 0e0)) AS challenge, count(*) FILTER (event_type = 'signup') >= 2 AS concede,
                    count(*) FILTER (tier = 'SUPPORTED') AS n_verified, avg(ccs) FILTER (tier = 'SUPPORTED') AS verified_mean, count(*) FILTER (tier = 'UNCERTAIN') AS n_uncertain
             FROM scored GROUP BY ALL)"""


def report_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, tier = F.col("event_type"), F.col("tier")
    return scored_events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.round(F.avg("ccs"), 4).alias("avg_ccs"), F.round(F.min("ccs"), 4).alias("min_ccs"), F.count_if(kind == "error").alias("gaps"), F.max(F.coalesce("support", F.lit(0.0))).alias("challenge"),
        (F.count_if(kind == "signup") >= 2).alias("concede"), F.count_if(tier == "SUPPORTED").alias("n_verified"), F.avg(F.when(tier == "SUPPORTED", F.col("ccs"))).alias("verified_mean"), F.count_if(tier == "UNCERTAIN").alias("n_uncertain"),
    )


def settled(column: str, name: str | None = None):
    """Six digits; the nudge keeps sums that end in a five from depending on the order of addition."""
    return F.round(F.col(column) + 1e-9, 6).alias(name or column)


@query("ddc_decision", f"""WITH {DAYS_SQL}, r AS (SELECT user_id, day, (day(day) % 2)::INTEGER AS round,
        CASE WHEN concede THEN 1 WHEN day(day) % 2 >= 1 THEN 2 WHEN (avg_ccs < 0.60 OR min_ccs < 0.40) AND gaps >= 1 THEN 3 WHEN challenge > 0.5 AND gaps >= 1 THEN 4 ELSE 5 END AS rule_no FROM days)
    SELECT user_id, day, round, rule_no, CASE WHEN rule_no IN (3, 4) THEN 'CONTINUE' ELSE 'TERMINATE' END AS decision FROM r""")  # fmt: skip
def ddc_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = report_days(spark, sf_dir).withColumn("round", F.day("day") % 2)
    rule = debate.decision_rule(F.col("round"), F.col("avg_ccs"), F.col("min_ccs"), F.col("gaps"), F.col("challenge"), F.col("concede"))
    return days.withColumn("rule_no", rule).select("user_id", "day", "round", "rule_no", debate.decision(F.col("rule_no")).alias("decision"))


@query("judge_confidence", f"""WITH {DAYS_SQL}, r AS (SELECT *, CASE WHEN n % 3 = 0 THEN 0e0 ELSE least(greatest(challenge, 0e0), 1e0) END AS raw FROM days)
    SELECT user_id, day, round(CASE WHEN n_verified > 0 AND raw > 0 THEN 0.7e0 * verified_mean + 0.3e0 * raw WHEN n_verified > 0 THEN verified_mean
        WHEN n_uncertain > 0 AND raw > 0 THEN least(raw, 0.35e0) WHEN n_uncertain > 0 THEN 0.2e0 ELSE least(raw, 0.2e0) END, 2) AS confidence FROM r""")  # fmt: skip
def judge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = report_days(spark, sf_dir).join(counts, ["user_id", "day"])
    raw = F.when(F.col("n") % 3 == 0, 0.0).otherwise(F.col("challenge"))
    return days.select("user_id", "day", debate.judge_confidence(F.col("n_verified"), F.col("verified_mean"), F.col("n_uncertain"), raw).alias("confidence"))


_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '\b[a-zA-Z]{{3,}}\b'))"


@query("judge_reconcile", f"""
    WITH {CITED_SQL}, v AS (SELECT name, row_number() OVER (ORDER BY name) AS ord, round(0.5e0 + length(name) / 50e0, 4) AS score, {_WORDS.format('name')} AS ew FROM held),
    c AS (SELECT name, {_WORDS.format('name')} AS w FROM cited),
    x AS (SELECT c.name AS case_name, score, 'exact' AS via FROM c JOIN v USING (name)),
    n AS (SELECT c.name AS case_name, score, ord FROM c, v WHERE c.name NOT IN (SELECT case_name FROM x) AND len(w) > 0
          AND (list_has_all(ew, w) OR list_has_all(w, ew) OR len(list_intersect(w, ew)) >= 2))
    SELECT * FROM x UNION ALL SELECT case_name, arg_min(score, ord), 'words' FROM n GROUP BY case_name""")  # fmt: skip
def judge_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_names(spark, sf_dir)
    score = F.round(F.lit(0.5) + F.length("name") / 50.0, 4)
    report = ranks.global_ranks(held, "name", name="ord").select(F.lit(0).alias("query_id"), F.col("name").alias("case_name"), F.lit("SUPPORTED").alias("tier"), score.alias("ccs"), "ord")
    cited = cited_names(spark, sf_dir).select(F.lit(0).alias("query_id"), F.col("name").alias("case_name"))
    return debate.reconcile(cited, debate.verified_scores(report)).select("case_name", "score", "via")


#: The counter side of an item has the top hits of the two items after it.
COUNTER_SQL = f"""{BM25_SQL},
    top AS (SELECT l.query_id, l.rank, l.doc_id, lower(regexp_replace(substring(coalesce(text, ''), 1, 80), '^\\s+|\\s+$', '', 'g')) AS start FROM lex l JOIN documents d USING (doc_id) WHERE rank <= 4 AND score > 0),
    hits AS (SELECT query_id - o AS query_id, o AS query_ord, rank, doc_id, start FROM top, (VALUES (1), (2)) AS t(o) WHERE query_id - o IN (SELECT item_id FROM benchmark)),
    free AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = h.query_id AND t.doc_id = h.doc_id)
             AND NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = h.query_id AND t.start = h.start AND t.start <> '')),
    firsts AS (SELECT query_id, doc_id, min(query_ord * 1000 + rank) AS place FROM free GROUP BY ALL)"""


@query("counter_evidence_anti", f"WITH {COUNTER_SQL} SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place, doc_id) AS rank, doc_id FROM firsts) WHERE rank <= 4")
def counter_evidence_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lexical_top(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    asked = questions(spark, sf_dir).select("query_id")
    shifted = own.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("query_ord"), "*")
    hits = shifted.select((F.col("query_id") - F.col("query_ord")).alias("query_id"), "query_ord", "rank", "doc_id", "text").join(asked, "query_id", "left_semi")
    return debate.counter_evidence(hits, own)


#: Assistant words of more than three letters are the citations; users hold the own text, systems the counter text.
OVERLAP_SQL = r"""
    sides AS (SELECT conv_id, lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '')) AS own,
                     lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'system'), '')) AS counter FROM conversations GROUP BY conv_id),
    cites AS (SELECT DISTINCT conv_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS name FROM conversations WHERE role = 'assistant')"""


@query("evidence_overlap", f"""WITH {OVERLAP_SQL}
    SELECT conv_id, coalesce(round(avg(CASE WHEN name IS NULL THEN NULL WHEN length(name) > 3 AND contains(own, name) AND NOT contains(counter, name) THEN 1e0 ELSE 0e0 END), 4), 0e0) AS eor
    FROM sides LEFT JOIN cites USING (conv_id) GROUP BY conv_id""")  # fmt: skip
def evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")

    def side(role: str):
        spoken = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
        return F.lower(F.array_join(F.transform(spoken, lambda t: t["text"]), " "))

    sides = turns.groupBy("conv_id").agg(side("user").alias("own"), side("system").alias("counter"))
    cites = turns.where("role = 'assistant'").select("conv_id", F.explode(fx.tokens(F.col("text"))).alias("name")).distinct()
    return debate.evidence_overlap(cites, sides, "conv_id")


@query("debate_history", """
    SELECT conv_id, string_agg('[' || upper(role) || '] ' || substring(text, 1, 400), chr(10) || chr(10) ORDER BY turn) AS history, count(*) AS n_turns FROM conversations GROUP BY conv_id""")
def debate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a generator's prompt has them: by definition the first 400 characters of each."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("ord"), "role", F.col("text").alias("argument"))).alias("t"), F.count("*").alias("n_turns"))
    return turns.select("conv_id", fx.history_lines(F.col("t")).alias("history"), "n_turns")


@query("counter_queries", """
    SELECT item_id, unnest([text || ' exception distinguished does not apply', 'Case ' || item_id || ' overruled distinguished limited', substring(text, 1, 80) || ' limitation exception']) AS query FROM benchmark WHERE length(text) > 10""")  # fmt: skip
def counter_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).where(F.length("query") > 10)
    cites = F.array(F.struct(F.concat(F.lit("Case "), F.col("query_id").cast("string")).alias("case_name"), F.col("query").alias("holding")))
    return rows.select(F.col("query_id").alias("item_id"), F.explode(fx.counter_queries(F.col("query"), cites)).alias("query"))


@query("risk_running_mean", """
    SELECT user_id, event_id, round(avg(value) OVER w + 1e-9, 6) AS run_avg, count(*) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def risk_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.running_means(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id").select("user_id", "event_id", settled("run_avg"), "n")


@query("risk_running_stream", """
    SELECT user_id, event_id, round(avg(value) OVER w + 1e-9, 6) AS run_avg, count(*) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def risk_running_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same means from a stream of three files, the later ones by what the earlier ones left."""
    folder = shared_path(spark, "running")
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id").alias("seq"), F.col("value").cast("double").alias("value"))
    first, last = events.agg(F.min("seq.ts"), F.max("seq.ts")).first()
    third = (last - first) / 3
    means = running.RunningMeans(spark, folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    for i in range(3):
        place = F.when(F.col("seq.ts") >= F.lit(first + 2 * third), 2).when(F.col("seq.ts") >= F.lit(first + third), 1).otherwise(0)
        events.where(place == i).coalesce(1).write.parquet(f"{folder}/landed/{i}")
        means.follow(f"{folder}/landed", f"{folder}/checkpoint", schema)
    return means.steps().select(F.col("key").cast("bigint").alias("user_id"), F.col("seq.event_id").alias("event_id"), settled("run_avg"), "n")


@query("risk_index_merge", "SELECT user_id, round(avg(value) + 1e-9, 6) AS avg, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_tier FROM events GROUP BY user_id")
def risk_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the month are indexed apart and merged; the result is that of one pass."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("ccs"), F.col("event_type").alias("tier"), F.struct("ts", "event_id").alias("seq"), F.day("ts").alias("day"))
    halves = [memory.risk_index(rows.where(c), "user_id") for c in (F.col("day") <= 15, F.col("day") > 15)]
    return memory.risk_table(memory.merge_risk(*halves, key="user_id"), "user_id").select("user_id", settled("avg_ccs", "avg"), "n", "last_tier")


@query("risk_tier_counts", f"""WITH {SCORED_SQL} SELECT substring(sha1('user ' || user_id), 1, 16) AS key, round(avg(ccs) + 1e-9, 6) AS avg_ccs, count(*) AS n, arg_max(tier, event_id) AS last_tier
    FROM scored WHERE tier IN ('FABRICATED', 'MISATTRIBUTED', 'UNVERIFIABLE') GROUP BY user_id""")  # fmt: skip
def risk_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" User "), F.col("user_id").cast("string"))
    rows = scored_events(spark, sf_dir).select(name.alias("case_name"), "ccs", "tier", F.col("event_id").alias("seq"))
    return memory.risk_table(memory.risk_index(memory.risk_rows(rows))).select("key", settled("avg_ccs"), "n", "last_tier")


@query("verdict_store", """
    WITH r AS (SELECT o_custkey % 500 AS q, o_orderkey AS seq, o_orderstatus AS answer, round(o_totalprice / 1e6, 6) AS confidence, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS n FROM orders)
    SELECT substring(sha1('query ' || q), 1, 16) AS key, arg_max(answer, seq) AS answer, arg_max(confidence, seq) AS confidence FROM r WHERE n > 0 AND confidence > 0 GROUP BY q""")  # fmt: skip
def verdict_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts worth keeping of two batches; the newest of a query stays."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.concat(F.lit("Query "), (F.col("o_custkey") % 500).cast("string")).alias("query"), F.col("o_orderstatus").alias("answer"), F.round(F.col("o_totalprice") / 1e6, 6).alias("confidence"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("n_verified"), F.col("o_orderkey").alias("seq"), F.year("o_orderdate").alias("year"))
    old, new = (memory.verdict_rows(rows.where(c)) for c in (F.col("year") <= 1995, F.col("year") > 1995))
    return memory.upsert(old, new).select("key", "answer", "confidence")


@query("high_risk_topk", f"""WITH {DENSE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM dist),
    risk AS (SELECT user_id AS vec_id, avg(value) / 490.02e0 AS a FROM events GROUP BY user_id)
    SELECT query_id, vec_id FROM o JOIN risk USING (vec_id) WHERE r <= 5 AND a < 0.45""")  # fmt: skip
def high_risk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vec_id")).agg((F.avg("value") / 490.02).alias("avg_ccs"))
    return memory.high_risk(dense.nearest(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 5), risks)


@query("json_strict_extract", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_strict_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("json_repair_comma", r"""
    WITH m AS (SELECT event_id, regexp_replace(replace(props, '}', ', "list": [1, 2, ], }'), ',\s*([}\]])', '\1', 'g') AS repaired FROM events)
    SELECT event_id, repaired, json_extract_string(repaired, '$.k')::BIGINT AS k FROM m""")  # fmt: skip
def json_repair_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace("props", F.lit("}"), F.lit(', "list": [1, 2, ], }'))
    rows = table(spark, sf_dir, "events").select("event_id", fx.repaired_commas(broken).alias("repaired"))
    return rows.withColumn("k", F.get_json_object("repaired", "$.k").cast("bigint"))


@query("json_salvage_full")
def json_salvage_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments cut off in different ways; the stages have no SQL form."""
    said = F.translate(F.col("text"), '"\\\n\r\t', "     ")
    whole = F.concat(F.lit('{"argument": "'), said, F.lit('", "confidence": 0.5, "citations": [{"case_name": "A v. B", "year": 1999,},]}'))
    cut = F.col("turn") % 4
    raw = F.when(cut == 0, whole).when(cut == 1, F.concat(F.lit("Here it is: "), whole, F.lit(" Done."))).when(cut == 2, F.substr(whole, F.lit(1), F.length(whole) - 12)).otherwise(F.col("text"))
    parsed = table(spark, sf_dir, "conversations").select("conv_id", "turn", salvage.salvage_udf(raw).alias("p"))
    return parsed.select("conv_id", "turn", "p.*")


@query("safe_year", r"""
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate)::VARCHAR WHEN 1 THEN 'decided ' || year(o_orderdate) WHEN 2 THEN NULL ELSE 'n/a' END AS input FROM orders)
    SELECT o_orderkey, input, coalesce(try_cast(input AS INTEGER), try_cast(nullif(regexp_extract(input, '\d{4}', 0), '') AS INTEGER), 0) AS output FROM t""")  # fmt: skip
def safe_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, way = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    text = F.when(way == 0, year).when(way == 1, F.concat(F.lit("decided "), year)).when(way == 3, F.lit("n/a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("input")).withColumn("output", fx.safe_year(F.col("input")))


@query("clean_name", """
    WITH t AS (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN '["' || c_name || '"]' WHEN 1 THEN ' [' || c_name || '] ' WHEN 2 THEN '"' || c_name || '"' ELSE c_name || '  ' END AS input FROM customer)
    SELECT c_custkey, input, c_name AS output FROM t""")  # fmt: skip
def clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, way = F.col("c_name"), F.col("c_custkey") % 4
    wrapped = F.when(way == 0, F.concat(F.lit('["'), name, F.lit('"]'))).when(way == 1, F.concat(F.lit(" ["), name, F.lit("] "))).when(way == 2, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.concat(name, F.lit("  ")))
    return table(spark, sf_dir, "customer").select("c_custkey", wrapped.alias("input")).withColumn("output", fx.clean_name(F.col("input")))


@query("debate_loop_batch")
def debate_loop_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole review of all benchmark texts with a stand-in for the generator."""
    found = review(questions(spark, sf_dir), documents(spark, sf_dir))
    return found.select("query_id", "rounds", "decision", "rule_no", "n_citations", "n_verified", "n_rejected", "answer", "confidence", "eor", "avg_ccs", "min_ccs")
