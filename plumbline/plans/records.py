"""Queries of raw records, stored tables, texts for prompts and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import models
from ..functions import text as fx
from ..operators import agents, catalog, memory, metrics, verify
from ..schema import RAW_CASE
from ..sources import cases
from ..sources.portions import PortionedIndex
from ..sources.vector_store import VectorStore
from ..storage import shared_path
from .registry import query
from .shared import BM25_SQL, documents, questions, table

#: Documents as raw case records: fields are missing, empty or no numbers in turn.
RAW_SQL = r"""
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    raw AS (SELECT doc_id, doc_id::VARCHAR AS id, CASE doc_id % 3 WHEN 0 THEN '' ELSE 'Doc v. ' || doc_id END AS abbr, 'Long Doc against ' || doc_id AS name,
                   CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE (1900 + doc_id % 100) || '-03-04' END AS date, CASE doc_id % 4 WHEN 0 THEN 'xii' ELSE (doc_id % 500)::VARCHAR END AS page,
                   CASE doc_id % 2 WHEN 0 THEN (300 + doc_id % 7)::VARCHAR END AS vol, CASE doc_id % 6 WHEN 0 THEN NULL ELSE (doc_id % 600) || ' U.S. ' || (doc_id % 500) END AS cite,
                   CASE doc_id % 7 WHEN 0 THEN NULL ELSE substring(t, 1, 60) END AS head, CASE doc_id % 7 WHEN 1 THEN '' ELSE substring(t, 61, 200) END AS opinion, t FROM d),
    joined AS (SELECT *, regexp_replace(CASE WHEN coalesce(head, '') = '' AND coalesce(opinion, '') = '' THEN t
                   ELSE concat_ws(chr(10) || chr(10), nullif(head, ''), nullif(opinion, '')) END, '^\s+|\s+$', '', 'g') AS body FROM raw)"""


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("doc_id"), F.col("text")
    number = i.cast("string")
    cite = F.when(i % 6 != 0, F.concat((i % 600).cast("string"), F.lit(" U.S. "), (i % 500).cast("string")))
    head, opinion = F.when(i % 7 != 0, F.substring(t, 1, 60)), F.when(i % 7 == 1, "").otherwise(F.substring(t, 61, 200))
    found = {
        "id": number, "name_abbreviation": F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Doc v. "), number)), "name": F.concat(F.lit("Long Doc against "), number), "court": F.struct(F.lit("High Court").alias("name")),
        "decision_date": F.when(i % 5 == 1, "unknown").when(i % 5 > 1, F.concat((1900 + i % 100).cast("string"), F.lit("-03-04"))), "first_page": F.when(i % 4 == 0, "xii").otherwise((i % 500).cast("string")),
        "volume": F.when(i % 2 == 0, (300 + i % 7).cast("string")), "volume_number": F.lit(None), "reporter": F.lit("U.S."), "docket_number": F.lit(None),
        "citations": F.when(cite.isNotNull(), F.array(F.struct(cite.alias("cite")))), "casebody": F.struct(head.alias("head_matter"), F.array(F.struct(opinion.alias("text"))).alias("opinions"), t.alias("text")),
    }
    return documents(spark, sf_dir).select(*[found[f.name].cast(f.dataType).alias(f.name) for f in RAW_CASE])


@query("parse_cases", f"""WITH {RAW_SQL}
    SELECT 'CAP::' || id || '::' || substring(sha256(id || body), 1, 24) AS doc_id, length(body) AS n_chars, coalesce(nullif(abbr, ''), name) AS case_name, coalesce(try_cast(substring(date, 1, 4) AS INTEGER), 0) AS year,
           coalesce(try_cast(page AS INTEGER), 0) AS first_page, coalesce(vol, '999') AS volume, coalesce(cite, nullif(abbr, ''), name) AS authority_identity FROM joined WHERE length(body) >= 100""")  # fmt: skip
def parse_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies, names, years, pages and keys of raw records; short bodies are left out."""
    docs = cases.parse_cases(raw_cases(spark, sf_dir), "999")
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "case_name", "year", "first_page", "volume", "authority_identity")


@query("case_catalog", f"""WITH {RAW_SQL}, p AS (SELECT coalesce(nullif(abbr, ''), name) AS n, coalesce(try_cast(page AS INTEGER), 0) AS pg, coalesce(vol, '') AS v, cite FROM joined WHERE length(body) >= 100)
    SELECT DISTINCT 'name' AS kind, n AS name FROM p UNION SELECT 'cite', v || ' U.S. ' || pg FROM p WHERE pg > 0 AND v <> '' UNION SELECT 'cite', cite FROM p WHERE cite IS NOT NULL""")  # fmt: skip
def case_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of parsed cases, with cites."""
    return catalog.known_catalog(cases.parse_cases(raw_cases(spark, sf_dir)))


#: Documents that name their volume in one way or another; where none of the rules' fields does, the text's start is what it is.
@query("case_volumes", r"""
    WITH d AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '{"volume_number": "' || (doc_id % 90) || '"}' WHEN 1 THEN ' ' || (doc_id % 600) WHEN 2 THEN 'vol. x' END AS v, CASE doc_id % 9 WHEN 2 THEN (doc_id % 77)::VARCHAR WHEN 3 THEN 'volume_number : 5' END AS m,
                      CASE doc_id % 9 WHEN 4 THEN [lang, (doc_id % 500) || ' u.s. 1', '9 U.S. 9'] ELSE [source] END AS c, CASE doc_id % 9 WHEN 5 THEN 'CAP_' || (doc_id % 70) WHEN 6 THEN 'Vol' || (doc_id % 71) ELSE source || '::' || doc_id END AS k,
                      CASE doc_id % 9 WHEN 7 THEN 'as in ' || (doc_id % 300) || ' U. S. 7' ELSE coalesce(source, '') END AS name, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(v, 'volume_number.*[0-9]') THEN regexp_extract(v, '([0-9]+)', 1) WHEN regexp_full_match(trim(v), '[0-9]+') THEN trim(v)
                        WHEN regexp_matches(m, 'volume_number.*[0-9]') THEN regexp_extract(m, '([0-9]+)', 1) WHEN regexp_full_match(trim(m), '[0-9]+') THEN trim(m)
                        WHEN len(c) > 1 THEN split_part(c[2], ' ', 1) WHEN k LIKE 'CAP_%' OR k LIKE 'Vol%' THEN regexp_extract(k, '([0-9]+)', 1)
                        ELSE regexp_extract(name || ' ' || substring(t, 1, 200), '(?i)([0-9]+)\s+U\.?\s*S\.?', 1) END AS volume,
           CASE doc_id % 9 WHEN 0 THEN 'volume_record' WHEN 1 THEN 'volume' WHEN 2 THEN 'metadata' WHEN 3 THEN 'metadata_record' WHEN 4 THEN 'cites' WHEN 5 THEN 'doc_id' WHEN 6 THEN 'doc_id'
                ELSE CASE WHEN regexp_matches(name || ' ' || substring(t, 1, 200), '(?i)[0-9]+\s+U\.?\s*S') THEN 'text' ELSE '' END END AS place FROM d""")  # fmt: skip
def case_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's volume from wherever it is named, and where that was."""
    i, kind = F.col("doc_id"), F.col("doc_id") % 9
    word = lambda n: (i % n).cast("string")
    volume = F.when(kind == 0, F.concat(F.lit('{"volume_number": "'), word(90), F.lit('"}'))).when(kind == 1, F.concat(F.lit(" "), word(600))).when(kind == 2, "vol. x")
    metadata = F.when(kind == 2, word(77)).when(kind == 3, "volume_number : 5")
    cites = F.when(kind == 4, F.array(F.col("lang"), F.concat(word(500), F.lit(" u.s. 1")), F.lit("9 U.S. 9"))).otherwise(F.array("source"))
    key = F.when(kind == 5, F.concat(F.lit("CAP_"), word(70))).when(kind == 6, F.concat(F.lit("Vol"), word(71))).otherwise(F.concat("source", F.lit("::"), i.cast("string")))
    name = F.when(kind == 7, F.concat(F.lit("as in "), word(300), F.lit(" U. S. 7"))).otherwise(F.coalesce("source", F.lit("")))
    found = catalog.volume_place(volume, metadata, cites, key, name, F.col("text"))
    return documents(spark, sf_dir).select("doc_id", found.alias("v")).select("doc_id", F.col("v.value").alias("volume"), "v.place")


@query("volume_range", "SELECT doc_id FROM documents WHERE doc_id % 600 BETWEEN 300 AND 310")
def volume_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("volume", (F.col("doc_id") % 600).cast("string"))
    return catalog.of_volumes(docs, catalog.parse_volumes(" 300-310 ")).select("doc_id")


@query("missing_volumes", "SELECT DISTINCT (doc_id % 50)::VARCHAR AS volume FROM documents WHERE (doc_id % 50) NOT IN (SELECT page_id % 40 FROM pages)")
def missing_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = documents(spark, sf_dir).select((F.col("doc_id") % 50).cast("string").alias("volume")).distinct()
    return catalog.missing_volumes(requested, table(spark, sf_dir, "pages").select((F.col("page_id") % 40).cast("string").alias("volume")))


#: Pages as records that name their file in one of nine ways; some fields behind the one that counts are filled too.
@query("case_files", """
    WITH p AS (SELECT page_id, page_id % 10 AS k, url FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN 'casebody_url' WHEN 1 THEN 'case_url' WHEN 2 THEN 'download_url' WHEN 3 THEN 'url' WHEN 4 THEN 'body_url' WHEN 5 THEN 'case_file_name' WHEN 6 THEN 'file_name' WHEN 7 THEN 'filename' ELSE 'first_page' END AS place,
           CASE WHEN k IN (0, 1, 2) THEN url || '?' || k WHEN k = 3 THEN url || '.json' WHEN k = 4 THEN 'b:' || url WHEN k = 5 AND url LIKE 'http%' THEN url
                WHEN k = 5 THEN 'https://cases.example/us/7/cases/' || ltrim(url, '/') || '.json' WHEN k = 6 THEN 'https://cases.example/us/7/cases/f' || page_id || '.json' WHEN k = 7 THEN 'https://cases.example/us/7/cases/g.json'
                ELSE 'https://cases.example/us/7/cases/' || CASE WHEN page_id % 12345 < 1000 THEN lpad((page_id % 12345)::VARCHAR, 4, '0') ELSE (page_id % 12345)::VARCHAR END || '-01.json' END AS file
    FROM p WHERE url IS NOT NULL""")  # fmt: skip
def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a record's own file is: addresses, the body's, file names, or the padded page, and which of them told it."""
    i, k, url = F.col("page_id"), F.col("page_id") % 10, F.col("url")
    record = {
        "casebody_url": F.when(k == 0, F.concat(url, F.lit("?0"))), "case_url": F.when(k == 1, F.concat(url, F.lit("?1"))), "download_url": F.when(k == 2, F.concat(url, F.lit("?2"))).when(k > 2, ""),
        "url": F.when(k <= 3, F.concat(url, F.lit(".json"))).otherwise(F.concat(url, F.lit(".JSON"))), "body_url": F.when(k <= 4, F.concat(F.lit("b:"), url)), "case_file_name": F.when(k == 5, url),
        "file_name": F.when(k.isin(5, 6), F.concat(F.lit("/f"), i.cast("string"))), "filename": F.when(k == 7, "//g.json"), "first_page": (i % 12345).cast("string"), "id": i,
    }
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return pages.select("page_id", cases.case_url(record, F.lit("7"), "https://cases.example").alias("f")).select("page_id", "f.place", F.col("f.value").alias("file"))


@query("complete_cases", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'full ' || doc_id ELSE 'listed' END AS name, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang FROM documents")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed records completed by the full ones where there are any."""
    docs = documents(spark, sf_dir)
    listed = docs.select(F.col("doc_id").alias("id"), F.lit("listed").alias("name"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))
    full = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("full "), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("lang"))
    return cases.complete_cases(listed, full)


@query("store_metadata", """
    SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang, '["' || lang || '","' || source || '"]' AS tags FROM documents""")  # fmt: skip
def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.array("lang", "source").alias("tags"))
    return cases.store_metadata(rows)


@query("vector_upsert", "SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))
    merged = cases.merge_vectors(old, old.where("vec_id % 3 = 0").withColumn("first", F.col("first") * 2), "vec_id")
    return merged.select("vec_id", F.round("first", 6).alias("first"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


@query("vector_store_upsert", "SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first, len(embedding) AS width FROM embeddings")
def vector_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert through the store: all vectors, then a batch of changed ones, of which one bucket in so many is rewritten."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    store = VectorStore.create(spark, shared_path(spark, "vectors"), _ddl(rows), "vec_id", buckets=16)
    store.upsert(rows, "all")
    store.upsert(rows.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast(rows.schema["embedding"].dataType.elementType))), "changed")
    return store.read().select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.size("embedding").cast("bigint").alias("width"))


def _portioned(spark: SparkSession, sf_dir: str) -> PortionedIndex:
    """The documents, landed as three volumes and followed as a stream; the last comes late, and the first is offered again."""
    folder = shared_path(spark, "portions")
    index, docs = PortionedIndex(spark, f"{folder}/index"), documents(spark, sf_dir).select("doc_id", "text")
    schema = _ddl(docs)
    volumes = [docs.where(F.pmod("doc_id", F.lit(3)) == i) for i in range(3)]
    for i, volume in enumerate(volumes):
        volume.write.parquet(f"{folder}/volumes/{i}")
        if i:
            index.follow(f"{folder}/volumes", schema, f"{folder}/checkpoint")
    index.follow(f"{folder}/volumes", schema, f"{folder}/checkpoint")
    return index


@query("portioned_stats", f"WITH {BM25_SQL} SELECT (SELECT n FROM stats) AS n_docs, (SELECT round(avgdl, 6) FROM stats) AS avgdl, count(*) AS n_terms FROM terms")
def portioned_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _portioned(spark, sf_dir).index()
    return index.stats.crossJoin(index.terms.agg(F.count("*").alias("n_terms"))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms")


@query("portioned_topk", f"WITH {BM25_SQL} SELECT query_id AS item_id, rank, doc_id, score FROM lex WHERE rank <= 4 AND score > 0")
def portioned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents from an index that grew volume by volume."""
    return _portioned(spark, sf_dir).index().top(questions(spark, sf_dir)).withColumnRenamed("query_id", "item_id")


@query("resume_portion", "SELECT doc_id FROM documents WHERE doc_id % 4 = 1 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_portion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stopped build has left to do of a portion."""
    return cases.not_yet(documents(spark, sf_dir).where("doc_id % 4 = 1").select("doc_id"), table(spark, sf_dir, "labels"))


@query("question_files", "SELECT item_id AS id, item_id % 4 AS label, CASE item_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS answer FROM benchmark")
def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with endings; a label beyond them has no answer."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 4).alias("label"), F.array(F.lit("a"), F.lit("b")).alias("endings"))
    return cases.multiple_choice(rows, 1_000_000_000).select("id", "label", "answer")


#: Conversations as evidence: a turn is a passage, its text a document of a name and a year.
@query("passage_lines", r"""
    WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE WHEN turn % 3 = 0 THEN '' ELSE role || ' v. ' || turn END AS name, CASE WHEN turn % 2 = 0 THEN 1900 + turn ELSE 0 END AS year,
                      replace(substring(coalesce(text, ''), 1, 500), chr(10), ' ') AS body FROM conversations),
    l AS (SELECT conv_id, n, '[' || n || '] ' || concat_ws(': ', nullif(concat_ws(' ', nullif(name, ''), CASE WHEN year > 0 THEN '(' || year || ')' END), ''), body) AS line FROM p)
    SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS passages FROM l GROUP BY conv_id""")  # fmt: skip
def passage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as a prompt has it: by definition the first 500 characters of each text."""
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", turn.alias("rank"), F.when(turn % 3 == 0, "").otherwise(F.concat("role", F.lit(" v. "), turn.cast("string"))).alias("case_name"), F.when(turn % 2 == 0, 1900 + turn).otherwise(0).alias("year"), F.coalesce("text", F.lit("")).alias("text"))
    return agents.passages_of(rows, "conv_id")


@query("report_lines", """
    SELECT user_id, string_agg(printf('%s: CCS=%.2f [%s]', 'Case ' || (event_id % 7), event_id % 101 / 100e0, upper(event_type)), chr(10) ORDER BY event_id) AS report FROM events GROUP BY user_id""")  # fmt: skip
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", i.alias("ordinal"), F.concat(F.lit("Case "), (i % 7).cast("string")).alias("case_name"), (i % 101 / F.lit(100.0)).alias("ccs"), F.upper("event_type").alias("tier"))
    return agents.report_of(rows, "user_id")


@query("augmented_queries", """
    SELECT item_id, trim(concat_ws(' ', CASE WHEN item_id % 2 = 1 THEN concat_ws(' ', text, 'limits ' || item_id, 'holding') ELSE text END, CASE WHEN item_id % 3 = 0 THEN 'Ohio' END)) AS query FROM benchmark""")  # fmt: skip
def augmented_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second round's query has the first two queries of the reflection; the jurisdiction comes last."""
    i = F.col("item_id")
    more = F.array(F.concat(F.lit("limits "), i.cast("string")), F.lit("holding"), F.lit("left out"))
    asked = fx.augmented(F.col("text"), more, i % 2)
    return table(spark, sf_dir, "benchmark").select("item_id", fx.with_jurisdiction(asked, F.when(i % 3 == 0, "Ohio").otherwise("")).alias("query"))


@query("speaker_prompts", """
    SELECT item_id, 'DEFENSE' || chr(10) || coalesce(text, '') AS prompt, 'DEFENSE' || chr(10) || 'Answer with one JSON object only.' || chr(10) || coalesce(text, '') AS fallback FROM benchmark""")  # fmt: skip
def speaker_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", agents.prompt_of("DEFENSE", given).alias("prompt"), agents.prompt_of("DEFENSE", given, "Answer with one JSON object only.").alias("fallback"))


@query("next_round_queries", """
    WITH t AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS n, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN n > 0 THEN concat_ws(' ', 'turn ' || turn, concat_ws(' ', 'limits of ' || before, before || ' holding')) ELSE 'turn ' || turn END AS query FROM t""")  # fmt: skip
def next_round_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one round found missing is added to the next round's query."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    missing = F.array(F.concat(F.lit("limits of "), "role"), F.concat("role", F.lit(" holding")), F.lit("left out"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(order) - 1).alias("round"), F.lag(missing).over(order).alias("more"))
    asked = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    return rows.select("conv_id", "turn", fx.augmented(asked, F.coalesce("more", F.array().cast("array<string>")), F.col("round")).alias("query"))


@query("listed_values", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR coalesce(source, '') = '' THEN 0 ELSE 1 END AS n FROM documents")
def listed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar as a list of one, nothing as an empty list."""
    value = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(fx.as_list(value)).alias("n"))


@query("first_opinions", """
    WITH e AS (SELECT doc_id, lower(trim(source)) AS k, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY doc_id) AS n FROM documents)
    SELECT item_id AS citation_id, doc_id FROM benchmark JOIN e ON k = 'src' || (item_id % 40) WHERE n <= 3""")  # fmt: skip
def first_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three texts under a cited name."""
    cited = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("citation_id"), F.concat(F.lit(" SRC"), (F.col("item_id") % 40).cast("string")).alias("case_name"))
    held = documents(spark, sf_dir).select(F.col("source").alias("case_name"), "doc_id", F.col("doc_id").cast("string").alias("text"))
    return verify.opinions(cited, held).select("citation_id", F.col("text").cast("bigint").alias("doc_id"))


@query("entailment_softmax", """
    WITH l AS (SELECT vec_id, embedding[1]::DOUBLE * 5 AS a, embedding[2]::DOUBLE * 5 AS b, embedding[3]::DOUBLE * 5 AS c FROM embeddings)
    SELECT vec_id, round(exp(c - greatest(a, b, c)) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 6) AS p FROM l""")  # fmt: skip
def entailment_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third of three logits as a share."""
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(models.softmax(logits, 2), 6).alias("p"))


@query("cosine_support", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) + 0e0 AS support FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")  # fmt: skip
def cosine_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support by vectors, where there is no entailment model: each vector with the next."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(other, "vec_id").select("vec_id", (F.round(models.cosine(F.col("a"), F.col("b")), 6) + 0.0).alias("support"))


@query("citation_ordinals", """
    SELECT o_custkey AS query_id, l_orderkey * 10 + l_linenumber AS line, 'part ' || l_partkey || '#' || (row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) AS report_key
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")  # fmt: skip
def citation_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a report: the name and its place among the question's citations."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("query_id")), "l_orderkey")
    keyed = verify.report_keys(rows.withColumn("name", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))), "query_id", "name", "l_orderkey", "l_linenumber", "l_partkey")
    return keyed.select("query_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "report_key")


@query("names_first_seen", """
    WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')[:5]) AS name, generate_subscripts(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')[:5], 1) AS i FROM conversations),
    f AS (SELECT conv_id, name, min(turn * 10 + i) AS pos FROM w GROUP BY ALL)
    SELECT conv_id, string_agg(name, ' ' ORDER BY pos) AS names FROM f GROUP BY conv_id""")  # fmt: skip
def names_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of all turns, in the order they come (the first five words of a turn are its names)."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(fx.tokens(F.coalesce("text", F.lit(""))), 1, 5).alias("names"))
    return metrics.distinct_names(rows, "conv_id", "turn").where(F.size("names") > 0).select("conv_id", F.array_join("names", " ").alias("names"))


@query("cleared_memory", "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus <> 'F'")
def cleared_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("namespace"))
    return memory.without_namespace(rows, "F").select("key")
