"""Queries of chunking, indexing and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LANDMARK_VOLUMES
from ..functions import text as fx
from ..operators import catalog, chunking, dense, fusion, lexical, verify
from .registry import query
from .shared import BM25_SQL, DENSE_SQL, TOKENS, blocked_index, documents, lexical_top, questions, table, vector_cells, vector_queries, vectors

WORDS = TOKENS.replace("lower(coalesce({0}, ''))", "coalesce({0}, '')")
CHUNKS_SQL = f"""
    w AS (SELECT doc_id, lang, {WORDS.format('text')} AS w FROM documents),
    k AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 450 THEN 1 ELSE 1 + ceil((len(w) - 450) / 375)::BIGINT END AS k FROM w),
    c AS (SELECT doc_id, lang, i, i * 375 AS s, least(i * 375 + 450, len(w)) AS e, array_to_string(list_slice(w, i * 375 + 1, i * 375 + 450), ' ') AS text
          FROM (SELECT *, unnest(range(k)) AS i FROM k))"""


@query("chunk_documents", f"""WITH {CHUNKS_SQL}
    SELECT doc_id, i AS chunk_index, s AS word_start, e AS word_end,
           doc_id || '::chunk::' || i || '::' || substring(sha256(doc_id || ':' || i || ':' || text), 1, 16) AS chunk_id FROM c""")  # fmt: skip
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(documents(spark, sf_dir))
    return chunks.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_index", "word_start", "word_end")], "chunk_id")


@query("chunk_stats", f"""WITH {CHUNKS_SQL}, n AS (SELECT doc_id, lang, count(*) AS k, sum(e - s) AS words FROM c GROUP BY ALL)
    SELECT d.lang, count(*) AS n_docs, coalesce(sum(k), 0)::BIGINT AS n_chunks, round(sum(words) / sum(k), 4) AS avg_chunk_words
    FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.lang""")  # fmt: skip
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    size = F.size(fx.words(F.col("text")))
    starts = chunking.window_starts(size, 450, 375)
    lengths = F.aggregate(starts, F.lit(0), lambda a, s: a + F.least(s + 450, size) - s)
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(starts)).alias("n_chunks"), F.round(F.sum(lengths) / F.sum(F.size(starts)), 4).alias("avg_chunk_words"))


@query("term_freq", f"WITH {BM25_SQL} SELECT doc_id, term, tf FROM post")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_frequencies(documents(spark, sf_dir))


@query("doc_freq_idf", f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.LexicalIndex.build(documents(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("corpus_stats", f"WITH {BM25_SQL} SELECT (SELECT n FROM stats) AS n_docs, (SELECT round(avgdl, 6) FROM stats) AS avgdl, count(*) AS n_terms FROM terms")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.LexicalIndex.build(documents(spark, sf_dir))
    return index.stats.crossJoin(index.terms.agg(F.count("*").alias("n_terms"))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms")


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id AS item_id, rank, doc_id, score FROM lex WHERE rank <= 4 AND score > 0")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top(spark, sf_dir).withColumnRenamed("query_id", "item_id")


@query("bm25_blocked_topk", f"WITH {BM25_SQL} SELECT query_id AS item_id, rank, doc_id, score FROM lex WHERE rank <= 4 AND score > 0")
def bm25_blocked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from the stored index in blocks, of which the queries read what can still win."""
    return blocked_index(spark, sf_dir).top(questions(spark, sf_dir)).withColumnRenamed("query_id", "item_id")


@query("bm25_payload", f"""WITH {BM25_SQL} SELECT query_id AS item_id, rank, doc_id, score, lang, source, replace(substring(text, 1, 200), chr(10), ' ') AS evidence
    FROM lex JOIN documents USING (doc_id) WHERE rank <= 4 AND score > 0""")  # fmt: skip
def bm25_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    hits = lexical_top(spark, sf_dir)
    return hits.join(docs, "doc_id").select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score", "lang", "source", fx.snippet(F.col("text")).alias("evidence"))


@query("dense_topk", f"WITH {DENSE_SQL} SELECT query_id, rank, vec_id, distance FROM den WHERE rank <= 4")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.nearest(vector_queries(spark, sf_dir), vectors(spark, sf_dir))


@query("dense_cells_topk", f"WITH {DENSE_SQL} SELECT query_id, rank, vec_id, distance FROM den WHERE rank <= 4")
def dense_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from stored cells, of which those that cannot hold a neighbour are not read."""
    return vector_cells(spark, sf_dir).nearest(vector_queries(spark, sf_dir))


@query("dense_by_label", """
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, v.vec_id, round(1e0 - list_cosine_similarity(q.e, v.e), 6) + 0e0 AS distance
          FROM v q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 3""")  # fmt: skip
def dense_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality first, distance second: nearest vectors of the same label, without a join on labels."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return dense.nearest(asked, rows, 3, exclude_self=True, within="label")


@query("dense_threshold_cache", f"""WITH {DENSE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM dist WHERE query_id <> vec_id)
    SELECT query_id, distance < 0.08 AS hit, vec_id AS nearest_id FROM o WHERE r = 1""")  # fmt: skip
def dense_threshold_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.cache_hits(vector_queries(spark, sf_dir), vectors(spark, sf_dir))


#: Benchmark items ask with the vector of their number, and a vector stands for the document of its number.
ITEM_DENSE_SQL = """
    v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    dd AS (SELECT item_id AS query_id, v.vec_id AS doc_id, round(1e0 - list_cosine_similarity(q.e, v.e), 6) + 0e0 AS distance
           FROM benchmark JOIN v q ON item_id = q.vec_id, v),
    den AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank, doc_id FROM dd)"""
FUSED_SQL = f"""{BM25_SQL}, {ITEM_DENSE_SQL},
    both_lists AS (SELECT query_id, rank, doc_id, 0 AS list_no FROM den WHERE rank <= 4
                   UNION ALL SELECT query_id, rank, doc_id, 1 FROM lex WHERE rank <= 4 AND score > 0),
    summed AS (SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 6) AS rrf_score, min(list_no * 1000 + rank) AS first FROM both_lists GROUP BY ALL),
    fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first, doc_id) AS rank, doc_id, rrf_score FROM summed)"""


def item_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).join(vectors(spark, sf_dir), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    return dense.nearest(asked, vectors(spark, sf_dir)).select("query_id", "rank", F.col("vec_id").alias("doc_id"))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(item_dense(spark, sf_dir), lexical_top(spark, sf_dir))


@query("rrf_fusion", f"WITH {FUSED_SQL} SELECT query_id, rank, doc_id, rrf_score FROM fused WHERE rank <= 8")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir)


@query("hybrid_topk", f"""WITH {FUSED_SQL} SELECT query_id, rank, f.doc_id, rrf_score, replace(substring(coalesce(text, ''), 1, 80), chr(10), ' ') AS preview
    FROM fused f LEFT JOIN documents d ON f.doc_id = d.doc_id WHERE rank <= 8""".replace("coalesce(text, '')", "text"))  # fmt: skip
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", fx.snippet(F.col("text"), 80).alias("preview"))
    return fused(spark, sf_dir).join(docs, "doc_id", "left").select("query_id", "rank", "doc_id", "rrf_score", "preview")


@query("entity_map", f"""WITH {FUSED_SQL},
    keyed AS (SELECT query_id, rank, f.doc_id, lower(source) AS key, false AS cite FROM fused f JOIN documents USING (doc_id) WHERE rank <= 8
              UNION ALL SELECT query_id, rank, f.doc_id, lower(lang), true FROM fused f JOIN documents USING (doc_id) WHERE rank <= 8)
    SELECT query_id, key, coalesce(arg_max(doc_id, rank) FILTER (cite), arg_min(doc_id, rank) FILTER (NOT cite)) AS doc_id FROM keyed WHERE key <> '' GROUP BY query_id, key""")  # fmt: skip
def entity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.array("source").alias("names"), F.array("lang").alias("cites"))
    return fusion.entity_map(fused(spark, sf_dir).join(docs, "doc_id"))


@query("known_catalog", """
    SELECT DISTINCT kind, trim(name) AS name FROM (
        SELECT 'name' AS kind, c_name AS name FROM customer UNION ALL SELECT 'name', s_name FROM supplier UNION ALL SELECT 'name', p_name FROM part
        UNION ALL SELECT 'cite', p_size || ' ' || p_brand || ' ' || p_partkey FROM part WHERE p_partkey > 0) WHERE trim(name) <> ''""")  # fmt: skip
def known_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<struct<cite:string>>")
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("case_name"), F.col("p_size").cast("string").alias("volume"), F.col("p_brand").alias("reporter"), F.col("p_partkey").alias("first_page"), none.alias("citations"))
    others = [table(spark, sf_dir, t).select(F.col(c).alias("case_name"), F.lit("").alias("volume"), F.lit("").alias("reporter"), F.lit(0).cast("bigint").alias("first_page"), none.alias("citations")) for t, c in (("customer", "c_name"), ("supplier", "s_name"))]
    return catalog.known_catalog(parts.unionByName(others[0]).unionByName(others[1]))


@query("exact_existence", r"""
    WITH n AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN '  ' || upper(s_name) || ' ' WHEN 1 THEN s_name ELSE s_name || 'x' END AS name FROM supplier),
    k AS (SELECT DISTINCT lower(s_name) AS key FROM supplier)
    SELECT name, key IS NOT NULL AS matched, CASE WHEN key IS NULL THEN 'NOT_FOUND' ELSE 'EXACT' END AS match_type
    FROM n LEFT JOIN k ON lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) = key""")  # fmt: skip
def exact_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "supplier")
    third = F.col("s_suppkey") % 3
    name = F.when(third == 0, F.concat(F.lit("  "), F.upper("s_name"), F.lit(" "))).when(third == 1, F.col("s_name")).otherwise(F.concat("s_name", F.lit("x")))
    return verify.exact_existence(held.select(name.alias("name")), held.select(F.col("s_name").alias("name")))


_VOLUMES = ", ".join(f"'{v}'" for v in LANDMARK_VOLUMES)


@query("volume_covered", rf"""
    WITH t AS (SELECT page_id AS id, regexp_extract(url, '/(\d+)', 1) || ' U. S. 113 (1973)' AS t FROM pages),
    v AS (SELECT id, regexp_extract(t, '(\d+)\s+U\.?\s*S\.?', 1, 'i') AS volume FROM t) SELECT id, volume, volume IN ({_VOLUMES}) AS covered FROM v""")  # fmt: skip
def volume_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.regexp_extract("url", r"/(\d+)", 1), F.lit(" U. S. 113 (1973)"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), verify.cited_volume(text).alias("volume"), verify.covered(text).alias("covered"))


@query("volume_subset", f"SELECT page_id, url FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) IN ({_VOLUMES})")
def volume_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("volume", F.regexp_extract("url", "/([0-9]+)", 1))
    return catalog.of_volumes(rows, catalog.parse_volumes("landmark")).select("page_id", "url")


@query("support_windows", """
    WITH n AS (SELECT doc_id, least(length(text), 1800) AS n FROM documents),
    w AS (SELECT doc_id, n, unnest(range(0, n, 350)) AS start FROM n WHERE n > 0)
    SELECT doc_id, start // 350 AS window_no, start, least(450, n - start) AS len FROM w""")  # fmt: skip
def support_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows a support model reads: by definition those that start in the first 1800 characters."""
    found = chunking.character_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.col("start").cast("bigint").alias("start"), F.length("window").cast("bigint").alias("len"))


@query("support_max_stub", f"""WITH {BM25_SQL},
    p AS (SELECT query_id, l.doc_id, list_distinct({TOKENS.format('b.text')}) AS q, d.text, length(d.text) AS n
          FROM lex l JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 4 AND score > 0),
    w AS (SELECT *, unnest(range(0, n, 350)) AS start FROM p WHERE n > 0),
    s AS (SELECT query_id, doc_id, len(list_intersect(q, {TOKENS.format('substring(text, start + 1, least(450, n - start))')})) / len(q) AS share FROM w)
    SELECT query_id AS item_id, doc_id, round(max(share), 6) AS support FROM s GROUP BY ALL""")  # fmt: skip
def support_max_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each top hit, of all its text, by the stand-in for an entailment model."""
    hits = lexical_top(spark, sf_dir).join(documents(spark, sf_dir), "doc_id").join(questions(spark, sf_dir), "query_id")
    windows = chunking.character_windows(hits.select("query_id", "doc_id", "query", "text"), reach=None)
    best = windows.groupBy("query_id", "doc_id").agg(F.round(F.max(verify.overlap_support(F.col("query"), F.col("window"))), 6).alias("support"))
    return best.select(F.col("query_id").alias("item_id"), "doc_id", "support")


def _letters(text: Column) -> Column:
    """A stand-in for an embedding that SQL has too: how often a text holds each vowel, and one."""
    return F.array(F.lit(1.0), *[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in "aeiou"])


@query("support_tiers", f"""
    WITH p AS (SELECT item_id, coalesce(b.text, '') AS claim, coalesce(d.text, '') AS t FROM benchmark b JOIN documents d ON d.doc_id % 200 = b.item_id),
    n AS (SELECT *, list_distinct({TOKENS.format('claim')}) AS q, least(length(t), 1800) AS n FROM p),
    w AS (SELECT *, unnest(range(0, n, 350)) AS start FROM n WHERE n > 0 AND item_id % 3 = 0),
    s AS (SELECT item_id, max(CASE WHEN len(q) > 0 THEN len(list_intersect(q, {TOKENS.format('substring(t, start + 1, least(450, n - start))')})) / len(q) ELSE 0e0 END) AS support FROM w GROUP BY item_id),
    l AS (SELECT item_id, [1e0] || [(length(claim) - length(replace(claim, c, '')))::DOUBLE FOR c IN ['a', 'e', 'i', 'o', 'u']] AS a, [1e0] || [(length(substring(t, 1, 500)) - length(replace(substring(t, 1, 500), c, '')))::DOUBLE FOR c IN ['a', 'e', 'i', 'o', 'u']] AS b
          FROM p WHERE item_id % 3 = 1 AND regexp_matches(t, '[^\\s]'))
    SELECT item_id, 'scorer' AS tier, round(support, 6) AS support FROM s
    UNION ALL SELECT item_id, 'cosine', round(max(greatest(0e0, least(1e0, list_cosine_similarity(a, b)))), 6) FROM l GROUP BY item_id
    UNION ALL SELECT DISTINCT item_id, 'none', 0e0 FROM p WHERE item_id % 3 = 2 AND regexp_matches(t, '[^\\s]')""")  # fmt: skip
def support_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims scored by a model, by vectors where there is none, and by nothing; every document is evidence for one claim."""
    claims = questions(spark, sf_dir).select(F.col("query_id").alias("citation_id"), F.col("query").alias("holding"))
    texts = documents(spark, sf_dir).select((F.col("doc_id") % 200).alias("citation_id"), "text")
    tiers = [("scorer", verify.overlap_support, None), ("cosine", None, _letters), ("none", None, None)]
    parts = [verify.tiered_support(claims.where(F.col("citation_id") % 3 == i), texts, scorer, embed).select(F.col("citation_id").alias("item_id"), F.lit(tier).alias("tier"), F.round("support", 6).alias("support")) for i, (tier, scorer, embed) in enumerate(tiers)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
