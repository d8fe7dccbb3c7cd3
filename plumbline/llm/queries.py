"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact, language_model, manifest, packing, periodic, quality, secrets, simhash, toxicity, urls, warc
from .common import table, written


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary is; PLUMBLINE_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("PLUMBLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = written(simhash.with_fingerprint(docs).select(F.col("_row")["doc_id"].alias("doc_id"), "fp"), "prints")
    return simhash.near_components(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _of_rule(i: int):
    return lambda h: h["rule"] == i


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.RULES
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), rules)
    counts = [F.size(F.filter("hits", _of_rule(i))).cast("bigint").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    bases = F.array(*[F.lit(r.base) for r in rules])
    base = secrets.spelled(F.filter("hits", lambda h: bases[h["rule"]]), rules)
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.spelled(F.col("hits"), rules).alias("spans"))


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", *toxicity.NEW)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.fold(4, 2)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "difference")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"), quality.fold(10, 0))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = manifest.leaf_digest(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    held = F.when(altered, lowered).otherwise(manifest.leaf_digest())
    proofs = manifest.Manifest.build(table(spark, sf_dir, "documents"), held=held).proofs()
    found = proofs.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", manifest.path_digest(F.col("path")).alias("proof_sha256"), manifest.folded(F.col("held"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: A conversation of control strings.
GUEST = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    guest = spark.createDataFrame(GUEST, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(guest)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.repeated(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.find_runs(docs).withColumn("_longest", periodic.longest(F.col("runs")))
    start, length, period = (F.col("_longest")[c].alias(c) for c in ("start", "length", "period"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start, length, period, F.floor(1000 * F.col("_longest.length") / F.col("_longest.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_pack, op2_decontaminate, op3_exact_dedup, op4_warc, op5_simhash, op6_secrets, op7_url_filter, op8_toxicity, op9_quality, op10_language_model, op11_merkle_manifest, op12_chat_format, op13_periodic_runs)}

#: SQL: the words of a text, lower-cased in A-Z.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op2_decontaminate": rf"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
        bi AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM bi),
        di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
        hits AS (SELECT doc_id, i, d.m, item FROM (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM di) d JOIN bw ON d.m = bw.m AND d.win = bw.win),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lowest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > lowest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > lowest THEN lowest END AS refers_to
        FROM f""",
    "op6_secrets": secrets.oracle(),
    "op11_merkle_manifest": manifest.oracle(),
    "op12_chat_format": chat.oracle(" UNION ALL ".join(f"SELECT {c}, {n}, '{r}', '{t}'" for c, n, r, t in GUEST)),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
