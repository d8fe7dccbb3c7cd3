"""A lexical index in blocks, of which a query reads what can still win.

Documents are dealt by their length into blocks of about ``DOCS`` neighbours, whose words count about alike.  A row of
``blocks`` (term, block, n, most, postings) holds the impacts of a term on the documents of a block and the largest of
them; rows lie sorted by term, and bounds are read without their postings.  ``terms`` (term, df, idf, most) holds the
largest impact of all.  An impact, times idf, is what a word that is asked for once adds to the score.

A batch of queries is answered in four steps, all joins on keys:

1. The rarest words of each query, with a small share of its postings, give partial scores; the ``TRIED`` best documents by
   these are scored in full, and the k-th best of them is the query's floor: no score below it is among the best k.
2. Bounds alone tell which blocks can reach the floor.
3. The words that together stay below the floor are set aside: a document that holds only those cannot win.  The others are
   scored in the blocks left; what a document lacks of the floor must be within its block's bound for the words set aside.
4. Documents left are scored in full.

Scores are sums of positive impacts, so the result equals that of scoring every posting.  A query with fewer than k documents has the floor
zero and reads all it has.  Queries without known words give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as fx
from ..storage import written, written_to
from .lexical import LexicalIndex

DOCS = 8
#: Of a query's postings, what the first partial scores are made of.
FIRST_SHARE = 0.05
TRIED = 32
#: More than rounding to six digits can add to a score.
SLACK = 2e-6


def _best(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


@dataclass(frozen=True)
class BlockedIndex:
    blocks: DataFrame
    terms: DataFrame

    @classmethod
    def build(cls, index: LexicalIndex, docs_per_block: int = DOCS, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b, folder: str | None = None) -> BlockedIndex:
        """With ``folder`` the blocks are written there, and not copied by ``create``."""
        # documents of a length are dealt by a digest into the places of that length, so none moves to learn its block
        lengths = index.docs.where("dl > 0").groupBy("dl").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.orderBy("dl")) - F.col("_n")
        places = lengths.withColumn("_before", before)
        place = F.col("_before") + F.pmod(F.xxhash64("doc_id"), F.col("_n"))
        placed = index.words.join(F.broadcast(places), "dl").withColumn("block", F.floor(place / docs_per_block)).select("doc_id", "block", "dl", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
        # words move once, to where they are gathered and lie sorted; what moves are small numbers, impacts are made of them there
        moved = placed.select("term", "block", "doc_id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")).repartitionByRange("term", "block")
        norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
        impact = F.col("tf") * (k1 + 1.0) / (F.col("tf") + norm)
        weighted = moved.crossJoin(F.broadcast(index.stats)).select("term", "block", "doc_id", impact.alias("impact"))
        held = F.collect_list(F.struct("doc_id", "impact"))
        gathered = weighted.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("impact").alias("most"), held.alias("postings")).sortWithinPartitions("term", "block")
        blocks = written(gathered, "blocks") if folder is None else written_to(gathered, f"{folder}/blocks")
        counts = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
        return cls(blocks, counts.join(index.terms.select("term", "idf"), "term"))

    @classmethod
    def create(cls, index: LexicalIndex, folder: str) -> None:
        """Build and save in one, with one copy of the blocks."""
        cls.build(index, folder=folder)._save_terms(folder, "overwrite")

    def _save_terms(self, folder: str, mode: str) -> None:
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{folder}/block-terms")

    def save(self, folder: str, mode: str = "overwrite") -> None:
        self.blocks.sortWithinPartitions("term", "block").write.mode(mode).parquet(f"{folder}/blocks")
        self._save_terms(folder, mode)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> BlockedIndex:
        return cls(spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/block-terms"))

    def _read(self, wanted: DataFrame) -> DataFrame:
        """Postings (doc_id, impact) of ``wanted`` (term, block, ...) with its columns."""
        return wanted.join(self.blocks.select("term", "block", "postings"), ["term", "block"]).select(*wanted.columns, F.inline("postings"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, qtf, pos, df, most) of the words that the index knows, qtf times idf; ``early`` says which are scored first."""
        words = queries.select("query_id", F.posexplode(fx.tokens(F.col("query"))).alias("pos", "term"))
        known = words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("pos")).join(self.terms, "term")
        known = known.withColumn("qtf", F.col("qtf") * F.col("idf")).drop("idf")
        own, rare = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("df", "term")
        early = (F.sum("df").over(rare) <= FIRST_SHARE * F.sum("df").over(own)) | (F.row_number().over(rare) == 1)
        return written(known.withColumn("early", early), "asked")

    def _full(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """(query_id, block, doc_id, score, first) of ``pairs`` (query_id, block, doc_id), from all words of the queries."""
        found = self._wanted(asked, pairs.select("query_id", "block").distinct()).select("query_id", "term", "block", "qtf", "pos")
        held = self._read(found).join(pairs.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        return held.groupBy("query_id", "block", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("impact")), 6).alias("score"), F.min("pos").alias("first"))

    def _wanted(self, asked: DataFrame, where: DataFrame) -> DataFrame:
        """The rows of the index for the words of ``asked`` in the blocks of ``where`` (query_id, block, ...)."""
        keys = self.blocks.select("term", "block", "n")
        return asked.join(keys, "term").join(where, ["query_id", "block"])

    def steps(self, queries: DataFrame, k: int = DEFAULTS.lexical_k) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The words asked for, the early ones' pairs that are scored in full, what is scored in step 3, and the pairs of step 4."""
        asked = self._asked(queries)
        early = self._read(asked.where("early").join(self.blocks.select("term", "block"), "term").select("query_id", "term", "block", "qtf"))
        partial = early.groupBy("query_id", "block", "doc_id").agg(F.sum(F.col("qtf") * F.col("impact")).alias("score"))
        tried = written(_best(partial, TRIED, F.desc("score"), F.col("doc_id")).select("query_id", "block", "doc_id"), "tried")
        floors = _best(self._full(asked, tried), k, F.desc("score")).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        weight = F.col("qtf") * F.col("most")
        rising = Window.partitionBy("query_id").orderBy(weight, "term")
        told = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
        told = written(told.withColumn("aside", F.sum(weight).over(rising) < F.col("floor")), "told")
        rows = told.drop("most").join(self.blocks.select("term", "block", "most"), "term")
        bounds = rows.groupBy("query_id", "block").agg(F.sum(weight).alias("bound"), F.coalesce(F.sum(F.when(F.col("aside"), weight)), F.lit(0.0)).alias("rest"), F.first("floor").alias("floor"))
        alive = written(bounds.where("bound >= floor").drop("bound"), "alive")
        scored = written(self._wanted(told.where("NOT aside").select("query_id", "term", "qtf"), alive), "scored")
        telling = self._read(scored).groupBy("query_id", "block", "doc_id").agg(F.sum(F.col("qtf") * F.col("impact")).alias("score"), F.first("rest").alias("rest"), F.first("floor").alias("floor"))
        left = written(telling.where("score + rest >= floor").select("query_id", "block", "doc_id"), "left")
        return asked, tried, scored, left

    def top(self, queries: DataFrame, k: int = DEFAULTS.lexical_k) -> DataFrame:
        """(query_id, rank, doc_id, score), as ``LexicalIndex.top`` gives it."""
        asked, _, _, left = self.steps(queries, k)
        best = _best(self._full(asked, left), k, F.desc("score"), F.col("first"), F.col("doc_id"))
        return best.where("score > 0").select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")

    def work(self, queries: DataFrame, k: int = DEFAULTS.lexical_k) -> DataFrame:
        """(query_id, all_postings, read_postings): what scoring every posting reads, and what the steps read, repeats included."""
        asked, tried, scored, left = self.steps(queries, k)
        every = asked.groupBy("query_id").agg(F.sum("df").alias("all_postings"), F.sum(F.when(F.col("early"), F.col("df"))).alias("_early"))
        words = asked.select("query_id", "term")
        parts = [self._wanted(words, pairs.select("query_id", "block").distinct()).select("query_id", "n") for pairs in (tried, left)]
        more = parts[0].unionByName(parts[1]).unionByName(scored.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("_more"))
        return every.join(more, "query_id", "left").select("query_id", "all_postings", (F.col("_early") + F.coalesce("_more", F.lit(0))).alias("read_postings"))
