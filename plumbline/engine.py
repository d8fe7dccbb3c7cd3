"""What a review works with: texts, a lexical index, vectors and a catalog of names, built once and stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULTS, EngineConfig
from .functions import text as fx
from .models import Embedder, embedded, hashed_embedder
from .operators import catalog as catalogs
from .operators import dense, fusion
from .operators.lexical import LexicalIndex
from .storage import written

PARTS = ("texts", "vectors", "catalog")


@dataclass(frozen=True)
class Engine:
    """texts (doc_id, text, case_name, year, reporter_cite), index, vectors (vec_id, embedding) and catalog (kind, name)."""

    texts: DataFrame
    index: LexicalIndex
    vectors: DataFrame
    catalog: DataFrame
    embedder: Callable[[], Embedder] = hashed_embedder

    @classmethod
    def build(cls, docs: DataFrame, folder: str, embedder: Callable[[], Embedder] = hashed_embedder) -> Engine:
        """Of docs (doc_id, text, case_name, year, reporter_cite); each part that is there already is kept."""
        spark = docs.sparkSession
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fx.first_of(F.col("case_name")).alias("case_name"), F.coalesce("year", F.lit(0)).alias("year"), fx.first_of(F.col("reporter_cite")).alias("reporter_cite"))
        names = texts.select(F.lit("name").alias("kind"), F.col("case_name").alias("name")).unionByName(texts.select(F.lit("cite").alias("kind"), F.col("reporter_cite").alias("name")))
        made = {"texts": texts, "vectors": texts.select(F.col("doc_id").alias("vec_id"), embedded(F.col("text"), embedder).alias("embedding")), "catalog": names.where("name <> ''").distinct()}
        for part, df in made.items():
            df.write.mode("ignore").parquet(f"{folder}/{part}")
        LexicalIndex.build(spark.read.parquet(f"{folder}/texts")).save(f"{folder}/index", mode="ignore")
        return cls.load(spark, folder, embedder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, embedder: Callable[[], Embedder] = hashed_embedder) -> Engine:
        """Fails if a part is missing."""
        texts, vectors, names = (spark.read.parquet(f"{folder}/{part}") for part in PARTS)
        return cls(texts, LexicalIndex.load(spark, f"{folder}/index"), vectors, names, embedder)

    def names(self) -> DataFrame:
        return self.catalog.select("name").distinct()

    def search(self, queries: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
        """(query_id, rank, doc_id, rrf_score) of queries (query_id, query): the lexical and the dense list, fused.

        A column ``dense_query`` is what the dense side is asked instead of ``query``.
        """
        lexical = self.index.top(queries, config.lexical_k, config.bm25_k1, config.bm25_b)
        said = F.col("dense_query" if "dense_query" in queries.columns else "query")
        asked = queries.where(fx.stripped(F.coalesce("query", F.lit(""))) != "").select("query_id", embedded(said, self.embedder).alias("embedding"))
        near = dense.nearest(asked, self.vectors, config.dense_k).select("query_id", "rank", F.col("vec_id").alias("doc_id"))
        return fusion.fuse(near, lexical.select("query_id", "rank", "doc_id"), k=config.rrf_k, top=config.fused_k)

    def entities(self, hits: DataFrame) -> DataFrame:
        """(query_id, key, doc_id): which hit a name or a cite leads to."""
        rows = hits.select("query_id", "rank", "doc_id").join(self.texts, "doc_id")
        return fusion.entity_map(rows.select("query_id", "rank", "doc_id", F.array("case_name").alias("names"), F.array("reporter_cite").alias("cites")))

    def of_volumes(self, volumes: list[str]) -> Engine:
        """The same engine over a selection of volumes: its texts are filtered, and what is searched with them."""
        chosen = self.texts.where(catalogs.cited_volume(F.col("reporter_cite")).isin(*volumes))
        ids = chosen.select("doc_id")
        vectors = self.vectors.join(ids.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi")
        return Engine(chosen, LexicalIndex.build(chosen), vectors, self.catalog, self.embedder)


@dataclass(frozen=True)
class SharedSearch(Engine):
    """An engine for batches in which many queries are equal: each distinct one is searched for once."""

    @classmethod
    def of(cls, engine: Engine) -> SharedSearch:
        return cls(*[getattr(engine, f.name) for f in fields(Engine)])

    def search(self, queries: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
        texts = [c for c in ("query", "dense_query") if c in queries.columns]
        asked = written(queries.select("query_id", *[F.coalesce(c, F.lit("")).alias(c) for c in texts]), "asked")
        firsts = written(asked.groupBy(*texts).agg(F.min("query_id").alias("first_id")), "distinct")
        hits = super().search(firsts.withColumnRenamed("first_id", "query_id"), config).withColumnRenamed("query_id", "first_id")
        of_all = asked.join(firsts, texts).select("query_id", "first_id").join(hits, "first_id")
        # few rows: texts they are joined to need not move
        return written(of_all.select("query_id", "rank", "doc_id", "rrf_score"), "shared-hits")
