"""Reciprocal rank fusion of ranked lists, and keys that lead from a name to a hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..storage import written


def fuse(*lists: DataFrame, k: int = DEFAULTS.rrf_k, top: int = DEFAULTS.fused_k) -> DataFrame:
    """(query_id, rank, doc_id, rrf_score), written, of lists (query_id, rank, doc_id), the dense one first.

    Ties go to the earlier list, then to the better rank in it.
    """
    tagged = [x.select("query_id", "rank", "doc_id", F.lit(i).alias("list_no")) for i, x in enumerate(lists)]
    both = tagged[0]
    for x in tagged[1:]:
        both = both.unionByName(x)
    score = F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), 6)
    first = F.min(F.struct("list_no", "rank"))
    summed = both.groupBy("query_id", "doc_id").agg(score.alias("rrf_score"), first.alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first", "doc_id")
    ranked = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    # few rows: texts they are joined to need not move
    return written(ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "rrf_score"), "fused")


def entity_map(hits: DataFrame) -> DataFrame:
    """(query_id, key, doc_id) of hits (query_id, rank, doc_id, names, cites), names and cites arrays of keys.

    A key that a cite gives leads to the last hit with that cite, any other to the first hit of that name.
    """
    keyed = hits.select("query_id", "rank", "doc_id", F.explode(F.concat(F.transform("names", lambda n: F.struct(n.alias("key"), F.lit(False).alias("cite"))), F.transform("cites", lambda n: F.struct(n.alias("key"), F.lit(True).alias("cite"))))).alias("k"))
    keyed = keyed.select("query_id", "rank", "doc_id", F.lower("k.key").alias("key"), "k.cite").where("key <> ''")
    last = F.max_by("doc_id", F.when(F.col("cite"), F.col("rank")))
    first = F.min_by("doc_id", F.when(~F.col("cite"), F.col("rank")))
    return keyed.groupBy("query_id", "key").agg(F.coalesce(last, first).alias("doc_id"))
