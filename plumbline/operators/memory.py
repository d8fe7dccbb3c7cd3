"""A verdict cache and a risk index: keyed tables, merged rather than updated row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, RISKY_TIERS
from ..functions import text as fx


def running_means(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``rows`` with run_avg and n: mean and number of the key's values so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"run_avg": F.avg(value).over(w), "n": F.count(value).over(w)})


def risk_rows(scores: DataFrame) -> DataFrame:
    """(key, ccs, tier, seq) of the scores that raise suspicion: scores (case_name, ccs, tier, seq)."""
    rows = scores.where(F.col("tier").isin(*RISKY_TIERS) & (fx.stripped(F.coalesce("case_name", F.lit(""))) != ""))
    return rows.select(fx.stable_key(F.col("case_name")).alias("key"), F.coalesce("ccs", F.lit(0.0)).alias("ccs"), "tier", "seq")


def risk_index(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, total, n, last): sums rather than means, so that indexes merge exactly.  Rows (key, ccs, tier, seq)."""
    return rows.groupBy(key).agg(F.sum("ccs").alias("total"), F.count("*").alias("n"), F.max(F.struct("seq", "tier")).alias("last"))


def merge_risk(*indexes: DataFrame, key: str = "key") -> DataFrame:
    all_rows = indexes[0]
    for x in indexes[1:]:
        all_rows = all_rows.unionByName(x)
    return all_rows.groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("last").alias("last"))


def risk_table(index: DataFrame, key: str = "key") -> DataFrame:
    return index.select(key, (F.col("total") / F.col("n")).alias("avg_ccs"), "n", F.col("last.tier").alias("last_tier"))


def high_risk(neighbours: DataFrame, risks: DataFrame, k: int = DEFAULTS.risk_k, threshold: float = DEFAULTS.risk_threshold) -> DataFrame:
    """(query_id, vec_id) of the k nearest stored citations (query_id, rank, vec_id) whose mean (vec_id, avg_ccs) is low.

    The cut comes before the filter: a query may get fewer than k.
    """
    return neighbours.where(F.col("rank") <= k).join(risks, "vec_id").where(F.col("avg_ccs") < threshold).select("query_id", "vec_id")


def verdict_rows(results: DataFrame) -> DataFrame:
    """(key, query, answer, confidence, seq) of results (query, answer, confidence, n_verified, seq) worth keeping."""
    return results.where("n_verified > 0 AND confidence > 0").select(fx.stable_key(F.col("query")).alias("key"), "query", "answer", "confidence", "seq")


def upsert(old: DataFrame, new: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The newest row of each key."""
    both = old.unionByName(new)
    newest = F.max_by(F.struct(*both.columns), F.struct(order))
    return both.groupBy(key).agg(newest.alias("_r")).select("_r.*")


def without_namespace(table: DataFrame, namespace: str) -> DataFrame:
    """Clearing: all rows but those of a namespace."""
    return table.where(F.coalesce(F.col("namespace"), F.lit("")) != namespace)
