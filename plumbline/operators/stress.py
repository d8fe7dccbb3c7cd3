"""Labelled citations of six classes, made from a table of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import global_ranks

SHIFT = 5


def stress_set(cases: DataFrame, invented: DataFrame, off_corpus: DataFrame) -> DataFrame:
    """(type, item, case_name, reporter_cite, holding) from cases (id, case_name, reporter_cite, holding, distractor).

    Misattributed citations have the holding of the case SHIFT places on; invented and off_corpus
    (id, case_name, reporter_cite, holding) are taken as they are.
    """
    n = cases.count()
    ranked = global_ranks(cases, "id", name="_rn")
    other = ranked.select(F.col("_rn").alias("_at"), F.col("holding").alias("_holding"))
    swapped = ranked.withColumn("_at", (F.col("_rn") + SHIFT) % F.lit(max(n, 1))).join(other, "_at")

    def rows(kind: str, df: DataFrame, cite=None, holding="holding") -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.col("id").cast("bigint").alias("item"), "case_name", (F.col("reporter_cite") if cite is None else cite).alias("reporter_cite"), F.col(holding).alias("holding"))

    parts = [
        rows("correct", cases), rows("misattributed", swapped, holding="_holding"), rows("casehold_distractor", cases.where("distractor <> ''"), holding="distractor"),
        rows("fabricated_with_cite", invented.where("reporter_cite <> ''")), rows("fabricated_no_cite", invented, cite=F.lit("")), rows("real_off_corpus", off_corpus),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
