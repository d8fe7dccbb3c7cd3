"""Numbers of all rows in an order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def global_ranks(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with its place, from 0, in the given order: ranges are sorted apart, and their sizes are added up."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # a row a range
    firsts, total = [], 0
    for part, n in sorted((r["_part"], r["_n"]) for r in sizes):
        firsts.append((part, total))
        total += n
    base = df.sparkSession.createDataFrame(firsts, "_part int, _first long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn(name, inside).join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_first")).drop("_part", "_first")
