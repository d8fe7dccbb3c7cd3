"""The risk index as a stream: new scores are summed by key, batch by batch, and merged when the stored table is read.

Files that land in a folder are scores (case_name, ccs, tier, seq).  Each batch is
summed by key and written as a part of the index, named by its batch number, so a
batch that is run again replaces its own part.  Reading merges the parts; the
result equals one pass over all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import memory


def ingest(spark: SparkSession, landed: str, schema: StructType, index: str, checkpoint: str) -> None:
    """Take in all files of ``landed`` that were not seen before."""

    def merge(batch: DataFrame, number: int) -> None:
        memory.risk_index(memory.risk_rows(batch)).write.mode("overwrite").parquet(f"{index}/part={number}")

    rows = spark.readStream.schema(schema).parquet(landed)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, index: str) -> DataFrame:
    """(key, avg_ccs, n, last_tier) over all parts."""
    return memory.risk_table(memory.merge_risk(spark.read.parquet(index).drop("part")))


def compact(spark: SparkSession, index: str, target: str) -> None:
    """Write all parts as one to ``target``."""
    memory.merge_risk(spark.read.parquet(index).drop("part")).write.mode("overwrite").parquet(f"{target}/part=0")
