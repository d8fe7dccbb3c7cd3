"""Running means of a stream: every arrival's mean and number of its key's values so far, across batches.

A batch numbers its own rows by a window and adds what earlier batches left; then it leaves its own sums by
key.  Both are written under the batch's number, and a batch reads only sums of lower numbers, so one that failed and comes
again gives the same rows in the same place.  Keys that a batch does not hold are not read beyond their sums.

Within a batch rows are ordered by ``seq``; batches follow each other as they arrive.  A null value counts for nothing, a
null key is a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import listed

ROW = "key string, seq long, value double"


class RunningMeans:
    """``steps`` (key, seq, value, run_avg, n) and ``sums`` (key, total, n), a part a batch, below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _before(self, number: int) -> DataFrame:
        """(key, total, n) of all batches below ``number``."""
        parts = [p for p in listed(self.spark, f"{self.folder}/sums") if p.startswith("batch=") and int(p[6:]) < number]
        if not parts:
            return self.spark.createDataFrame([], "key string, _total double, _n long")
        rows = self.spark.read.parquet(*[f"{self.folder}/sums/{p}" for p in parts])
        return rows.groupBy("key").agg(F.sum("total").alias("_total"), F.sum("n").alias("_n"))

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch of rows (key, seq, value)."""
        so_far = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = batch.select("key", "seq", "value").withColumns({"_sum": F.sum("value").over(so_far), "_count": F.count("value").over(so_far)})
        before = self._before(number).withColumnRenamed("key", "_key")
        both = own.join(before, F.col("key").eqNullSafe(F.col("_key")), "left")
        n = F.col("_count") + F.coalesce("_n", F.lit(0))
        total = F.coalesce("_sum", F.lit(0.0)) + F.coalesce("_total", F.lit(0.0))
        both.select("key", "seq", "value", F.when(n > 0, total / n).alias("run_avg"), n.alias("n")).write.mode("overwrite").parquet(f"{self.folder}/steps/batch={number}")
        sums = batch.groupBy("key").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("value").alias("n"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/batch={number}")

    def follow(self, landed: str, checkpoint: str, schema: str = ROW) -> None:
        """Take in the files of ``landed`` that were not seen before, one after the other, and stop."""
        rows = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(landed)
        rows.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def steps(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/steps").drop("batch")
