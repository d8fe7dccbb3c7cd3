"""Stored vectors with versions: upserts rewrite the buckets they touch.

Rows lie in buckets by the hash of their key.  A version is a manifest, a table of (bucket, path); readers take the
newest.  An upsert stages its rows once, rewrites the touched buckets a group at a time into new files, notes each group
that is done, and at last publishes a manifest in which those buckets point to the new files.  Until then readers see the version
before; a run that was stopped goes on behind the last group that it noted, if it is called again with the same batch
name, and a batch that is in a manifest is not taken twice.

Of several rows of a key in one batch the greatest row stays.  Null keys are left out.  Files of older versions stay until ``vacuum``.
One writer at a time: of two that publish the same version, one fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, listed, published, removed

#: Buckets that are rewritten between two notes.
GROUP = 32


@dataclass(frozen=True)
class VectorStore:
    spark: SparkSession
    folder: str
    schema: str
    key: str
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: str, key: str = "doc_id", buckets: int = 256) -> VectorStore:
        """A new store; ``buckets`` for its whole life, so that a bucket of the largest table fits a task."""
        published(spark.createDataFrame([(schema, key, buckets)], "schema string, key string, buckets int"), f"{folder}/about/store")
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorStore:
        about = spark.read.parquet(f"{folder}/about/store").first()
        return cls(spark, folder, about["schema"], about["key"], about["buckets"])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[str]:
        return listed(self.spark, f"{self.folder}/manifests")

    def manifest(self, version: str | None = None) -> dict[int, str]:
        """bucket -> path of a version, the newest by default; a row a bucket."""
        versions = self.versions()
        if not versions:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/manifests/{version or versions[-1]}").collect()
        return {r["bucket"]: r["path"] for r in rows if r["bucket"] >= 0}

    def batches(self) -> set[str]:
        """The batches that some version holds."""
        versions = self.versions()
        return {v.partition("-")[2] for v in versions}

    def _rows(self, paths: dict[int, str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(paths.values()))

    def read(self, version: str | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def upsert(self, rows: DataFrame, batch: str, group: int = GROUP) -> bool:
        """Put rows in the place of those of their keys; false if the batch is there already.  ``batch``: letters, digits and _."""
        if batch in self.batches():
            return False
        columns = self.spark.createDataFrame([], self.schema).columns
        work = f"{self.folder}/work/{batch}"
        if not exists(self.spark, f"{work}/staged/_SUCCESS"):
            fresh = rows.where(F.col(self.key).isNotNull()).select(*columns)
            one = fresh.groupBy(self.key).agg(F.max(F.struct(*[c for c in columns if c != self.key])).alias("_r")).select(self.key, "_r.*").select(*columns)
            one.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{work}/staged")
        touched = sorted(int(n.partition("=")[2]) for n in listed(self.spark, f"{work}/staged") if n.startswith("bucket="))
        now = self.manifest()
        made: dict[int, str] = {}
        for at in range(0, len(touched), group):
            part, name = touched[at : at + group], f"{at:08d}"
            if not exists(self.spark, f"{work}/done/{name}"):
                self._rewrite(work, name, part, {b: now[b] for b in part if b in now})
                published(self.spark.createDataFrame([(part[-1],)], "last int"), f"{work}/done/{name}")
            made |= {b: f"{work}/data/{name}/bucket={b}" for b in part}
        version = f"{len(self.versions()):08d}-{batch}"
        table = self.spark.createDataFrame(sorted((now | made).items()) or [(-1, "")], "bucket int, path string")
        if any(v.startswith(version[:9]) for v in self.versions()) or not published(table, f"{self.folder}/manifests/{version}"):
            raise RuntimeError(f"version {version} was published by another writer")
        return True

    def _rewrite(self, work: str, name: str, part: list[int], paths: dict[int, str]) -> None:
        """The buckets of a group, old rows and new ones, into files of their own."""
        new = self.spark.read.schema(self.schema).parquet(*[f"{work}/staged/bucket={b}" for b in part])
        old = self._rows(paths).join(new.select(self.key), self.key, "left_anti")
        both = old.select(*new.columns).unionByName(new).withColumn("bucket", self.bucket())
        both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{work}/data/{name}")

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest versions, and the files that none of those reads."""
        versions = self.versions()
        used = {path for v in versions[-keep:] for path in self.manifest(v).values()}
        for batch in listed(self.spark, f"{self.folder}/work"):
            if batch not in self.batches():
                continue
            for name in listed(self.spark, f"{self.folder}/work/{batch}/data"):
                for b in listed(self.spark, f"{self.folder}/work/{batch}/data/{name}"):
                    path = f"{self.folder}/work/{batch}/data/{name}/{b}"
                    if b.startswith("bucket=") and path not in used:
                        removed(self.spark, path)
            removed(self.spark, f"{self.folder}/work/{batch}/staged")
