"""A lexical index that grows by portions.

Each portion (a volume, or a batch of a file stream) is indexed by itself: its documents' words and its
counts of documents by term are written to a folder of its own, and then a row of the log says that they count: (portion, version,
digest, folder, n_docs, n_words).  The log has a folder a row, renamed into place, so a portion is there whole or not at all,
and a run that was stopped leaves nothing that is read.  A portion that is there with the same digest is not built
again; one whose content has changed gets a new version, and the newest counts.

What the index is made of are sums over the portions that count: N and the words add up from the log, and df of a term is the sum
of its counts.  So one more volume costs that volume, and reading costs what it did.

Portions hold different documents.  An empty portion is a row of the log.  Nothing is ever changed in place; ``compact`` gathers what
counts into one portion.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lexical import LexicalIndex, counted_words, inverse_frequencies
from ..storage import digest_of, listed, published

def _counts(words: DataFrame) -> DataFrame:
    """(term, df)."""
    return words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


LOG = "portion string, version long, digest string, folder string, n_docs long, n_words long"


@dataclass(frozen=True)
class PortionedIndex:
    spark: SparkSession
    folder: str

    def log(self) -> DataFrame:
        """All rows of the log."""
        names = listed(self.spark, f"{self.folder}/log")
        if not names:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.folder}/log/{n}" for n in names])

    def current(self) -> DataFrame:
        """The newest row of each portion; a portion that was gathered into another has an empty folder."""
        newest = F.row_number().over(Window.partitionBy("portion").orderBy(F.desc("version")))
        return self.log().withColumn("_n", newest).where("_n = 1 AND folder <> ''").drop("_n")

    def add(self, portion: str, docs: DataFrame, digest: str | None = None) -> bool:
        """Index the documents (doc_id, text) of a portion; false if it is there already.

        ``digest`` tells its content; without one that of the files ``docs`` reads.
        """
        digest = digest_of(docs) if digest is None else digest
        known = {(r["version"], r["digest"]) for r in self.log().where(F.col("portion") == portion).collect()}  # the versions of one portion
        if known and max(known)[1] == digest:
            return False
        version = max((v for v, _ in known), default=0) + 1
        name = f"{hashlib.sha256(portion.encode()).hexdigest()[:24]}-{version}"
        data = f"{self.folder}/data/{name}-{digest[:16]}"
        counted_words(docs).write.mode("overwrite").parquet(f"{data}/words")
        words = self.spark.read.parquet(f"{data}/words")
        _counts(words).write.mode("overwrite").parquet(f"{data}/counts")
        sums = words.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_words"))
        row = sums.select(F.lit(portion).alias("portion"), F.lit(version).cast("bigint").alias("version"), F.lit(digest).alias("digest"), F.lit(data).alias("folder"), "n_docs", "n_words")
        return published(row, f"{self.folder}/log/{name}")

    def index(self) -> LexicalIndex:
        """The index of all portions that count."""
        rows = self.current().collect()  # a row a portion
        if not rows:
            empty = self.spark.createDataFrame([], "doc_id long, text string")
            return LexicalIndex.build(empty)
        words, counts = (self.spark.read.parquet(*[f"{r['folder']}/{part}" for r in rows]) for part in ("words", "counts"))
        n, total = sum(r["n_docs"] for r in rows), sum(r["n_words"] for r in rows)
        stats = self.spark.createDataFrame([(n, total / n if n else 0.0)], "n_docs long, avgdl double")
        return LexicalIndex(words, inverse_frequencies(counts, stats, F.sum("df")), stats)

    def follow(self, volumes: str, schema: str, checkpoint: str) -> None:
        """Index all files below ``volumes`` that have not been, a portion of what is there by now, and stop.

        A portion of many files is read by as many tasks as these are cut into.  The stream's checkpoint says which files it has seen; a batch that was broken off comes again under its
        number, and the log says whether it counts.
        """
        stream = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(volumes)

        def take(batch: DataFrame, number: int) -> None:
            self.add(f"batch-{number}", batch.select("doc_id", "text"), digest=f"{number:016d}")

        stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def compact(self, name: str) -> bool:
        """One portion in place of all that count now; they stay in the log, as gathered."""
        row = f"compact-{hashlib.sha256(name.encode()).hexdigest()[:24]}"
        if row in listed(self.spark, f"{self.folder}/log"):
            return False
        rows = self.current().collect()
        own = f"{self.folder}/data/{row}"
        index = self.index()
        for part, df in (("words", index.words), ("counts", _counts(index.words))):
            df.write.mode("overwrite").parquet(f"{own}/{part}")
        gathered = [(r["portion"], r["version"] + 1, r["digest"], "", 0, 0) for r in rows]
        fresh = (name, 1, "compact", own, sum(r["n_docs"] for r in rows), sum(r["n_words"] for r in rows))
        # one row of the log's folder says both, so no reader sees one without the other
        return published(self.spark.createDataFrame([fresh, *gathered], LOG), f"{self.folder}/log/{row}")
