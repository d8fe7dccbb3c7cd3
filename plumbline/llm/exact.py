"""Exact deduplication as a stateful stream, in DataFrame and streaming functions only.

Texts are equal when they are identical after each run of ASCII white space is
replaced by one space.  Rows are written once with their place; the narrow columns
(digest, identifier, place) of what was written are streamed into a keyed state on disk
(RocksDB) that never expires: per digest it holds the smallest identifier, the
locator of that row and the number of rows.  The locator is the row's number in the written
table, of which the upper bits name its block, so it leads to the row's content.  Copies are
summed before they are shuffled, so a group that holds a third of all rows sends one row per task.
``exact_groups`` starts with an empty state, or goes on from a folder of the caller's: that keeps
the state, the narrow rows and the places of all texts so far, so later input is held against earlier
content as well, whole texts included.

Equal digests are hits; for those the full texts are compared.  The rows of hit digests
are marked where they lie, their texts are made distinct in each task and only then
shuffled, and a digest with more than one text is split by text.

Null text counts as empty.  A null doc_id comes after all others.  Of rows
that agree in text and doc_id exactly one stays.  Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, SPACE_CLASS, Numbered, as_row, numbered, reopened, require_columns, row_columns, scratch, shared_path, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings while a state query starts: state on disk, with bounded memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # stores of a finished query are closed soon
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    # many small stores: no space set aside in advance
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(column="text"):
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SPACE_CLASS, " ")


def first_row(locator: str = PLACE[1]):
    """Orders rows by identifier, nulls last, then by locator."""
    return F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col(locator).alias("locator"))


def update_state(spark: SparkSession, folder: str, schema, checkpoint: str, locator: str = "locator") -> None:
    """Stream all files of ``folder`` (key, doc_id and the named locator) that the state has not seen into it."""
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(schema).parquet(folder)
        state = rows.groupBy("key").agg(F.min(first_row(locator)).alias("first"), F.count("*").alias("n"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: key, first (none, id, locator), n."""
    found = spark.read.format("statestore").load(checkpoint)
    value = {f.name: f.dataType.typeName() for f in found.schema["value"].dataType.fields}
    first = next(n for n, kind in value.items() if kind == "struct")
    count = next(n for n, kind in value.items() if kind == "long")
    return found.select(F.col("key")["key"].alias("key"), F.col("value")[first].alias("first"), F.col("value")[count].alias("n"))


def _digested(docs: DataFrame, key_digits: int) -> Numbered:
    """All columns of ``docs`` as a struct, with doc_id, the key of the state and the digest, and places."""
    sha = F.sha2(normalised().cast("binary"), 256)
    return numbered(docs.select(as_row(docs), "doc_id", F.unhex(F.substring(sha, 1, key_digits)).alias("key"), F.unhex(sha).alias("sha")), "digested")


def _groups(table: Numbered, scratched: list[str] | None = None) -> DataFrame:
    """PLACE, doc_id, keep_id, group_size, kept and text_sha256 of every row.  The state's folder is put on ``scratched``."""
    spark, rows = table.rows.sparkSession, table.rows.select(*PLACE, "doc_id", "key", "sha")
    if not rows.take(1):
        return rows.select(*PLACE, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    checkpoint = shared_path(spark, "dedup-state")
    if scratched is not None:
        scratched.append(checkpoint)
    update_state(spark, table.path, rows.select("key", "doc_id", PLACE[1]).schema, checkpoint, PLACE[1])
    state = written(read_state(spark, checkpoint), "state")

    def decided() -> list:
        return [*PLACE, "doc_id", F.col("first")["id"].alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row_no") == F.col("first")["locator"]).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]

    found = written(rows.join(state, "key").select("key", *decided()), "found")

    # hits: compare full texts, those of a task folded before they are shuffled
    hits = table.beside(found.where("group_size > 1").select(*PLACE), "key", "_row", how="left_semi").select("key", normalised("_row.text").alias("body"))
    distinct = hits.groupBy("key", "body").agg(F.lit(1).alias("one"))
    mixed = written(distinct.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "mixed")
    if not mixed.take(1):
        return found.drop("key")
    # digests that stand for several texts: tell those apart by the whole text
    marks = found.join(mixed, "key", "left_semi").select(*PLACE)
    apart = written(table.beside(marks, "doc_id", "key", "sha", "_row", how="left_semi").select(*PLACE, "doc_id", "key", "sha", normalised("_row.text").alias("body")), "apart")
    groups = apart.groupBy("key", "body").agg(F.min(first_row()).alias("first"), F.count("*").alias("n"))
    split = apart.join(groups, ["key", "body"]).select(*decided())
    return found.join(mixed, "key", "left_anti").drop("key").unionByName(split)


def exact_groups(docs: DataFrame, key_digits: int = 64, state: str | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and locator.

    ``key_digits`` shortens the digest the state is keyed by (for tests of the full comparison).  With ``state``,
    a folder all executors can reach, groups go on from earlier calls: keep_id and group_size
    count the rows of those too, and a row is kept only if no earlier or later call's row came first by then.
    """
    require_columns(docs, "doc_id", "text")
    table = _digested(docs.select("doc_id", "text"), key_digits)
    if state is not None:
        return _continued(table, state.rstrip("/"))
    return _groups(table).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", F.col("_row_no").alias("locator"))


def _continued(table: Numbered, folder: str) -> DataFrame:
    """The groups of a table on top of those of earlier ones; the locator is (input, row number there)."""
    spark = table.rows.sparkSession
    inputs = spark.read.parquet(f"{folder}/inputs").collect() if _there(spark, f"{folder}/inputs") else []  # a row a call
    own = max((r["input"] for r in inputs), default=-1) + 1
    tables = {r["input"]: reopened(spark, r["path"], r["buckets"]) for r in inputs} | {own: table}
    spark.createDataFrame([(own, table.path, table.buckets)], "input int, path string, buckets int").coalesce(1).write.mode("append").parquet(f"{folder}/inputs")
    narrow = table.rows.select("key", "doc_id", F.struct(F.lit(own).alias("input"), *PLACE).alias("locator"))
    narrow.write.mode("append").parquet(f"{folder}/digests")
    update_state(spark, f"{folder}/digests", narrow.schema, f"{folder}/state")
    first = written(read_state(spark, f"{folder}/state"), "state")
    rows = written(table.rows.select(*PLACE, "key", "doc_id", "sha").join(first, "key"), "found")

    def bodies(places: DataFrame) -> DataFrame:
        """(doc_id, key, locator, body) of rows of any input: places (locator), each read where it lies."""
        parts = []
        for number, source in tables.items():
            marks = places.where(F.col("locator.input") == number).select("locator.*").drop("input").distinct()
            found = source.beside(marks, "doc_id", "key", "_row", how="left_semi")
            parts.append(found.select("doc_id", "key", F.struct(F.lit(number).alias("input"), *PLACE).alias("locator"), normalised("_row.text").alias("body")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    here = F.struct(F.lit(own).alias("input"), *PLACE).alias("locator")
    hits = rows.where("n > 1")
    asked = hits.select(here).unionByName(hits.select(F.col("first.locator").alias("locator")))
    distinct = bodies(asked).groupBy("key", "body").agg(F.lit(1).alias("one"))
    mixed = written(distinct.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "mixed")
    columns = ["doc_id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("first.locator")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "locator"]
    placed = rows.withColumn("locator", here)
    plain = placed.join(mixed, "key", "left_anti").select(*columns)
    if not mixed.take(1):
        return plain
    every = spark.read.schema(narrow.schema).parquet(f"{folder}/digests").join(mixed, "key", "left_semi")
    apart = written(bodies(every.select("locator")), "apart")
    groups = apart.groupBy("key", "body").agg(F.min(first_row("locator")).alias("first"), F.count("*").alias("n"))
    split = apart.where(F.col("locator.input") == own).join(groups, ["key", "body"]).join(placed.select("locator", "sha"), "locator")
    return plain.unionByName(split.select(*columns))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def dedup_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    require_columns(docs, "doc_id", "text")
    table = _digested(docs, 64)
    with scratch(docs.sparkSession) as paths:
        gone = _groups(table, paths).where("NOT kept").select(*PLACE)
        return table.beside(gone, "_row", how="left_anti").select(*row_columns(docs))
