"""Shared pieces of the corpus operators: the shared folder, written tables, byte words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of an Arrow batch of texts.
BATCH_BYTES = 4 << 20
#: ASCII white space [\x20\x09-\x0D]; exactly what ``bytes.split()`` splits on.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is the one named in ``spark.checkpoint.dir``.  Only where that is unset
    on a local master (tests) a temporary folder is made and set; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    This cuts the lineage: a lost executor costs a re-read, not a re-run, and
    values that depend on partitioning stay what they were.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes what ``written`` wrote inside, and other paths put on the list, once nothing reads it any more.

    What leaves the block must not depend on such tables; places and marks (``numbered``, ``beside``) stay.
    """
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield paths
    finally:
        _scratch.remove(paths)
        conf, make = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            at = make(path)
            at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of a few megabytes, so that a worker's memory does not depend on them.

    Results are computed when they are asked for, so the setting stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_held: dict[tuple, object] = {}


def hold(owner: str, key: object = None, make=None):
    """What a Python worker keeps between batches, of one operator at a time.

    Workers outlive the stage that started them; when another operator runs in one, what the last one kept
    is dropped.
    """
    import pyarrow as pa

    others = [k for k in _held if k[0] != owner]
    for k in others:
        del _held[k]
    if others:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # the C library's own, where there is one
            ctypes.CDLL(None).malloc_trim(0)
    if make is None:
        return None
    if (owner, key) not in _held:
        _held[owner, key] = make()
    return _held[owner, key]


def text_bytes(column: str = "text"):
    """The text in UTF-8; null stays null."""
    return F.col(column).cast("binary")


def byte_values(column) -> Iterable[bytes]:
    """Values of an Arrow binary column, null as empty."""
    return (x or b"" for x in column.to_pylist())


def slices(batch, column: int, most_bytes: int) -> Iterator:
    """An Arrow batch in slices of about ``most_bytes`` bytes of one binary column, a row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(text, label), a written table of distinct rows: at most ``sample`` of each label 0 and 1.

    Labels are sampled by the hash of their doc_id, and the texts found for them once more by the hash of the
    text, so that a doc_id of many rows does not make the sample longer.  Texts of equal 64-bit hash count as one
    when the sample is bounded.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias(label)).distinct()
    classes = (0, 1)
    chosen = [known.where(F.col(label) == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in classes]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    hashed = docs.select("doc_id", F.xxhash64(text).alias("_h")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("_h", label).distinct()
    hashes = written(hashed, "label-hashes")
    kept = [hashes.where(F.col(label) == c).orderBy("_h").limit(sample) for c in classes]
    found = docs.select(text.alias("text")).withColumn("_h", F.xxhash64("text")).join(F.broadcast(kept[0].unionByName(kept[1])), "_h")
    return written(found.select("text", label).distinct(), "labelled")


#: Where a row lies: the task that wrote it, and its number among all rows (that of the block in the upper bits).
PLACE = ("_block", "_row_no")
#: Rows of a block whose marks lie together.
SEGMENT = 128


@dataclass(frozen=True)
class Numbered:
    """A written table whose rows know their PLACE, the folder it lies in, and its number of buckets.

    What is found out about single rows is brought to them by ``beside``, so whole texts are written
    once and never shuffled, however many rows are marked.
    """

    rows: DataFrame
    path: str
    buckets: int

    def by_block(self, facts: DataFrame, *columns: str) -> DataFrame:
        """Rows (PLACE and ``columns``) with what ``facts``, a row a block at most, say of their block, without moving the rows."""
        near, _ = laid_out(facts.repartition(self.buckets, PLACE[0]), "marks", self.buckets)
        return self.rows.select(*PLACE, *columns).join(near.hint("shuffle_hash"), PLACE[0], "left")

    def beside(self, marks: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
        """Rows (PLACE and ``columns``) with the columns of narrow ``marks`` (PLACE, ...), without moving the rows.

        Marks hold a row at most for each place; ``how`` is inner, left, left_semi or left_anti.  The marks of
        a block are gathered into one row.  A task holds those of all blocks of its bucket: no more than it has rows, of
        a share of the input that does not grow with it (``bucket_count``).
        """
        block, number = PLACE
        segment = F.shiftright(F.col(number).bitwiseAND(F.lit((1 << 33) - 1)), SEGMENT.bit_length() - 1).cast("int")
        payload = [c for c in marks.columns if c not in PLACE]
        by_segment = marks.groupBy(block, segment.alias("_segment")).agg(F.collect_list(F.struct(number, *payload)).alias("_m"))
        by_block = by_segment.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("_segment", "_m"))).alias("_marks"))
        joined = self.by_block(by_block, *columns)
        here = F.try_element_at("_marks", segment)
        if how in ("left_semi", "left_anti"):
            held = F.coalesce(F.array_contains(F.transform(here, lambda m: m[number]), F.col(number)), F.lit(False))
            return joined.where(held if how == "left_semi" else ~held).drop("_marks")
        found = joined.withColumn("_own", F.get(F.filter(here, lambda m: m[number] == F.col(number)), F.lit(0))).drop("_marks")
        if how == "inner":
            found = found.where("_own IS NOT NULL")
        return found.select(*PLACE, *columns, *[F.col("_own")[c].alias(c) for c in payload])


def laid_out(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str]:
    """Write ``df``, which has a column ``_block``, in buckets by it; a scan of what was written, and its folder.

    Tables of as many buckets meet by ``_block`` without moving a row of either.
    """
    spark = df.sparkSession
    path, title, key = shared_path(spark, name), f"plumbline_{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(key, None)
    # a task's rows go to one bucket as a rule: no need to sort them by bucket first
    spark.conf.set(key, "64")
    try:
        df.write.format("parquet").bucketBy(buckets, PLACE[0]).option("path", path).saveAsTable(title)
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
    return _unlisted(spark, title), path


def _unlisted(spark: SparkSession, title: str) -> DataFrame:
    """A scan of a bucketed table, whose entry in the catalog goes: the scan knows the files and their buckets."""
    scan = spark.read.table(title)
    spark.sql(f"DROP TABLE {title}")
    return scan


def bucket_count(df: DataFrame) -> int:
    """As many as the files that ``df`` reads are cut into partitions, the shuffle setting at least, and no more than Spark allows.

    A bucket is read by one task and cannot be cut, so its share of the input must not grow with the input.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    held = sum(n for n in sizes if n < 1 << 60)  # sources that do not know their size say more
    piece = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // piece)))


def reopened(spark: SparkSession, path: str, buckets: int) -> Numbered:
    """A table that ``numbered`` wrote, also in a session that does not know it."""
    title = f"plumbline_{uuid.uuid4().hex}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {title} ({fields}) USING parquet CLUSTERED BY (`{PLACE[0]}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return Numbered(_unlisted(spark, title), path, buckets)


def numbered(df: DataFrame, name: str = "numbered") -> Numbered:
    """``df`` written with the PLACE of each row."""
    buckets = bucket_count(df)
    placed = df.withColumns(dict(zip(PLACE, (F.spark_partition_id(), F.monotonically_increasing_id()), strict=True)))
    return Numbered(*laid_out(placed, name, buckets), buckets)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any case: outputs replace inputs of their name."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def as_row(df: DataFrame):
    """All columns as one struct, so that no name can clash with working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def row_columns(df: DataFrame, *replaced: str) -> list:
    low = {n.lower() for n in replaced}
    return [F.col("_row").getField(c).alias(c) for c in df.columns if c.lower() not in low]


def tree_of(key: Column) -> Column:
    """A string that is never null and sorts as the keys do in UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Written ``rows`` (tree, ...) with ``pos``, their place from 0 in their tree by ``order``, and ``size``, the rows of the tree.

    Ranges of (tree, order) are sorted apart; equal rows may lie in several, so no key fills a task.  Within a range
    a tree's rows are numbered in one stretch, and only a table of ranges and trees is summed up.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions(), 1)
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, "tree", *order, "_salt")
    runs = written(ranged.sortWithinPartitions("tree", *order).drop("_salt").withColumn("_seq", F.monotonically_increasing_id()), "sorted-runs")
    runs = runs.withColumn("_part", F.shiftright("_seq", 33))
    stretches = runs.groupBy("_part", "tree").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    earlier = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = stretches.select("_part", "tree", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_n").over(tree).alias("size"))
    return runs.join(base, ["_part", "tree"]).withColumn("pos", F.col("_seq") + F.col("_base")).drop("_part", "_seq", "_base")
