"""Tables whose rows know their place are cut by the input, and leave nothing in the catalog."""

from pyspark.sql import functions as F

from plumbline.llm import exact
from plumbline.llm.common import PLACE, numbered, reopened


def test_pieces_follow_the_input(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text")).repartition(50).write.parquet(path)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    size = sum(f.stat().st_size for f in (tmp_path / "docs").glob("*.parquet"))
    spark.conf.set(key, str(size // 50))
    try:
        docs = spark.read.parquet(path)
        table = numbered(docs)
        marks = table.rows.where("doc_id % 3 = 0").select(*PLACE, F.col("doc_id").alias("told"))
        found = table.beside(marks, "doc_id")
        tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
        assert table.buckets >= 50 > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(r["doc_id"] for r in found.where("doc_id = told").collect()) == list(range(0, 5000, 3))
        assert 25 <= tasks <= 50  # some of the 50 blocks share a bucket
        assert found.rdd.getNumPartitions() == table.buckets
    finally:
        spark.conf.set(key, old)
    again = reopened(spark, table.path, table.buckets)
    assert again.rows.count() == 5000


def test_nothing_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    assert exact.dedup_exact(docs).count() == 7 and exact.exact_groups(docs).where("kept").count() == 7
    assert {t.name for t in spark.catalog.listTables()} == before
