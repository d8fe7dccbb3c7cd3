"""Shards of tables in which one page_id, or one row, is a third of all."""

import pytest

from plumbline.llm import common, warc
from tests.llm.test_operators import brute_warc, rows

HOT = [(5, f"http://hot/{i % 3}", "same " * 60) for i in range(90)] + [(5, "http://hot/x", f"own {i} " * 50) for i in range(60)]
NULLS = [(None, "u", "n" * 200)] * 70 + [(None, f"u{i}", f"other {i} " * 20) for i in range(50)]
REST = [(i, f"http://r/{i}", f"page {i % 40} " * 30) for i in range(10, 130)]


def archived(spark, table, parts, **options):
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(parts)
    folder = common.shared_path(spark, "warc")
    manifest = warc.write_archives(df, folder, **options)
    return manifest, warc.read_archives(manifest, folder)


@pytest.mark.parametrize("shard_bytes", [2000, 9000, 1 << 20])
def test_hot_page_ids_are_cut(spark, shard_bytes):
    every = HOT + NULLS + REST
    manifest, got = archived(spark, every, 3, shard_bytes=shard_bytes, roll_bytes=1 << 20)
    assert rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == brute_warc(every)
    records = {}
    for r in manifest.collect():
        records[r["shard"]] = records.get(r["shard"], 0) + r["records"]
    assert sum(records.values()) == len(every)
    if shard_bytes < 10_000:
        # about as many bytes in each: no shard has more rows than the smallest records allow, and one
        assert max(records.values()) <= shard_bytes / (200 + warc.HEAD_BYTES) + 2 and len(records) > 10
    other, _ = archived(spark, list(reversed(every)), 7, shard_bytes=shard_bytes, roll_bytes=1 << 20)
    digests = [sorted((r["path"].rpartition("/")[2], r["sha256"]) for r in m.collect()) for m in (manifest, other)]
    assert digests[0] == digests[1]


def test_page_ids_that_are_no_integers(spark):
    with pytest.raises(ValueError, match="integer"):
        warc.write_archives(spark.createDataFrame([("a", "u", "x")], "page_id string, url string, html string"), common.shared_path(spark, "warc"))
