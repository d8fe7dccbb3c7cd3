"""Deterministic, sharded WARC archives of a table of pages, and reading them back.

Writing: records are ordered by page_id, payload digest and a hash of the URL, and cut into
shards of about equal size.  The cuts come from running sums of bytes over that order, so they
depend on the rows alone: one pass sorts the narrow columns by ranges, sums of the ranges go to the driver, and
only the shards' first places travel to the rows.  A page_id of many payloads is cut between them; equal
rows, however many, are folded into one with a count before they are shuffled, and the count is cut.
The rows of a shard are sorted and one task writes them.  Every record
is a gzip member of its own; a file is closed once its compressed size
reaches ``roll_bytes``.  Headers (record ids, lengths, digests, a fixed date)
are made anew from the rows, so equal tables give equal bytes.  A file is
written under a temporary name and renamed; the manifest, a written table,
lists the files that count with their sizes and digests.  A task that runs
again writes the same files; files of no manifest are never read.

Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one of
the smallest page_id is a response and the others are revisit records that
refer to it.  Of rows that agree in page_id and payload the first is the
response.  page_id must be an integer.  A null page_id is always a response and never referred to.  Null
html is an empty payload, a null url is written as ``urn:null``.  Other columns
are not read.  An empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, require_columns, shared_path, written

REVISIT_BYTES = 100
SHARD_BYTES = 64 << 20
ROLL_BYTES = 256 << 20
#: Beyond this many shards they grow: to 5 GB, in files of ROLL_BYTES, for 100 TB.
MOST_SHARDS = 20_000
#: What a record takes beside its payload, about.
HEAD_BYTES = 512
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "path string, shard int, part int, records long, compressed_bytes long, sha256 string"
RECORDS = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"


# ---------------------------------------------------------------- records


def record_id(kind: str, page_id: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page_id}/{digest}')}>"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))])
    return gzip_member(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")


def header_text(value: str | None) -> str:
    """A value that stays on its line: controls and spaces are percent-encoded."""
    if value is None:
        return "urn:null"
    return "".join(c if c > "\x20" and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def page_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    name = "" if page_id is None else str(page_id)
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, name, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", header_text(url)),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", name), ("X-Payload-Length", str(len(payload))),
    ]
    if url is None:
        headers.append(("X-Null-Uri", "1"))
    if refers_to is None:
        return record(headers, HTTP_HEAD + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", str(refers_to), digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return record(headers, HTTP_HEAD)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every gzip member; block digests are checked."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                return
        unpacker, out = zlib.decompressobj(31), io.BytesIO()
        while True:
            out.write(unpacker.decompress(rest))
            if unpacker.eof:
                rest = unpacker.unused_data
                break
            rest = stream.read(1 << 20)
            if not rest:
                raise ValueError("an archive ends within a record")
        data = out.getvalue()
        head, _, body = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = body[: int(headers["Content-Length"])]
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
        yield headers, block


# ---------------------------------------------------------------- writing


class RollingFiles:
    """Files of one shard, closed by compressed size, renamed when whole."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.part, self.out = shard, roll_bytes, 0, None
        self.done: list[tuple] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/pages-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.temporary = f"{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            name = self.name.rpartition("/")[2]
            self._write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", name, "")), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, self.name)
            self.done.append((self.name, self.shard, self.part, self.records, self.size, self.sha.hexdigest()))
            self.out, self.part = None, self.part + 1


def ordered_bytes(number: Column) -> Column:
    """A long as bytes that sort as it does."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def place_of(page_id: Column, digest: Column, url: Column) -> Column:
    """The order of records, as bytes: null page_ids, then page_id, digest and a hash of the URL."""
    own = F.when(page_id.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), ordered_bytes(F.coalesce(page_id.cast("bigint"), F.lit(0).cast("bigint")))))
    return F.concat(own, digest, ordered_bytes(F.xxhash64(url)))


def with_starts(groups: DataFrame) -> tuple[DataFrame, int]:
    """``groups`` (place, weight, ...) with ``start``, the sum of all weights before, written, and the sum of all."""
    spark = groups.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(groups.repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id()), "ranges")
    sums = sorted((r["part"], r["w"]) for r in ranged.groupBy("part").agg(F.sum("weight").alias("w")).collect())  # a row a range
    bases, total = [], 0
    for part, w in sums:
        bases.append((part, total))
        total += w
    base = spark.createDataFrame(bases, "part int, base long")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("start", F.coalesce(F.sum("weight").over(before), F.lit(0))).join(F.broadcast(base), "part")
    return written(running.withColumn("start", F.col("start") + F.col("base")).drop("part", "base"), "starts"), total


def divided(a: Column, b) -> Column:
    """a / b rounded up."""
    return F.ceil(a.cast("decimal(38,0)") / F.lit(b).cast("decimal(38,0)") if isinstance(b, int) else a.cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("bigint")


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all pages below ``folder`` (a URI every executor can write) and return the manifest."""
    require_columns(pages, "page_id", "url", "html")
    id_type = pages.schema["page_id"].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"page_id must be an integer; got {id_type}")
    spark = pages.sparkSession
    bounded_batches(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.unhex(F.sha2(payload, 256))
    place = place_of(F.col("page_id"), digest, F.col("url"))
    rows = pages.select("page_id", "url", payload.alias("payload"), place.alias("place"))
    narrow = pages.select(place.alias("place"), "page_id", F.octet_length(payload).cast("bigint").alias("size"), digest.alias("digest"))
    groups = narrow.groupBy("place").agg(F.first("page_id").alias("page_id"), F.first("size").alias("size"), F.first("digest").alias("digest"), F.count("*").alias("n"))
    started, total = with_starts(groups.withColumn("weight", F.col("n") * (F.col("size") + HEAD_BYTES)))

    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    each = F.col("size") + HEAD_BYTES
    first, last = F.floor(F.col("start") / shard_bytes).cast("int"), F.floor((F.col("start") + (F.col("n") - 1) * each) / shard_bytes).cast("int")
    placed = started.withColumns({"first": first, "last": last})
    # a row a shard: its first place
    edges = sorted((bytes(r["place"]), r["shard"]) for r in placed.groupBy(F.col("first").alias("shard")).agg(F.min("place").alias("place")).collect())
    names, shards = [e for e, _ in edges], total // shard_bytes + 1
    numbers = [n for _, n in edges]

    @F.arrow_udf("int")
    def shard_of(places: pa.Array) -> pa.Array:
        return pa.array([numbers[bisect_right(names, p) - 1] for p in places.to_pylist()], pa.int32())

    # a group that ends in another shard than it begins in has several equal rows: no more of them than shards
    low = F.greatest(F.col("shard") * F.lit(shard_bytes).cast("bigint") - F.col("start"), F.lit(0).cast("bigint"))
    high = F.least((F.col("shard") + 1) * F.lit(shard_bytes).cast("bigint") - F.col("start"), F.col("n") * each)
    wide = placed.where("first < last").withColumn("shard", F.explode(F.sequence("first", "last")))
    wide = written(wide.withColumn("copies", (divided(high, each) - divided(low, each)).cast("int")).where("copies > 0").select("place", "shard", "copies", "first"), "wide")
    records = rows
    if cut := bool(wide.take(1)):
        records = rows.join(F.broadcast(wide.select("place").distinct()), "place", "left_anti")
    records = records.select("place", "page_id", "url", "payload", shard_of("place").alias("shard"), F.lit(1).alias("copies"))
    if cut:
        folded = rows.join(F.broadcast(wide.select("place").distinct()), "place").groupBy("place").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("payload").alias("payload"))
        records = records.unionByName(folded.join(F.broadcast(wide.drop("first")), "place"))

    # equal payloads: what refers to what, and the place that comes first of all
    shared = started.where(f"size >= {int(revisit_bytes)} AND page_id IS NOT NULL")
    equal = shared.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min("place").alias("lead"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    marks = written(shared.join(equal, "digest").select("place", "refers_to", (F.col("place") == F.col("lead")).alias("lead"), "start", "n", "size"), "revisits")
    in_one = marks.withColumn("first", first).select("place", "refers_to", "lead", "first").join(F.broadcast(wide.select("place", "shard")), "place", "left")
    lines = in_one.select("place", F.coalesce("shard", "first").alias("shard"), "refers_to", (F.col("lead") & (F.coalesce("shard", "first") == F.col("first"))).alias("lead"))

    empty = {"page_id": id_type, "url": "string", "payload": "binary", "copies": "int"}
    dealt = records.select("shard", "place", F.lit(1).alias("kind"), *empty, F.lit(None).cast(id_type).alias("refers_to"), F.lit(None).cast("boolean").alias("lead"))
    dealt = dealt.unionByName(lines.select("shard", "place", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "refers_to", "lead"))
    ordered = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "kind", "url", "payload")
    at, folder_path = fs.FileSystem.from_uri(folder)
    at.create_dir(folder_path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, marked, refers_to, lead = None, None, None, False
        done: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for shard, own, kind, page_id, url, body, copies, to, leads in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    if files is None or files.shard != shard:
                        if files:
                            files.close()
                            done += files.done
                        files, marked = RollingFiles(folder, shard, roll_bytes), None
                    if kind == 0:
                        marked, refers_to, lead = own, to, leads
                        continue
                    for _ in range(copies):
                        response = marked != own or lead
                        lead = False if marked == own else lead
                        files.add(page_record(page_id, url, body, None if response else refers_to))
        if files:
            files.close()
            done += files.done
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 6, [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["path", "shard", "part", "records", "compressed_bytes", "sha256"])

    return written(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """All page records of the files a manifest lists; a revisit's payload is null."""
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(folder)
        schema = None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with place.open_input_stream(path, compression=None) as stream:
                    for h, block in read_records(stream):
                        if h["WARC-Type"] not in ("response", "revisit"):
                            continue
                        response = h["WARC-Type"] == "response"
                        body = block.partition(b"\r\n\r\n")[2] if response else None
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if response and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
                        url = None if "X-Null-Uri" in h else h["WARC-Target-URI"]
                        rows.append((h["X-Page-Id"] or None, url, h["WARC-Type"], h.get("X-Refers-To-Page-Id"), int(h["X-Payload-Length"]), digest, body))
                        held += len(body or b"")
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield to_batch(rows)
                            rows, held = [], 0
                yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    found = manifest.select("path").repartition(min(files, 10_000)).mapInArrow(read, RECORDS.format(id="string"))
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    folder = shared_path(spark, "warc")
    manifest = write_archives(pages, folder, **options)
    return read_archives(manifest, folder, pages.schema["page_id"].dataType.simpleString())
