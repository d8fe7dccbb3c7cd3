"""Raw case records into documents, and stored tables.

Nothing is fetched over a network here: records are read where another job
landed them, one JSON array or line-delimited file a volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as fx
from ..functions.places import first_place
from ..schema import DOCUMENT, RAW_CASE


def landed_volumes(spark: SparkSession, folder: str, least_bytes: int = 10) -> DataFrame:
    """(volume, path, bytes) of the volume files below a folder that hold anything; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.regexp_extract("path", r"(\d+)[^/]*\.json$", 1).alias("volume"), "path", F.col("length").alias("bytes"))
    return rows.where((F.col("bytes") > least_bytes) & (F.col("volume") != ""))


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw records with the fixed schema; records that do not fit it come as nulls."""
    return spark.read.schema(RAW_CASE).json(path, multiLine=multi_line)


def body_text(body: Column) -> Column:
    """Head matter and opinions, those that are not empty, a blank line between; else the plain text."""
    opinions = F.transform(F.coalesce(body["opinions"], F.array().cast("array<struct<text:string>>")), lambda o: o["text"])
    parts = F.filter(F.concat(F.array(body["head_matter"]), opinions), lambda x: F.coalesce(x, F.lit("")) != "")
    return fx.stripped(fx.first_of(F.array_join(parts, "\n\n"), body["text"]))


def case_url(record: dict[str, Column], volume: Column, base: str) -> Column:
    """(place, value): the address of a record's own file, and the field that told it; a record without one fails the job.

    Fields that ``record`` lacks are null.  In this order: three addresses; ``url`` if it ends in .json; that of the
    body; three file names, below the volume unless they are addresses; the first page as a padded number.
    """
    at = {name: record.get(name, F.lit(None)).cast("string") for name in ("casebody_url", "case_url", "download_url", "url", "body_url", "case_file_name", "file_name", "filename", "first_page", "id")}
    folder = F.concat(F.lit(f"{base}/us/"), volume, F.lit("/cases/"))

    def file(name: Column) -> Column:
        whole = F.when(name.endswith(".json"), name).otherwise(F.concat(name, F.lit(".json")))
        return F.when(F.coalesce(name, F.lit("")) != "", F.when(name.startswith("http"), name).otherwise(F.concat(folder, F.ltrim(whole, F.lit("/")))))

    page = F.when(fx.stripped(at["first_page"]).rlike(r"^[+-]?[0-9]+$"), F.format_string("%04d", fx.stripped(at["first_page"]).try_cast("bigint")))
    rules = [(name, at[name]) for name in ("casebody_url", "case_url", "download_url")]
    rules += [("url", F.when(at["url"].endswith(".json"), at["url"])), ("body_url", at["body_url"])]
    rules += [(name, file(at[name])) for name in ("case_file_name", "file_name", "filename")]
    rules += [("first_page", F.concat(folder, page, F.lit("-01.json")))]
    return first_place(rules, F.raise_error(F.concat(F.lit("no file is named by record "), F.coalesce(at["id"], F.lit("")))))


def parse_cases(raw: DataFrame, volume: str = "", least_chars: int = DEFAULTS.min_text_chars) -> DataFrame:
    """Documents of raw records; bodies shorter than ``least_chars`` are left out."""
    text = body_text(F.col("casebody"))
    rows = raw.withColumn("text", text).where(F.length("text") >= least_chars)
    key = F.coalesce("id", F.lit(""))
    doc_id = F.concat_ws("::", F.lit("CAP"), key, fx.sha_prefix(F.concat(key, F.col("text")), 24))
    cites = F.coalesce("citations", F.array().cast("array<struct<cite:string>>"))
    name = fx.first_of(F.col("name_abbreviation"), F.col("name"))
    vol = fx.first_of(F.col("volume"), F.col("volume_number"), F.lit(volume))
    page = fx.whole_number(F.col("first_page"))
    reporter = fx.first_of(F.col("reporter"))
    found = {
        "doc_id": doc_id, "text": F.col("text"), "source": F.lit("CAP"), "case_name": name, "year": fx.year_of_date(F.col("decision_date")), "court": fx.first_of(F.col("court")["name"]),
        "volume": vol, "reporter": reporter, "first_page": page, "decision_date": fx.first_of(F.col("decision_date")), "docket": fx.first_of(F.col("docket_number")),
        "citations": cites, "authority_identity": fx.first_of(F.get(cites, F.lit(0))["cite"], name),
    }
    return rows.select(*[found[f.name].cast(f.dataType).alias(f.name) for f in DOCUMENT])


def complete_cases(listed: DataFrame, full: DataFrame) -> DataFrame:
    """Listed records, each column from the full record (same id) where that has one; those whose body is empty go."""
    right = full.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in full.columns if c != "id"])
    joined = listed.join(right, "id", "left")
    out = joined.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in joined.columns else F.col(c) for c in listed.columns])
    return out.where(body_text(F.col("casebody")) != "") if "casebody" in out.columns else out


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the volumes that ``chunks`` holds and leave the others: a portion can be built again by itself."""
    chunks.write.partitionBy("volume").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def not_yet(portion: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is left to do of a job that was stopped."""
    return portion.join(stored.select(key).distinct(), key, "left_anti")


def manifest(chunks: DataFrame, source: str, license_name: str) -> DataFrame:
    """One row: volumes, number of chunks and a digest of the content that does not depend on files or order."""
    each = F.sha2(F.concat_ws("\x1f", "chunk_id", "text").cast("binary"), 256)
    # sums of the four quarters of each digest: the same in any order
    quarters = [F.sum(F.conv(F.substring(each, 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    digest = F.sha2(F.concat_ws(":", *quarters, F.count("*").cast("string")).cast("binary"), 256)
    return chunks.agg(F.array_sort(F.collect_set("volume")).alias("volumes"), F.count("*").alias("n_chunks"), digest.alias("sha256")).withColumns({"source": F.lit(source), "license": F.lit(license_name), "created_at": F.current_timestamp()})


def multiple_choice(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows (label, endings, ...) with answer, the ending the label names, or ""."""
    return rows.limit(limit).withColumn("answer", F.coalesce(F.get("endings", F.col("label")), F.lit("")))


def subtasks(tasks: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """The first rows of each task under its name; columns a task lacks are null."""
    parts = [df.limit(limit).withColumn("subtask", F.lit(name)) for name, df in tasks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def store_metadata(docs: DataFrame, source: str | None = None) -> DataFrame:
    """Documents with scalar columns only, for stores that take no others: lists as JSON, null as "".

    A column ``metadata`` (a map of texts) is not kept but replaces the columns its keys name; ``source``, if
    given, replaces that column in the end.
    """
    more = F.col("metadata") if "metadata" in docs.columns else None

    def flat(f) -> Column:
        own = F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name).cast("string")
        value = own if more is None else F.coalesce(F.try_element_at(more, F.lit(f.name)), own)
        return F.coalesce(F.lit(source) if source is not None and f.name == "source" else value, F.lit("")).alias(f.name)

    return docs.select(*[flat(f) for f in docs.schema if f.name != "metadata"])


def merge_vectors(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """An upsert of vectors: new rows replace old ones of their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
