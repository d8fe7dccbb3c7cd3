"""The catalog of known authorities and selections of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LANDMARK_VOLUMES
from ..functions import text as fx
from ..functions.places import first_place, pattern

# The patterns by which a document names its volume.
NUMBER_FIELD = r"""['"]?volume_number['"]?\s*:\s*['"]?([0-9]+)['"]?"""
US_CITE = r"(?i)([0-9]+)\s+U\.?\s*S\.?"
DOC_VOLUME = r"(?i)(?:vol_?|CAP_?)([0-9]+)"


def known_catalog(docs: DataFrame) -> DataFrame:
    """(kind, name): names, ``volume reporter page`` and cites of docs, distinct, without empty ones."""
    named = docs.select(F.lit("name").alias("kind"), fx.stripped(F.col("case_name")).alias("name"))
    placed = docs.where("first_page > 0 AND volume <> ''").select(F.lit("cite").alias("kind"), fx.reporter_cite(F.col("volume"), F.col("reporter"), F.col("first_page")).alias("name"))
    cited = docs.select(F.lit("cite").alias("kind"), F.explode(F.transform("citations", lambda c: fx.stripped(c["cite"]))).alias("name"))
    return named.unionByName(placed).unionByName(cited).where("name <> ''").distinct()


def parse_volumes(selection: str) -> list[str]:
    """Volumes of a selection: landmark, modern, all, a range a-b, a list, or one.

    A dash decides before commas do, as long as both ends are numbers; the order of a list is kept.
    """
    chosen = selection.strip().lower()
    if chosen == "landmark":
        return list(LANDMARK_VOLUMES)
    presets = {"modern": (300, 585), "all": (1, 600)}
    low, dash, high = chosen.partition("-")
    if chosen in presets or (dash and low.strip().isdigit() and high.strip().isdigit()):
        first, last = presets.get(chosen) or (int(low), int(high))
        return [str(v) for v in range(first, last + 1)]
    return [v.strip() for v in chosen.split(",") if v.strip()]


def volume_place(volume: Column, metadata: Column, cites: Column, doc_id: Column, case_name: Column, text: Column) -> Column:
    """(place, value): the volume of a document and where it is named; both "" if nowhere.

    ``volume`` and ``metadata`` (the volume among the metadata) are numbers or texts of a record with a volume_number,
    ``cites`` an array of texts, of which the first that cites a volume counts; ``text`` is read to its 200th character.
    """
    rules = []
    for place, value in (("volume", volume), ("metadata", metadata)):
        told = fx.stripped(F.coalesce(value.cast("string"), F.lit("")))
        rules += [(f"{place}_record", pattern(told, NUMBER_FIELD)), (place, pattern(told, r"^([0-9]+)$"))]
    cited = F.filter(F.transform(cites, lambda c: pattern(c, US_CITE)), lambda v: v != "")
    sample = F.concat(F.coalesce(case_name, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 200))
    return first_place([*rules, ("cites", F.get(cited, F.lit(0))), ("doc_id", pattern(doc_id, DOC_VOLUME)), ("text", pattern(sample, US_CITE))])


def volume_of(volume: Column, cite: Column, doc_id: Column, text: Column) -> Column:
    """The volume of a document that has one cite and no metadata, from wherever it is named, else ""."""
    nothing = F.lit(None).cast("string")
    return volume_place(volume, nothing, F.array(cite), doc_id, nothing, text)["value"]


def cited_volume(cite: Column) -> Column:
    """The volume a cite begins with, else ""."""
    return F.regexp_extract(F.coalesce(cite, F.lit("")), r"^\s*(\d+)\s", 1)


def of_volumes(docs: DataFrame, volumes: list[str]) -> DataFrame:
    """The documents of the chosen volumes: a literal filter, so partitions by volume are pruned."""
    return docs.where(F.col("volume").isin(*volumes))


def missing_volumes(requested: DataFrame, landed: DataFrame) -> DataFrame:
    return requested.join(landed, "volume", "left_anti")
