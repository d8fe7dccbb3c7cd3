"""The speakers of a review: each takes a table of one row a question and adds what it says.

Prompts are plain text: a line with the role, then what the speaker is given.  Answers are JSON, read with
all the stages of ``functions.salvage``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import salvage
from ..functions import text as fx
from ..models import Generator, generated

CITES = "array<struct<case_name:string,court:string,year:int,holding:string,self_confidence:double,reporter_cite:string>>"
SAID = f"struct<stage:int,argument:string,citations:{CITES},challenge:double,concede:boolean,gaps:array<string>,queries:array<string>,quality:double,verdict:string,confidence:double>"


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _number(value, default: float) -> float:
    try:
        return min(max(float(value), 0.0), 1.0)
    except (TypeError, ValueError):
        return default


def _texts(value) -> list[str]:
    if isinstance(value, str):
        return [value] if value else []
    return [x for x in value if isinstance(x, str) and x] if isinstance(value, list) else []


def read_answer(raw: str | None) -> tuple:
    """What an answer says, by the names a generator was asked for; citations without a name are left out."""
    found, stage = salvage.salvage(raw)
    listed = next((found[k] for k in ("citations", "counter_citations", "verified_citations") if isinstance(found.get(k), list)), [])
    cites = []
    for c in listed:
        if isinstance(c, dict) and _text(c.get("case_name")).strip():
            year = c.get("year")
            cites.append((c["case_name"].strip(), _text(c.get("court")), year if isinstance(year, int) else 0, _text(c.get("holding")), _number(c.get("self_confidence"), 0.5), _text(c.get("reporter_cite") or c.get("citation"))))
    said = _text(found.get("argument")) or _text(found.get("counter_argument")) or _text(found.get("text"))
    confidence = found.get("confidence", found.get("overall_confidence"))
    return (stage, said, cites, _number(found.get("challenge_strength"), 0.0), found.get("concede") is True, _texts(found.get("gaps")), _texts(found.get("targeted_queries")), _number(found.get("argument_quality"), 0.5), _text(found.get("verdict")), _number(confidence, 0.0))


def answered(raw: Column) -> Column:
    names = [f.name for f in T._parse_datatype_string(SAID).fields]

    @F.pandas_udf(SAID)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_answer(t) for t in texts], columns=names)

    return read(raw)


def prompt_of(role: str, given: Column, ask: str = "") -> Column:
    """A line with the role, one with what is asked if anything, then what the speaker is given."""
    return F.concat(F.lit(f"{role}\n" + (f"{ask}\n" if ask else "")), F.coalesce(given, F.lit("")))


def says(rows: DataFrame, role: str, given: Column, make: Callable[[], Generator], *keep: str) -> DataFrame:
    """``rows`` (keep, ...) with ``said``, a speaker's answer read.  Where there is nothing to read, the fallback prompt asks for JSON only."""
    prompt, fallback = prompt_of(role, given), prompt_of(role, given, "Answer with one JSON object only.")
    return rows.select(*keep, answered(generated(prompt, fallback, make)).alias("said"))


def passages_of(evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, passages) of evidence (key, rank, case_name, year, text): numbered lines in the order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "case_name", "year", "text")))
    return evidence.groupBy(key).agg(ordered.alias("_d")).select(key, fx.passages(F.col("_d")).alias("passages"))


def report_of(scores: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, report) of scores (key, ordinal, case_name, ccs, tier)."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "case_name", "ccs", "tier")))
    return scores.groupBy(key).agg(ordered.alias("_s")).select(key, fx.report_lines(F.col("_s")).alias("report"))


def citations_of(said: DataFrame, agent: str) -> DataFrame:
    """(query_id, agent, place, case_name, reporter_cite, holding): a row a citation of said (query_id, said)."""
    each = said.select("query_id", F.posexplode("said.citations").alias("place", "c"))
    return each.select("query_id", F.lit(agent).alias("agent"), "place", fx.clean_name(F.col("c.case_name")).alias("case_name"), "c.reporter_cite", "c.holding").where("case_name <> ''")
