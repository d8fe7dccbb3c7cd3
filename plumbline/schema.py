"""Row types.  Text columns use "" and numbers 0 where a source has nothing; only support may be null."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CITES = T.ArrayType(_struct(cite=STRING))
DOCUMENT = _struct(
    doc_id=STRING, text=STRING, source=STRING, case_name=STRING, year=INT, court=STRING, volume=STRING, reporter=STRING, first_page=INT,
    decision_date=STRING, docket=STRING, citations=CITES, authority_identity=STRING,
)
CHUNK = _struct(
    doc_id=STRING, text=STRING, parent_doc_id=STRING, chunk_index=INT, word_start=INT, word_end=INT, case_name=STRING, year=INT, court=STRING,
    volume=STRING, reporter=STRING, first_page=INT, citations=CITES,
)
CITATION = _struct(case_name=STRING, court=STRING, year=INT, holding=STRING, self_confidence=DOUBLE, agent_source=STRING, reporter_cite=STRING)
SCORE = _struct(query_id=LONG, agent=STRING, ordinal=INT, case_name=STRING, existence=DOUBLE, support=DOUBLE, ccs=DOUBLE, tier=STRING, match_type=STRING, evidence=STRING)
CASE = _struct(id=INT, topic=STRING, query=STRING, jurisdiction=STRING, target_case=STRING, ground_truth_holding=STRING, reporter_citation=STRING)
PAIR = _struct(id=INT, topic=STRING, q1=STRING, q2=STRING)
TURN = _struct(query_id=LONG, round=INT, role=STRING, argument=STRING, detail=STRING)
VOTE = _struct(pair_id=INT, query_no=INT, case_name=STRING)
RAW_CASE = _struct(
    id=STRING, name_abbreviation=STRING, name=STRING, court=_struct(name=STRING), decision_date=STRING, first_page=STRING, volume=STRING, volume_number=STRING,
    reporter=STRING, docket_number=STRING, citations=CITES, casebody=_struct(head_matter=STRING, opinions=T.ArrayType(_struct(text=STRING)), text=STRING),
)
