"""Trigram queries of expressions whose spellings overflow."""

import pytest

from plumbline.llm import secrets
from tests.llm.test_operators import docs_of

PATTERN = r"k([a-c0-2][a-c0-2][a-c0-2])z"


@pytest.mark.parametrize(("pattern", "samples"), [(PATTERN, ["kabcz", "k012z"]), (r"q(?:[a-f][a-f][a-f]){2}z", ["qabcdefz"]), (r"(ab|cd)([a-f][a-f][a-f])xyz", ["abfffxyz"])])
def test_overflow_within_a_group(pattern, samples):
    query = secrets.trigram_query(pattern)
    for text in samples:
        assert any(all(g in text for g in clause) for clause in query)


def test_scan_finds_the_overflowing_group(spark):
    rule = secrets.Rule("own", PATTERN)
    [row] = secrets.scan_secrets(docs_of(spark, ["see kabcz here"]), (rule,)).collect()
    assert [tuple(h) for h in row["hits"]] == [(4, 0, 9)]
