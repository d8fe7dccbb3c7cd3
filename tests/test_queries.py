"""Every registered query against DuckDB on the smallest tables; those without SQL must give rows."""

from collections import Counter

import pytest

from plumbline.plans import registry
from tests.conftest import DATA, plain

SF = "sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, f"{DATA}/{SF}")
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    found, expected = duck(SF, SQL[name])
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in expected)
