"""Similar names by rare pairs of letters lose none that all pairs would find."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import fuzzy
from plumbline.operators import metrics, verify


def some_names(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        name = "".join(rng.choice("abcd e") for _ in range(rng.randrange(0, 24)))
        out.add(name)
        for _ in range(2):
            if name:
                at = rng.randrange(len(name))
                name = rng.choice([name[:at] + name[at + 1 :], name[:at] + "z" + name[at:], name[:at] + "q" + name[at + 1 :]])
                out.add(name)
    return sorted(out)[:n]


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def sides(spark):
    a, b = some_names(150, 1), some_names(220, 2) + some_names(40, 1)
    return a, b, spark.createDataFrame([(x,) for x in a], "name string"), spark.createDataFrame([(x,) for x in b], "name string")


def test_edit_candidates(sides):
    a, b, names, catalog = sides
    expected = {(x, y) for x in a for y in set(b) if x and y and round(1 - brute_edit(x, y) / (len(x) + len(y)), 6) >= 0.85}
    got = verify.edit_candidates(names, catalog, 0.85)
    assert {(r["name"], r["candidate"]) for r in got.where("name <> ''").collect()} == expected and len(expected) > 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("measure", [None, fuzzy.edit_ratio])
def test_kinds(sides, measure):
    a, b, names, catalog = sides
    got = {r["key"]: r["kind"] for r in metrics.classify_names(names, catalog, measure=measure).collect()}
    held = {x.strip() for x in b} - {""}

    def alike(x, y):
        if measure is None:
            return fuzzy.ratio(x, y) >= 85
        return int(100 * (1 - brute_edit(x, y) / max(len(x), len(y))) + 0.5) >= 85

    expected = {x.strip(): x.strip() in held or any(alike(x.strip(), y) for y in held) for x in a}
    assert {k: v == "KNOWN" for k, v in got.items()} == expected | {"": False}
    assert 0 < sum(expected.values()) < len(expected)
    df = metrics.classify_names(names, catalog, measure=measure)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and df.where(F.col("key") == "").first()["kind"] == "FABRICATED"
