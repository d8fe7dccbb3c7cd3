"""The best match of a block, with bounds, is that of all candidates without."""

import random

import pytest

from plumbline.functions import fuzzy


@pytest.mark.parametrize("token_sets", [False, True])
def test_bounds_lose_nothing(token_sets):
    rng = random.Random(4)
    words = ["case", "state", "v.", "ohio", "smith", "a-b", "x", "doe's", "12", "é"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(120)] + ["", "  ", "case case", "Case"]
    block = fuzzy._Catalog(sorted(set(names)))
    asked = names[:40] + [n.upper() for n in names[:10]] + ["", "nothing like", "case 12x", "imaginary case 3 v. nobody"]
    for name in asked:
        def score(c, name=name):
            shared = set(fuzzy._word_set(name)) & set(fuzzy._word_set(c))
            return max(fuzzy.ratio(name, c), fuzzy.token_set_ratio(name, c)) if token_sets and shared else fuzzy.ratio(name, c)

        expected = min(((-score(c), c) for c in block.names))
        assert block.best(name, token_sets) == (-expected[0], expected[1])


@pytest.mark.parametrize("token_sets", [False, True])
def test_floors_lose_nothing_and_save_comparisons(spark, monkeypatch, token_sets):
    monkeypatch.setattr(fuzzy, "BLOCK_NAMES", 16)
    held = [f"case {i}" for i in range(120)] + ["ab c", "c abd", "case", ""]
    asked = ["case 17x", "imaginary case 33 v. nobody", "case 1 19", "ab cd", "zzz", "", "c  ab", "case " * 60, "x" * 250]
    names, catalog = (spark.createDataFrame([(n,) for n in rows], "name string") for rows in (asked, held))
    whole = fuzzy._Catalog(held)
    found = {r["name"]: (r["ratio"], r["best"]) for r in fuzzy.best_matches(names, catalog, token_sets).collect()}
    assert found == {n: whole.best(n, token_sets) for n in asked}
    floors = {r["name"]: r["floor"] for r in fuzzy._floors(names, catalog.withColumnRenamed("name", "entry"), token_sets).collect()}
    assert floors["case 17x"] == found["case 17x"][0] and floors["zzz"] == -1
    # a block without a better name compares none
    compared = []
    ratio = fuzzy.ratio
    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: compared.append(b) or ratio(a, b))
    assert fuzzy._Catalog([f"case {i}" for i in range(20, 90)]).best("case 17x", token_sets, floors["case 17x"]) is None and len(compared) <= 6
