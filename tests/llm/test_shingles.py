"""The near-duplicate stage of the pipeline against brute force over sets of five-word shingles."""

import random

import corpus_pipeline
import numpy as np

from plumbline.llm import shingles
from tests.llm.test_operators import LONG, TEXTS, brute_components, docs_of, texts  # noqa: F401


def brute_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute_kept(every):
    sets = [brute_set(t) for t in every]

    def alike(a, b):
        return len(a & b) >= 0.8 * len(a | b)

    return sorted(set(brute_components(range(len(every)), [(j, i) for i in range(len(every)) for j in range(i) if alike(sets[i], sets[j])]).values()))


def changed(words, rng, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def test_planted_copies_with_words_changed(spark, texts):  # noqa: F811
    rng = random.Random(8)
    every = [*TEXTS, *texts]
    for k in range(20):
        words = [f"w{k}x{rng.randrange(500)}" for _ in range(rng.randrange(60, 400))]
        every += [" ".join(words), *[changed(words, rng, n) for n in (1, 1 + len(words) // 60, 2 + len(words) // 40, len(words) // 15)]]
    group = [f"g{i}" for i in range(200)]
    every += [changed(group, rng, 1 + i % 6) for i in range(150)]
    df = docs_of(spark, every, extra=True)
    kept = corpus_pipeline.far_apart(spark, df, None)
    assert kept.columns == df.columns
    expected = brute_kept(every)
    assert sorted(r["doc_id"] for r in kept.collect()) == expected and len(expected) < len(every) - 100


def test_pairs_that_the_hub_does_not_link(spark):
    # one key holds them all, but only the last two are alike
    base = [f"b{i}" for i in range(100)]
    every = ["x y z", " ".join(base), " ".join([*base, "end"])]
    rows = docs_of(spark, every).coalesce(1).sort("doc_id").selectExpr("struct(*) as _row", "array(7L) as keys")
    links = shingles.similar_links(shingles.numbered(rows))
    assert [(r["a"], r["b"]) for r in links.collect()] == [(1, 2)]


def test_rows_of_one_text(spark):
    same = shingles.dedup_similar(docs_of(spark, ["a", "A", "a "], ids=[7, 7, None]))
    assert [r["doc_id"] for r in same.collect()] == [7]
    assert shingles.dedup_similar(docs_of(spark, [])).count() == 0
    assert shingles.dedup_similar(docs_of(spark, ["a", None], ids=[None, None])).count() == 2


def test_keys_meet_as_often_as_said():
    rng, bands, met = random.Random(3), shingles.Bands(), 0
    for _ in range(200):
        shared = [rng.randbytes(8) for _ in range(80)]
        a, b = ({*shared, *[rng.randbytes(8) for _ in range(10)]} for _ in range(2))
        met += bool(np.any(bands.keys(a) == bands.keys(b)))
    assert met == 200 and shingles.similarity(shingles.shingles(LONG.encode()), shingles.shingles(LONG.upper().encode())) == 1


def test_a_group_of_copies_that_are_not_alike_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with many words changed share keys in pairs without number, but are compared with few."""
    rng, seen = random.Random(5), []
    base = [f"b{i}" for i in range(150)]
    every = [changed(base, rng, 12) for _ in range(300)] + [changed(base, rng, 2) for _ in range(60)]
    written = shingles.written
    monkeypatch.setattr(shingles, "written", lambda df, name: (seen.append((name, (out := written(df, name)).count())), out)[1])
    kept = shingles.dedup_similar(docs_of(spark, every))
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(every)
    assert sum(n for name, n in seen if name in ("hub-pairs", "prefix-pairs", "prefix-rest")) < 20 * len(every)


def test_close_fingerprints_are_compared_first(spark, monkeypatch):
    prints = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, -1), (5, 0b1011), (6, -4)], "id long, fp long")
    assert sorted((r["a"], r["b"]) for r in shingles.print_pairs(prints).collect()) == [(1, 2), (1, 3), (3, 5), (4, 6)]
    # texts of no common band meet by their fingerprints
    rng = np.random.default_rng(1)
    monkeypatch.setattr(shingles, "still_apart", lambda bands, links: bands.where("false").select("id"))
    monkeypatch.setattr(shingles, "hub_pairs", lambda keyed: keyed.where("false").selectExpr("id as a", "id as b"))
    every = [" ".join(f"w{i}" for i in rng.integers(0, 900, 400)) for _ in range(4)]
    every += [every[0].replace(" ", "\n"), every[1] + " ", every[2].upper()]
    assert sorted(r["doc_id"] for r in shingles.dedup_similar(docs_of(spark, every)).collect()) == [0, 1, 2, 3]
