"""Runs against all stretches of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import periodic
from plumbline.llm.common import table
from plumbline.llm.queries import QUERIES
from tests.conftest import DATA


def brute(words, least=12):
    """(start, length, period) of every run, by start, then period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if i > s and length >= max(least, 2 * q) and not any(all(words[x] == words[x + r] for x in range(s, s + length - r)) for r in range(1, q) if q % r == 0):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def altered(i, words):
    h = zlib.crc32(str(i).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_registered(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, f"{DATA}/sf0.001", "documents").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, f"{DATA}/sf0.001").collect()}
    assert set(got) == set(rows)
    some = 0
    for i, text in rows.items():
        words = altered(i, [w.decode() for w in text.encode().split()])
        if len(words) > 1500:
            continue
        runs, r = brute(words), got[i]
        some += len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best), i
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
    assert some > 10


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_arrays_together(letters):
    rng = random.Random(letters)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 2, 5, 13, 40, 110])
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 9)
                words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            texts.append(words)
        for least in (2, 12):
            got = periodic.runs_of([np.array(t, dtype=np.int64) for t in texts], least).tolist()
            assert sorted(map(tuple, got)) == sorted((k, *r) for k, t in enumerate(texts) for r in brute(t, least))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [fibonacci(400), [0] * 300, list(range(300)), list(range(300, 0, -1)), [*range(50)] * 8, [0, 1] * 100 + [2] + [1, 0] * 100])
def test_extreme_texts(words):
    got = periodic.runs_of([np.array(words, dtype=np.int64)]).tolist()
    assert sorted(tuple(r[1:]) for r in got) == sorted(brute(words))


def test_nulls_long_texts_repeats_and_clashing_names(spark):
    long = " ".join(str(i % 997) for i in range(60_000))
    rows = [(1, None), (None, "a b"), (3, ""), (4, " \n\t"), (5, "a " * 20), (5, "a " * 20), (6, long), (7, "x " + "ä b\x0bc " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("Runs", "collapsed", "start", "_row")})
    found = periodic.find_runs(docs)
    assert sorted(c.lower() for c in found.columns) == ["_row", "collapsed", "doc_id", "runs", "start", "text"]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=str)
    once = " ".join(map(str, range(997)))
    expected = [(1, [], ""), (None, [], "a b"), (3, [], ""), (4, [], ""), (5, [(0, 20, 1)], "a"), (5, [(0, 20, 1)], "a"), (6, [(0, 60_000, 997)], once), (7, [(1, 18, 3)], "x ä b c")]
    assert got == sorted(expected, key=str)
    assert periodic.find_runs(docs.limit(0)).collect() == []


def test_next_beyond():
    rng = np.random.default_rng(1)
    for values in (rng.permutation(500), np.arange(500), np.arange(500)[::-1].copy(), np.concatenate([[0], np.arange(400, 1, -1)])):
        expected = [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in range(len(values))]
        assert periodic.next_beyond(values).tolist() == expected


def test_range_minima():
    rng = np.random.default_rng(2)
    for n in (1, 2, 15, 16, 17, 200):
        values = rng.integers(0, 1000, n)
        a, b = rng.integers(0, n, 400), rng.integers(0, n, 400)
        a, b = np.minimum(a, b), np.maximum(a, b)
        assert periodic.RangeMinimum(values).of(a, b).tolist() == [values[x : y + 1].min() for x, y in zip(a, b, strict=True)]
