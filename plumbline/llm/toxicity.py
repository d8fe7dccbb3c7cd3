"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has three grades: 0 clean, 1 toxic, 2 heavily toxic.  Labels say toxic
or not.  Which toxic training texts are of grade 2 is told by other texts: the
training rows are dealt into two halves by a checksum of the text, a model of
two grades is fitted on each, and the toxic texts of the other half that it puts above
their median get grade 2.  So no text is graded by weights it was fitted with.

The model is P(grade > k) = s(w x - t_k) with one weight vector w for both
ordered thresholds t_0 < t_1; expected severity is the sum of both
probabilities, and a text is toxic when P(grade > 0) reaches 0.5.

Features are words and their first four to eight bytes (stems, for inflected
languages).  Document frequencies by label are counted over the training rows;
features in enough toxic texts and with high odds are ranked by their log
odds over its standard error and the first MOST_FEATURES are kept.  The value of
a feature is the root of how often a hundred words hold it, so that a long text is
not toxic for one chance word.  As features tell of toxicity, weights are not negative.

Fitting uses at most ``sample`` distinct texts of each class; everything that is scored is scored whole.

Null text counts as empty, and scores like a text without any telling word.
Labels that are null, or whose doc_id is null, are not learned from; several
labels of a doc_id count one by one.  Without rows of both classes nothing is toxic and the severity is 0.
Repeated rows are scored one by one.  Other columns pass, but for those
named like the new ones.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, bounded_batches, byte_values, hold, labelled_texts, require_columns, row_columns, scratch, slices, text_bytes
from .decontaminate import words_of

SAMPLE = 6000
MOST_FEATURES = 1024
LEAST_Z = 2.5
#: Words of either class alike say little, however many there are: least log odds.
LEAST_ODDS = 2.0
#: Of the toxic texts, the share that must hold a feature, and the least number.
LEAST_SHARE, LEAST_DOCS = 0.005, 4
CACHED_WORDS = 100_000
#: Rates are taken over the words of a text and as many more.
EXTRA_WORDS = 30
STEM_BYTES = (4, 5, 6, 7, 8)


def features_of(word: bytes) -> list[bytes]:
    """The word itself and its stems; stems end in a byte no word holds."""
    return [word, *(word[:n] + b"*" for n in STEM_BYTES if len(word) > n)]


@dataclass
class OrdinalModel:
    index: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([30.0, 60.0]))

    def __post_init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"index": self.index, "weights": self.weights, "thresholds": self.thresholds, "known": {}}

    def counts(self, text: bytes) -> tuple[dict[int, int], int]:
        """Counts by feature, and number of words."""
        words, found = words_of(text), {}
        known = self.known
        for w in words:
            ids = known.get(w)
            if ids is None:
                if len(known) > CACHED_WORDS:
                    known.clear()
                ids = known[w] = tuple(self.index[f] for f in features_of(w) if f in self.index)
            for i in ids:
                found[i] = found.get(i, 0) + 1
        return found, len(words)

    def vector(self, text: bytes) -> tuple[list[int], list[float]]:
        found, words = self.counts(text)
        return list(found), [(100.0 * n / (words + EXTRA_WORDS)) ** 0.5 for n in found.values()]

    def passes(self, text: bytes) -> np.ndarray:
        """P(grade > 0), P(grade > 1)."""
        ids, values = self.vector(text)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - float(self.weights[ids] @ np.asarray(values)), -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _fitted(labelled_texts(docs, labels, "toxic", sample))


def _fitted(rows: DataFrame) -> OrdinalModel:
    """A model of rows (text, toxic)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        for batch in batches:
            for part in slices(batch, 0, 256 << 10):
                found: dict[bytes, list[int]] = {}
                for text, toxic in zip(byte_values(part.column(0)), part.column(1).to_pylist(), strict=True):
                    for f in {f for w in set(words_of(text)) for f in features_of(w)}:
                        found.setdefault(f, [0, 0])[toxic] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([c[0] for c in found.values()], pa.int64()), pa.array([c[1] for c in found.values()], pa.int64())], names=["feature", "clean", "toxic"])

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return OrdinalModel()
    counts = rows.mapInArrow(features, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    c, t, nc, nt = F.col("c"), F.col("t"), totals[0], totals[1]
    odds = F.log((t + 0.5) / (nt - t + 0.5)) - F.log((c + 0.5) / (nc - c + 0.5))
    z = odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    best = counts.where(t >= max(LEAST_DOCS, LEAST_SHARE * nt)).where(odds >= LEAST_ODDS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(MOST_FEATURES)
    model = OrdinalModel({bytes(r["feature"]): i for i, r in enumerate(best.collect())})
    if not model.index:
        return OrdinalModel()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(byte_values(batch.column(0)))
            found = [model.vector(text) for text in texts]
            halves = [zlib.crc32(text) & 1 for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(halves, pa.int32()), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], names=["toxic", "half", "ids", "values"])

    # at most 2 * sample sparse rows
    train = sorted(tuple(r) for r in rows.mapInArrow(vectors, "toxic int, half int, ids array<int>, values array<float>").collect())
    x = np.zeros((len(train), len(model.index)), dtype=np.float32)
    for row, (_, _, ids, values) in enumerate(train):
        x[row, ids] = values
    model.weights, model.thresholds = fit_ordinal(x, graded(x, *(np.array([r[i] for r in train]) for i in (0, 1))))
    return model


def graded(x: np.ndarray, toxic: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 of training rows; a half without rows of both classes leaves the other's at 1."""
    grade = toxic.copy()
    for own in (0, 1):
        learn, ask = half == own, np.flatnonzero((half != own) & (toxic == 1))
        if len(ask) and len(set(toxic[learn].tolist())) == 2:
            weights, _ = fit_ordinal(x[learn], toxic[learn], grades=2)
            s = x[ask] @ weights.astype(np.float32)
            grade[ask[s > np.median(s)]] = 2
    return grade


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = 3, steps: int = 400, rate: float = 0.1, ridge: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative weights and increasing thresholds by projected gradient ascent (Adam) on the likelihood of the grades."""
    n, d = x.shape
    share = [min(max(float(np.mean(grade > k)), 1e-3), 1 - 1e-3) for k in range(grades - 1)]
    start = np.array([np.log((1 - s) / s) for s in share])
    # thresholds are a first one and logarithms of the gaps, so they stay in order
    theta = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[d + 1 :])
        cut = theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = x @ theta[:d].astype(np.float32)
        above = 1.0 / (1.0 + np.exp(np.clip(cut[None, :] - s[:, None], -60, 60)))  # P(grade > k)
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        p = np.maximum(edges[np.arange(n), grade] - edges[np.arange(n), grade + 1], 1e-9)
        slope = above * (1 - above)
        slopes = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], axis=1)
        upper, lower = slopes[np.arange(n), grade] / p, slopes[np.arange(n), grade + 1] / p
        ds = (upper - lower) / n
        dcut = np.zeros(grades - 1)
        np.add.at(dcut, np.maximum(grade - 1, 0), np.where(grade > 0, -upper, 0) / n)
        np.add.at(dcut, np.minimum(grade, grades - 2), np.where(grade < grades - 1, lower, 0) / n)
        tail = np.cumsum(dcut[::-1])[::-1]
        g = np.concatenate([x.T @ ds.astype(np.float32) - ridge * theta[:d], tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        np.maximum(theta[:d], 0.0, out=theta[:d])
    return theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])


NEW = ("severity", "p_toxic", "p_severe", "grade", "toxic")


def _scored(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    require_columns(docs, "text")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES features

    @F.arrow_udf("severity double, p_toxic double, p_severe double, grade int, toxic boolean")
    def score(texts: pa.Array) -> pa.Array:
        hold("toxicity")
        m = shared.value
        p = np.array([m.passes(text) for text in byte_values(texts)]).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p >= 0.5).sum(axis=1).astype("int32")), pa.array(p[:, 0] >= 0.5)], names=list(NEW))

    return docs.select(as_row(docs), score(text_bytes()).alias("s")).select("_row", "s.*")


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with severity (0 to 2), p_toxic, p_severe, grade and toxic."""
    return _scored(docs, model).select(*row_columns(docs, *NEW), *NEW)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not toxic by a model fitted on ``labels``; all columns as they are."""
    return _scored(docs, fit(docs, labels, sample)).where("NOT toxic").select(*row_columns(docs))
