"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built, one from fragments of texts labelled 1 and one from
those labelled 0.  A text is compressed in blocks with each; the difference of
the two sizes over the text's length says which dictionary knows it better.
Logistic regression on labelled rows that the dictionaries have not seen turns
the difference into a score from 0 to 1.

Learning uses a bounded sample: at most ``sample`` distinct labelled texts of each class
and use, those of the smallest hashes, of which at most FRAGMENTS
fragments of FRAGMENT_BYTES make a dictionary.  Texts that are scored are
compressed whole.  Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have difference zero.  Labels that are null, or whose
doc_id is null, are not learned from.  Without labels of both classes every
score is the share of label 1 among those there are, or 0.5.  Repeated rows are
scored one by one.  Other columns pass, but for those named like the new ones.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, bounded_batches, byte_values, hold, labelled_texts, require_columns, row_columns, text_bytes

SAMPLE = 4000
FRAGMENTS, FRAGMENT_BYTES = 4000, 2048
DICTIONARY_BYTES = 32 << 10
BLOCK_BYTES = 512
LEVEL = 1
THRESHOLD = 0.7


def coder(dictionary: bytes):
    """One compressor per Python worker and dictionary; the digested dictionary belongs to it alone."""

    def make():
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    return hold("quality", dictionary, make)


@dataclass
class CompressionModel:
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    offset: float = 0.0

    def difference(self, text: bytes) -> float:
        """(size under the bad dictionary - size under the good one) / length."""
        if not text or not self.good:
            return 0.0
        good, bad = coder(self.good).compress, coder(self.bad).compress
        total = 0
        for at in range(0, len(text), BLOCK_BYTES):
            block = text[at : at + BLOCK_BYTES]
            total += len(bad(block)) - len(good(block))
        return total / len(text)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.offset, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionModel:
    """A model of the labelled rows; a third of them calibrates, the others make the dictionaries."""
    import zstandard

    bounded_batches(docs.sparkSession)
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    good, bad = totals.get(1, 0), totals.get(0, 0)
    prior = float(np.log((good + 0.5) / (bad + 0.5)))

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, quality in zip(byte_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                cut = [text[at : at + FRAGMENT_BYTES] for at in range(0, len(text), FRAGMENT_BYTES)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array([quality] * len(cut), pa.int32())], names=["fragment", "quality"])

    pieces = labelled_texts(docs, known.where(part != 0), "quality", sample).mapInArrow(fragments, "fragment binary, quality int").where(F.octet_length("fragment") >= 16)
    dictionaries = []
    for c in (1, 0):
        # at most FRAGMENTS * FRAGMENT_BYTES bytes
        rows = pieces.where(F.col("quality") == c).select("fragment").distinct().orderBy(F.xxhash64("fragment"), "fragment").limit(FRAGMENTS).collect()
        samples = [bytes(r["fragment"]) for r in rows]
        try:
            dictionaries.append(zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes())
        except zstandard.ZstdError:  # too few samples to train: they are the dictionary themselves
            dictionaries.append(b"".join(samples)[:DICTIONARY_BYTES])
    model = CompressionModel(*dictionaries, offset=prior)
    if not good or not bad or not all(dictionaries):
        return CompressionModel(offset=prior)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.difference(t) for t in byte_values(batch.column(0))], pa.float64()), batch.column(1)], names=["difference", "quality"])

    # at most 2 * sample numbers
    rows = sorted(tuple(r) for r in labelled_texts(docs, known.where(part == 0), "quality", sample).mapInArrow(differences, "difference double, quality int").collect())
    if rows:
        weight = np.array([totals[c] / max(1, sum(r[1] == c for r in rows)) for c in (0, 1)])
        model.slope, model.offset = fit_logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), weight, prior)
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method with a slight ridge, each class weighted to its share of all labels."""
    w = weight[y] / weight[y].sum() * len(y)
    design, theta = np.stack([x, np.ones_like(x)], axis=1), np.array([0.0, prior])
    ridge = np.diag([1e-4, 1e-6])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ theta, -60, 60)))
        g = design.T @ (w * (y - p)) - ridge @ theta
        h = (design * (w * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(h, g)
        theta = theta + step * min(1.0, 20.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-8:
            break
    return float(theta[0]), float(theta[1])


NEW = ("difference", "score", "predicted")


def score_quality(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with difference, score and predicted (1 where the score reaches ``threshold``)."""
    require_columns(docs, "text")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    @F.arrow_udf("difference double, score double, predicted int")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        d = np.array([m.difference(t) for t in byte_values(texts)], dtype=np.float64)
        s = m.score(d)
        return pa.StructArray.from_arrays([pa.array(d), pa.array(s), pa.array((s >= threshold).astype("int32"))], names=list(NEW))

    return docs.select(as_row(docs), score(text_bytes()).alias("s")).select(*row_columns(docs, *NEW), "s.*")


def fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``remainder``; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
