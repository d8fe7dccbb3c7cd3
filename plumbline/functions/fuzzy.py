"""Similarity of names: ratios from 0 to 100 and best matches in a catalog.

``ratio`` is 100 * (1 - d / (m + n)) with d the number of insertions and
deletions that turn one string into the other, rounded; ``token_set_ratio``
compares sorted sets of words.  Spark's ``levenshtein`` lies between d / 2 and
d, so 1 - levenshtein / (m + n) bounds the ratio from above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..storage import written

#: Catalog names that one task compares at a time.
BLOCK_NAMES = 2000
#: Letters up to which a name is looked up less a letter and by its words in a row; longer ones are only compared.
LONG_NAME = 200


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def ratio(a: str | None, b: str | None) -> int:
    a, b = a or "", b or ""
    total = len(a) + len(b)
    return round(200.0 * common_length(a, b) / total) if total else 0


def _word_set(text: str | None) -> list[str]:
    return sorted(set(re.findall(r"\w+", (text or "").lower())))


def token_set_ratio(a: str | None, b: str | None) -> int:
    """Best ratio among the shared words, and the shared words with the rest of either side."""
    left, right = _word_set(a), _word_set(b)
    if not left or not right:
        return 0
    shared = " ".join(w for w in left if w in right)
    first = " ".join(filter(None, [shared, " ".join(w for w in left if w not in right)]))
    second = " ".join(filter(None, [shared, " ".join(w for w in right if w not in left)]))
    pairs = [(first, second)] + ([(shared, first), (shared, second)] if shared else [])
    return max(ratio(x, y) for x, y in pairs)


@F.pandas_udf(IntegerType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(IntegerType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(IntegerType())
def shared_words_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio, or that of sets of words if it is higher and they share one."""
    return pd.Series([max(ratio(x, y), token_set_ratio(x, y)) if set(_word_set(x)) & set(_word_set(y)) else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def edit_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - levenshtein / longer length), rounded: a ratio that SQL has too."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0)).otherwise(F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longer), 0)).cast("int")


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of ``ratio`` / 100."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / total)


def _pairs_of_letters(names: DataFrame) -> DataFrame:
    """(name, gram) for distinct names: neighbouring letters, each with the number of its occurrence."""
    split = names.select("name", F.explode(F.when(F.length("name") > 1, F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substr("name", i, F.lit(2))))).alias("gram"))
    counted = split.groupBy("name", "gram").agg(F.count("*").cast("int").alias("n"))
    return counted.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat("gram", i.cast("string")))).alias("gram"))


def near_pairs(names: DataFrame, entries: DataFrame, loss: float) -> DataFrame:
    """(name, entry), distinct and not equal: pairs that may be alike, by equal keys only.

    Two names that are alike lose at most the share ``loss`` of the longer one's pairs of letters, so each keeps
    m - 1 - loss m of them, one at least.  Pairs are ordered by how many names hold them, rare ones first; then
    two such names share a pair among the first of each, as many as it may lose and one.  Common pairs of letters join nothing.
    """
    sides = {"name": names.select("name"), "entry": entries.select(F.col("entry").alias("name"))}
    grams = {k: _pairs_of_letters(df.where("name IS NOT NULL").distinct()) for k, df in sides.items()}
    held = grams["name"].unionByName(grams["entry"]).groupBy("gram").agg(F.count("*").alias("df"))
    lost = F.least(F.floor(F.lit(loss) * F.length("name") + 1e-9), F.length("name") - 2)
    first = F.row_number().over(Window.partitionBy("name").orderBy("df", "gram")) <= lost + 1
    keys = {k: g.join(held, "gram").withColumn("first", first).where("first").select(F.col("name").alias(k), "gram") for k, g in grams.items()}
    return keys["name"].join(keys["entry"], "gram").where("name <> entry").select("name", "entry").distinct()


def edit_loss(threshold: float) -> float:
    """``loss`` of names whose ``edit_ratio`` rounds to ``threshold`` or more: an edit touches two pairs of letters."""
    return 2.0 * (1.0 - (threshold - 0.5) / 100.0)


def ratio_loss(threshold: float) -> float:
    """``loss`` of names whose ``ratio`` rounds to ``threshold`` or more: letters the longer one has alone touch two pairs each."""
    t = (threshold - 0.5) / 100.0
    return 2.0 * (1.0 - t / (2.0 - t))


class _Catalog:
    """Names of a block with their letters and words counted, to leave out those that cannot win."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.sizes, self.bags = self._counted(self.names)
        words = [_word_set(n) for n in self.names]
        self.set_sizes, self.set_bags = self._counted([" ".join(w) for w in words])
        at: dict[str, list[int]] = {}
        for i, some in enumerate(words):
            for w in some:
                at.setdefault(w, []).append(i)
        self.having = {w: np.array(i) for w, i in at.items()}

    @staticmethod
    def _bag(name: str) -> np.ndarray:
        return np.bincount(np.frombuffer(name.encode("utf-16-le"), dtype=np.uint16) % 64, minlength=64).astype(np.int16)

    def _counted(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(n) for n in names], dtype=np.int64), np.stack([self._bag(n) for n in names]) if names else np.zeros((0, 64), dtype=np.int16)

    def _bound(self, name: str, sizes: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """At least the ratio of ``name`` with each: letters in common, whatever their order."""
        shared = np.minimum(bags, self._bag(name)).sum(axis=1)
        return np.rint(200.0 * shared / np.maximum(sizes + len(name), 1))

    def best(self, name: str, token_sets: bool, floor: int = -1) -> tuple[int, str] | None:
        """The best name of the block and its score; None if all are below ``floor``."""
        bound, sharing = self._bound(name, self.sizes, self.bags), np.zeros(len(self.names), dtype=bool)
        if token_sets:
            words = _word_set(name)
            whole = " ".join(words)
            common = np.zeros(len(self.names))
            for w in words:
                if (at := self.having.get(w)) is not None:
                    common[at] += len(w) + 1
            sharing, common = common > 0, np.maximum(common - 1, 0)
            # the shared words begin either side, so their ratio with it is known; the sides' own is bounded by their letters
            ends = 200.0 * common / np.maximum(common + np.minimum(len(whole), self.set_sizes), 1)
            bound = np.where(sharing, np.maximum(bound, np.maximum(np.rint(ends), self._bound(whole, self.set_sizes, self.set_bags))), bound)
        best, match = floor, None
        open_ = np.flatnonzero(bound >= floor)
        for i in open_[np.argsort(-bound[open_], kind="stable")]:
            if bound[i] < best:
                break
            candidate = self.names[i]
            score = max(ratio(name, candidate), token_set_ratio(name, candidate)) if sharing[i] else ratio(name, candidate)
            if score > best or (score == best and (match is None or candidate < match)):
                best, match = score, candidate
        return None if match is None else (best, match)


def _floors(asked: DataFrame, entries: DataFrame, token_sets: bool) -> DataFrame:
    """(name, floor): what one catalog name or another reaches, so that no name below it need be compared; -1 where none is found.

    Names meet entries that equal them less a letter or, for sets of words, that are some of their words in a row, by joins.
    """
    n, name, none = F.length("name"), F.col("name"), F.array().cast("array<string>")
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1, n)))
    keys = F.when((n > 1) & (n <= LONG_NAME), less).otherwise(none)
    if token_sets:
        words = F.split(name, " ")
        runs = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda k: F.array_join(F.slice(words, i, k), " ")))
        keys = F.concat(keys, F.when((n <= LONG_NAME) & (F.size(words) <= LONG_NAME // 10), F.flatten(runs)).otherwise(none))
    met = asked.select("name", F.explode(F.array_distinct(keys)).alias("entry")).join(entries, "entry")
    score = shared_words_udf("name", "entry") if token_sets else ratio_udf("name", "entry")
    found = met.groupBy("name").agg(F.max(score).alias("floor"))
    return asked.join(found, "name", "left").select("name", F.coalesce("floor", F.lit(-1)).alias("floor"))


def best_matches(names: DataFrame, catalog: DataFrame, token_sets: bool = False) -> DataFrame:
    """(name, best, ratio): the best catalog name of each distinct ``name``; ties go to the first in order.

    Both sides are dealt into blocks of about BLOCK_NAMES; each pair of blocks is one unit of
    work and the best of all wins.  Neither side is collected.  A floor for each name, from equal keys, lets most
    blocks tell by letters counted alone that they hold nothing better.
    """
    blocks = catalog.select(F.col("name").alias("entry")).where("entry IS NOT NULL").distinct()
    asked = names.select("name").where("name IS NOT NULL").distinct()
    asked = written(_floors(asked, blocks, token_sets), "asked-names")
    count, parts = (max(1, -(-x.count() // BLOCK_NAMES)) for x in (blocks, asked))
    blocks = blocks.groupBy(F.pmod(F.xxhash64("entry"), F.lit(count)).alias("block")).agg(F.collect_list("entry").alias("entries"))
    pairs = blocks.crossJoin(asked.groupBy(F.pmod(F.xxhash64("name"), F.lit(parts)).alias("part")).agg(F.collect_list("name").alias("names"), F.collect_list("floor").alias("floors")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for entries, asked_names, floors in zip(batch["entries"], batch["names"], batch["floors"], strict=True):
                block = _Catalog(list(entries))
                found = [(n, *best) for n, floor in zip(asked_names, floors, strict=True) if (best := block.best(n, token_sets, floor))]
                yield pd.DataFrame(found, columns=["name", "ratio", "best"])

    each = pairs.select("entries", "names", "floors").mapInPandas(compare, "name string, ratio int, best string")
    winner = F.min_by(F.struct("best", "ratio"), F.struct(-F.col("ratio"), F.col("best")))
    return each.groupBy("name").agg(winner.alias("w")).select("name", "w.best", "w.ratio")
