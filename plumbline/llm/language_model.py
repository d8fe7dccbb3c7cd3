"""Language-model scores: smoothed unigrams and a log-bilinear model.

Tokens are words lower-cased in A-Z, cut at ASCII white space, and one end per
text.  Counts are taken over all training texts.

The log-bilinear model predicts a token from the CONTEXT tokens before it (ends, before a text's first):
their vectors, each times a matrix of its distance, add up to h.  Its units are the words seen LEAST_COUNT times or more, the most
frequent MOST_WORDS at most, the end, and TAIL_UNITS units of all other words by their last bytes; within
such a unit a word has its smoothed share of the unit's count, with room for words never seen.  Units are put into
classes of about the root of their number by falling counts, and
P(unit) = P(class) P(unit of the class), where both factors are the exponentials of h . q + b over all classes, and over the
units of the class.  So batches of matrix products give normalised log-probabilities at the cost of two roots.

Both factors are trained in numpy by noise-contrastive estimation: each observed token is told apart from CLASS_NOISE classes
drawn by their counts, and from NOISE units of its own class drawn by theirs; the tokens of a step share what is drawn.  A start is made on
the driver from the first START_BYTES of at most START_TEXTS texts; from it every task trains on all its texts, so every training text is
learned from, and the parameters are averaged row by row, each by how often the tasks used it.  Texts are learned from a slice of an Arrow batch
at a time, a very long one whole.

Counts of at most HEAD of the most frequent words travel with the scoring tasks; all other
words of a text are joined to the table of counts, so memory is bounded and every
count is exact.

Null text counts as empty: it has one token, the end.  A null doc_id is in the
training part.  Without training tokens N and V are zero, no token is known and the
base score is that of the formula.  Repeated rows are counted and scored one by one.
Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_values, hold, require_columns, slices, written

CONTEXT = 3
DIMENSION = 16
MOST_WORDS, LEAST_COUNT = 1 << 14, 5
TAIL_UNITS = 256
NOISE, CLASS_NOISE = 32, 64
#: Texts the start on the driver is made from, and how much of each.
START_TEXTS, START_BYTES = 1000, 16 << 10
MINIBATCH = 4096
#: Tokens of a class that are multiplied at once.
GROUP = 24
#: Tokens scored at once, and those put in the order of classes before.
CHUNK, PIECE = 2048, 1 << 17
RATE = 0.1
HEAD = 100_000
#: Distinct words a counting task holds before it passes their counts on.
HELD_WORDS = 300_000
SMOOTHING = 0.1


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_UNITS


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass
class Lexicon:
    """The most frequent words by falling count; the first ``single`` are units of their own."""

    words: list[bytes]
    counts: np.ndarray
    single: int

    def __post_init__(self) -> None:
        self.index: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "counts": self.counts, "single": self.single, "index": {}}

    def prepare(self) -> Lexicon:
        """Lookup tables, made once where they are used."""
        if self.words and not self.index:
            self.index = {w: i for i, w in enumerate(self.words)}
            self.units = np.array([i if i < self.single else self.single + tail_of(w) for i, w in enumerate(self.words)], dtype=np.int64)
            self.log_counts = np.log10(self.counts + SMOOTHING)
        return self

    def classify(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head number (-1: none) and unit of every word."""
        head = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        outside = np.flatnonzero(head < 0)
        units = self.units[head] if self.words else np.empty(len(words), dtype=np.int64)
        units[outside] = self.single + np.fromiter((zlib.crc32(words[i][-2:]) for i in outside.tolist()), dtype=np.int64, count=len(outside)) % TAIL_UNITS
        return head, units


def logistic(x: np.ndarray) -> np.ndarray:
    return falling(-x)


def falling(x: np.ndarray) -> np.ndarray:
    """``logistic(-x)`` in the place of ``x``, which counts as 30 at most."""
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.divide(1.0, x, out=x)


def log_sum(s: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials by row."""
    if s.max(initial=0.0) < 60:  # no exponential overflows
        total = np.exp(s).sum(axis=1)
        if total.min(initial=1.0) > 1e-30:  # nor is a row's largest lost
            return np.log(total)
    top = s.max(axis=1)
    return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


def log_share(h: np.ndarray, columns: np.ndarray, own: np.ndarray) -> np.ndarray:
    """By row of ``h`` the logarithm of what the exponential of its product with column ``own`` is of those with all columns."""
    s = h @ columns
    mine = s.ravel().take(np.arange(len(s)) * s.shape[1] + own)
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.exp(s, out=s).sum(axis=1)  # equal rows get equal sums wherever they stand
    if total.min(initial=1.0) > 1e-30 and total.max(initial=1.0) < 1e30:
        return mine - np.log(total)
    return mine - log_sum(h @ columns)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)


def summed(rows: np.ndarray, columns: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of some rows of a table of ``size`` in order, and the sums of what ``columns``, a line each, say of them."""
    at = np.flatnonzero(np.bincount(rows, minlength=size))
    number = np.empty(size, dtype=np.int64)
    number[at] = np.arange(len(at))
    own = number[rows]
    sums = np.empty((len(at), len(columns)), dtype=np.float32)
    for i, column in enumerate(columns):
        sums[:, i] = np.bincount(own, column, len(at))
    return at, sums


class LogBilinear:
    """Parameters of the model over units in the order of falling counts, and how to train them.

    ``context`` and ``unit`` hold a vector a unit, ``classes`` one a class, ``matrices`` one matrix a distance; the last
    number of a unit's or a class's row is its bias.
    """

    NAMES = ("context", "unit", "classes", "matrices")

    def __init__(self, counts: np.ndarray, seed: int = 5):
        """``counts``: of every unit, by its number."""
        order = np.argsort(-counts, kind="stable")
        self.size = len(counts)
        self.place = np.empty(self.size, dtype=np.int64)
        self.place[order] = np.arange(self.size)
        self.width = max(1, round(self.size**0.5))
        self.weights = counts[order] + 0.5
        self.class_of = np.arange(self.size) // self.width
        self.sums = np.concatenate([[0.0], np.cumsum(self.weights)])
        mass = np.bincount(self.class_of, weights=self.weights)
        self.chance = mass / mass.sum()
        rng, d = np.random.default_rng(seed), DIMENSION
        self.context = rng.normal(0, 0.1, (self.size, d)).astype(np.float32)
        self.unit = np.column_stack([rng.normal(0, 0.1, (self.size, d)), np.log(self.weights / mass[self.class_of])]).astype(np.float32)
        self.classes = np.column_stack([rng.normal(0, 0.1, (len(mass), d)), np.log(self.chance)]).astype(np.float32)
        self.matrices = np.concatenate([np.eye(d) / (j + 1) for j in range(CONTEXT)]).astype(np.float32)
        self.squares = {name: np.full(getattr(self, name).shape, 1e-4, dtype=np.float32) for name in self.NAMES}
        self.noise: dict[str, np.ndarray] = {}

    def line(self, units: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all tokens of some texts, an end after each, and those of the CONTEXT tokens before each."""
        stop = self.place[end]
        texts = [np.append(self.place[u], stop) for u in units]
        padded = [np.concatenate([np.full(CONTEXT, stop), t]) for t in texts]
        before = [np.stack([p[CONTEXT - 1 - j : len(p) - 1 - j] for j in range(CONTEXT)], axis=1) for p in padded]
        return (np.concatenate(texts), np.concatenate(before)) if texts else (np.zeros(0, dtype=np.int64), np.zeros((0, CONTEXT), dtype=np.int64))

    def hidden(self, before: np.ndarray) -> np.ndarray:
        return self.read(before) @ self.matrices

    def read(self, before: np.ndarray) -> np.ndarray:
        """The vectors of the tokens before each, side by side."""
        return self.context.take(before.ravel(), axis=0).reshape(len(before), -1)

    def log_probs(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities."""
        if not len(tokens):
            return np.zeros(0)
        n = len(tokens)
        h = np.concatenate([self.hidden(before), np.ones((n, 1), dtype=np.float32)], axis=1)
        c = self.class_of[tokens]
        out = np.empty(n)
        for a in range(0, n, CHUNK):  # products that stay in a core's cache
            out[a : a + CHUNK] = log_share(h[a : a + CHUNK], self.classes.T, c[a : a + CHUNK])
        order = np.argsort(tokens.astype(np.uint16) if self.size < 1 << 16 else tokens, kind="stable")
        ordered, own = h.take(order, axis=0), tokens[order]
        starts = runs(self.class_of[own])
        inside = np.empty(n)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            first = int(self.class_of[own[a]]) * self.width
            rows = self.unit[first : first + self.width].T
            for i in range(a, b, CHUNK):
                j = min(i + CHUNK, b)
                inside[i:j] = log_share(ordered[i:j], rows, own[i:j] - first)
        out[order] += inside
        return out

    def _move(self, name: str, at: np.ndarray, g: np.ndarray) -> None:
        """A step of the distinct rows ``at`` of a parameter by their slopes."""
        table, squares = getattr(self, name), self.squares[name]
        moved = squares.take(at, axis=0)
        moved += g * g
        squares[at] = moved
        np.divide(g, np.sqrt(moved, out=moved), out=moved)
        moved *= RATE
        moved += table.take(at, axis=0)
        table[at] = moved

    def drawing(self) -> dict[str, np.ndarray]:
        """What the noise is drawn by and weighed with; it stays while the parameters move."""
        if not self.noise:
            firsts = np.arange(len(self.chance)) * self.width
            low, high = self.sums[firsts], self.sums[np.minimum(firsts + self.width, self.size)]
            share = np.log(NOISE * self.weights / (high - low)[self.class_of]).astype(np.float32)
            self.noise = {"low": low, "room": high - low, "share": share, "shift": np.log(CLASS_NOISE * self.chance).astype(np.float32), "upto": np.cumsum(self.chance) / np.cumsum(self.chance)[-1]}
        return self.noise

    def step(self, tokens: np.ndarray, before: np.ndarray, rng: np.random.Generator) -> None:
        n, d, drawing = len(tokens), DIMENSION, self.drawing()
        # a step is a sum over its tokens: those of a class, and equal ones, may stand together
        order = np.argsort(tokens.astype(np.uint16) if self.size < 1 << 16 else tokens, kind="stable")
        tokens, before = tokens[order], before.take(order, axis=0)
        read = self.read(before)
        h1 = np.ones((n, d + 1), dtype=np.float32)
        np.matmul(read, self.matrices, out=h1[:, :d])
        # classes: noise drawn once for all tokens of the step
        c = self.class_of[tokens]
        times = np.bincount(drawing["upto"].searchsorted(rng.random(CLASS_NOISE), side="right"), minlength=len(self.chance))
        noise = np.flatnonzero(times)
        shift, mine = drawing["shift"], self.classes.take(c, axis=0)
        hit = logistic(shift[c] - np.einsum("ij,ij->i", h1, mine))
        # noise with its sign turned and its bias shifted, so that products are what ``falling`` takes
        own, count = -self.classes[noise], times[noise].astype(np.float32)[:, None]
        own[:, -1] += shift[noise]
        miss = falling(h1 @ own.T)
        slope = hit[:, None] * mine[:, :-1]
        slope += miss @ (own[:, :-1] * count)
        starts = runs(c)
        here, many = c[starts], np.diff(starts, append=n)
        class_slopes = np.zeros_like(self.classes)
        class_slopes[here] = np.add.reduceat(hit[:, None] * h1, starts, axis=0)
        class_slopes[noise] -= miss.T @ h1 * count
        # units: noise drawn once for all tokens of a class
        share, q = drawing["share"], self.unit.take(tokens, axis=0)
        hit = logistic(share[tokens] - np.einsum("ij,ij->i", h1, q))
        slope += hit[:, None] * q[:, :-1]
        drawn = np.searchsorted(self.sums, drawing["low"][here, None] + np.sort(rng.random((len(here), NOISE)), axis=1) * drawing["room"][here, None], side="right") - 1
        drawn = np.clip(drawn, (here * self.width)[:, None], np.minimum((here + 1) * self.width, self.size)[:, None] - 1)
        # tokens of a class meet its noise GROUP at a time; places that no token takes read zeros
        groups = -(-many // GROUP)
        kind, firsts = np.repeat(np.arange(len(here)), groups), np.cumsum(groups) - groups
        spot = np.arange(n) - np.repeat(starts - firsts * GROUP, many)
        tokens_at = np.zeros((len(kind) * GROUP, d + 1), dtype=np.float32)
        tokens_at[spot] = h1
        tokens_at = tokens_at.reshape(-1, GROUP, d + 1)
        own = -self.unit.take(drawn, axis=0)
        own[:, :, -1] += share[drawn]
        own = own.take(kind, axis=0)
        away = falling(tokens_at @ own.transpose(0, 2, 1))
        slope += (away @ own[:, :, :-1]).reshape(-1, d).take(spot, axis=0)
        pushed = away.transpose(0, 2, 1) @ tokens_at
        pulls = np.empty((d + 1, n + len(kind) * NOISE))
        np.multiply(h1.T, hit, out=pulls[:, :n])
        np.negative(pushed.reshape(-1, d + 1).T, out=pulls[:, n:])
        self._move("unit", *summed(np.concatenate([tokens, drawn[kind].ravel()]), pulls, self.size))
        self._move("classes", np.arange(len(self.classes)), class_slopes)
        back = np.empty((d, CONTEXT, n))
        back[...] = (self.matrices @ slope.T).reshape(CONTEXT, d, n).transpose(1, 0, 2)
        self._move("matrices", np.arange(CONTEXT * d), read.T @ slope)
        self._move("context", *summed(before.T.ravel(), back.reshape(d, -1), self.size))

    def learn(self, units: list[np.ndarray], end: int, rng: np.random.Generator) -> np.ndarray:
        """Steps over all tokens of some texts in a drawn order; the tokens' places and those read for them."""
        tokens, before = self.line(units, end)
        order = rng.permutation(len(tokens))
        for at in range(0, len(order), MINIBATCH):
            i = order[at : at + MINIBATCH]
            self.step(tokens[i], before[i], rng)
        return tokens


def training(held_out: Column | None) -> Column:
    return F.lit(True) if held_out is None else ~held_out


def count_words(texts: DataFrame) -> DataFrame:
    """(token, n), several rows a token; the end is the empty token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                held.update(chain.from_iterable(map(words_of, byte_values(part.column(0)))))
                held[b""] += part.num_rows
                if len(held) > HELD_WORDS:
                    yield to_batch(held)
                    held = Counter()
        if held:
            yield to_batch(held)

    def to_batch(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

    return texts.mapInArrow(count, "token binary, n long")


ROW = ", ".join(f"v{i} double" for i in range(DIMENSION + 1))


def train_apart(texts: DataFrame, lexicon, start, end: int) -> DataFrame:
    """(name, row, used, v0, ...): what each task made of the rows of the parameters it used, times how often it did."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language_model")
        known, model = lexicon.value.prepare(), copy.deepcopy(start.value)
        used = {"context": np.zeros(model.size), "unit": np.zeros(model.size), "classes": np.zeros(len(model.classes)), "matrices": np.zeros(len(model.matrices))}
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                split = [words_of(t) for t in byte_values(part.column(0))]
                _, units = known.classify(list(chain.from_iterable(split)))
                cuts = np.cumsum([len(w) for w in split])[:-1]
                # the order of steps depends on the texts alone
                tokens = model.learn(np.split(units, cuts), end, np.random.default_rng(zlib.crc32(part.column(0)[0].as_py() or b"")))
                seen = np.bincount(tokens, minlength=model.size)
                used["context"] += seen
                used["unit"] += seen
                used["classes"] += np.bincount(model.class_of[tokens], minlength=len(model.classes))
                used["matrices"] += len(tokens)
        for k, name in enumerate(LogBilinear.NAMES):
            rows = np.flatnonzero(used[name])
            n = used[name][rows]
            values = getattr(model, name)[rows].astype(np.float64) * n[:, None]
            columns = [pa.array(values[:, i] if i < values.shape[1] else np.zeros(len(rows))) for i in range(DIMENSION + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, dtype=np.int32)), pa.array(rows.astype(np.int32)), pa.array(n), *columns], names=["name", "row", "used", *[f"v{i}" for i in range(DIMENSION + 1)]])

    return texts.mapInArrow(train, f"name int, row int, used double, {ROW}")


def train(learn: DataFrame, lexicon: Lexicon, shared, counts: np.ndarray) -> LogBilinear:
    """The model of training texts (text): a start on the driver, then the mean of what the tasks made of it."""
    model, end = LogBilinear(counts), len(counts) - 1
    context = learn.sparkSession.sparkContext
    hashed = F.xxhash64("text")
    hashes = learn.select(hashed.alias("h")).distinct().orderBy("h").limit(START_TEXTS)
    first = learn.join(F.broadcast(hashes), hashed == F.col("h")).select("h", F.substring("text", 1, START_BYTES).alias("text")).distinct().orderBy("h").limit(START_TEXTS)
    texts = sorted(bytes(r["text"] or b"") for r in first.collect())  # START_TEXTS texts of START_BYTES at most
    rng, known = np.random.default_rng(7), lexicon.prepare()
    for at in range(0, len(texts), 100):
        model.learn([known.classify(words_of(t))[1] for t in texts[at : at + 100]], end, rng)
    start = context.broadcast(model)
    apart = train_apart(learn, shared, start, end)
    sums = apart.groupBy("name", "row").agg(F.sum("used").alias("used"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIMENSION + 1)]).toArrow()  # the rows of one model
    names, rows, used = (sums.column(c).to_numpy() for c in ("name", "row", "used"))
    values = np.stack([sums.column(f"v{i}").to_numpy() for i in range(DIMENSION + 1)], axis=1) / np.maximum(used, 1)[:, None] if len(names) else np.zeros((0, DIMENSION + 1))
    for k, name in enumerate(LogBilinear.NAMES):
        table, mine = getattr(model, name), names == k
        # digits that the order of addition cannot reach
        table[rows[mine]] = np.round(values[mine][:, : table.shape[1]], 6)
    model.squares, model.noise = {}, {}
    return model


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most HEAD words by falling count: those of the highest sixteenths of an octave of counts that fit."""
    octave = F.floor(F.log2(F.col("c").cast("double")) * 16)
    left, least = HEAD, None
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect(), reverse=True):  # about a thousand rows at most
        left -= r["n"]
        if left < 0:
            break
        least = r["o"]
    if least is None:
        return []
    return sorted(((bytes(r["token"]), r["c"]) for r in counts.where(octave >= least).collect()), key=lambda x: (-x[1], x[0]))


@dataclass
class Fitted:
    """What scoring needs: counts of all tokens (a written table), the frequent ones, the model, and totals."""

    counts: DataFrame
    lexicon: Lexicon
    model: LogBilinear
    tail: np.ndarray
    n: int
    v: int
    ends: int


def fit(docs: DataFrame, held_out: Column | None = None) -> Fitted:
    """Of the rows where ``held_out`` is not true."""
    require_columns(docs, "doc_id", "text")
    bounded_batches(docs.sparkSession)
    learn = docs.where(training(held_out)).select(F.col("text").cast("binary").alias("text"))
    counts = written(count_words(learn).groupBy("token").agg(F.sum("n").alias("c")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.octet_length("token") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
    best = frequent(counts.where(F.octet_length("token") > 0))
    single = min(MOST_WORDS, sum(c >= LEAST_COUNT for _, c in best))
    lexicon = Lexicon([w for w, _ in best], np.array([c for _, c in best], dtype=np.float64), single)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    # what the units of other words hold: one row each
    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = frozenset(shared.value.words[: shared.value.single])
        held = np.zeros((2, TAIL_UNITS), dtype=np.int64)
        for batch in batches:
            for token, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if token and token not in own:
                    k = tail_of(token)
                    held[0, k] += c
                    held[1, k] += 1
        k = np.flatnonzero(held[1])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(held[0, k]), pa.array(held[1, k])], names=["k", "n", "v"])

    tail = np.zeros((2, TAIL_UNITS))
    for r in counts.mapInArrow(shares, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tail[:, r["k"]] = r["n"], r["v"]
    units = np.concatenate([lexicon.counts[:single], tail[0], [float(totals["ends"])]])
    return Fitted(counts, lexicon, train(learn, lexicon, shared, units), tail, int(totals["n"]), int(totals["v"]), int(totals["ends"]))


def score_texts(docs: DataFrame, held_out: Column | None = None, fitted: Fitted | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Rows where ``held_out`` is true are scored but not learned from; with ``fitted`` nothing is learned.
    """
    require_columns(docs, "doc_id", "text")
    f = fitted or fit(docs, held_out)
    context = docs.sparkSession.sparkContext
    shared, table = context.broadcast(f.lexicon), context.broadcast(f.model)
    n, v, ends, single = f.n, f.v, f.ends, f.lexicon.single
    end = single + TAIL_UNITS
    bottom = math.log10(n + SMOOTHING * (v + 1))
    within = np.log10(f.tail[0] + SMOOTHING * (f.tail[1] + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language_model")
        known, model = shared.value.prepare(), table.value
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                split = [words_of(t) for t in byte_values(part.column(2))]
                sizes = np.array([len(w) for w in split], dtype=np.int64)
                words = list(chain.from_iterable(split))
                head, units = known.classify(words)
                cuts = np.cumsum(sizes)
                tokens, before = model.line(np.split(units, cuts[:-1]), end)
                # very long texts, too, go through the products a piece at a time
                logs = np.concatenate([model.log_probs(tokens[i : i + PIECE], before[i : i + PIECE]) for i in range(0, len(tokens), PIECE)]) / math.log(10)
                totals = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]))
                # sums of what each word says, by text
                texts, inside = np.repeat(np.arange(len(sizes)), sizes), head >= 0
                own = np.where(inside, known.log_counts[head], 0.0) if known.words else np.zeros(len(head))
                base = np.bincount(texts, own, len(sizes)) + math.log10(ends + SMOOTHING) - (sizes + 1) * bottom
                shared_units = np.flatnonzero(units >= single)
                totals += np.bincount(texts[shared_units], own[shared_units] - within[units[shared_units] - single], len(sizes))
                outside = np.flatnonzero(~inside)
                others = Counter(zip(texts[outside].tolist(), map(words.__getitem__, outside.tolist()), strict=True))  # in the order of texts
                counted = np.fromiter((t for t, _ in others), dtype=np.int64, count=len(others))
                rest = pa.StructArray.from_arrays([pa.array([w for _, w in others], pa.binary()), pa.array(list(others.values()), pa.int64())], names=["token", "n"])
                rests = pa.ListArray.from_arrays(pa.array(np.searchsorted(counted, np.arange(len(sizes) + 1)).astype(np.int32)), rest)
                n_known = np.bincount(texts[inside], minlength=len(sizes)) + (ends > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(totals), rests], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rest"])

    held = F.lit(False) if held_out is None else held_out
    source = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, model double, rest array<struct<token:binary,n:bigint>>")
    rows = written(scored.withColumn("id", F.monotonically_increasing_id()), "scores")
    # words outside the head: exact counts from the table
    rest = rows.select("id", F.explode("rest").alias("w")).select("id", "w.token", "w.n")
    logs = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING))
    more = rest.join(f.counts, "token", "left").groupBy("id").agg(F.sum(F.col("n") * logs).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    found = rows.drop("rest").join(more, "id", "left")
    extra = F.coalesce("logs", F.lit(0.0))
    return found.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"))
