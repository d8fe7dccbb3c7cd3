"""Documents into overlapping windows of words, and texts into windows of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BEGINNINGS, DEFAULTS
from ..functions import text as fx


def window_starts(size: Column, width: int, step: int) -> Column:
    """Starts of windows up to the first that reaches the end; none for an empty text."""
    last = F.greatest(F.ceil((size - width) / step).cast("int"), F.lit(0)) * step
    return F.when(size > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def chunk_documents(docs: DataFrame, chunk_words: int = DEFAULTS.chunk_words, overlap_words: int = DEFAULTS.overlap_words) -> DataFrame:
    """A row per chunk: the document's columns but text, and parent_doc_id, chunk_index, word_start, word_end, text, chunk_id.

    Documents without words have no chunks.  Chunk ids hold a digest of parent, index and text.
    """
    if chunk_words <= 0 or not 0 <= overlap_words < chunk_words:
        raise ValueError("chunk_words must be positive and overlap_words smaller than it")
    step = chunk_words - overlap_words
    split = docs.withColumn("_words", fx.words(F.col("text"))).drop("text")
    starts = split.select("*", F.posexplode(window_starts(F.size("_words"), chunk_words, step)).alias("chunk_index", "word_start"))
    text = F.array_join(F.slice("_words", F.col("word_start") + 1, chunk_words), " ")
    cut = starts.select("*", F.least(F.col("word_start") + chunk_words, F.size("_words")).alias("word_end"), text.alias("text")).drop("_words")
    parent = F.col("doc_id").cast("string")
    digest = fx.sha_prefix(F.concat_ws(":", parent, F.col("chunk_index").cast("string"), F.col("text")), 16)
    chunk_id = F.concat_ws("::", parent, F.lit("chunk"), F.col("chunk_index").cast("string"), digest)
    return cut.withColumns({"parent_doc_id": parent, "chunk_id": chunk_id})


def character_windows(docs: DataFrame, width: int = DEFAULTS.window_chars, step: int = DEFAULTS.window_step, reach: int | None = BEGINNINGS.window_reach) -> DataFrame:
    """A row per window of ``text``: window_no, start and window.  ``reach``: windows start and end before it; None: all of the text.

    A text is cut into pieces of ``step`` characters once and windows are put together of them, so the work grows with its length.
    """
    text = F.col("text") if reach is None else F.substring("text", 1, reach)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    met = -(-width // step)
    # an array of the one list of pieces, so that it is made once and not for each window
    windows = F.flatten(F.transform(F.array(pieces), lambda p: F.transform(p, lambda _, i: F.substring(F.array_join(F.slice(p, i + 1, met), ""), 1, width))))
    cut = docs.select("*", F.posexplode(windows).alias("window_no", "window"))
    return cut.select(*docs.columns, "window_no", (F.col("window_no") * step).alias("start"), "window")
