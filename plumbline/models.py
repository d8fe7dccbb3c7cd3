"""Places for models, and stand-ins that give the same answer every time.

A generator turns prompts into texts, an embedder texts into vectors, a scorer pairs of texts into three
logits (contradiction, neutral, entailment).  Each is passed as a function that makes it, which a Python worker
calls once; models then see batches.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


_made: dict[str, object] = {}


def held(make: Callable):
    """The model of this worker."""
    name = f"{make.__module__}.{make.__qualname__}"
    if name not in _made:
        _made[name] = make()
    return _made[name]


def invoke(generator: Generator, prompts: list[str], fallbacks: list[str], attempts: int = 3, pause: float = 0.0) -> list[str]:
    """One text a prompt.  A text without an opening brace, or a failure, is asked for again with the fallback prompt."""
    texts, waiting = [""] * len(prompts), list(range(len(prompts)))
    for attempt in range(attempts):
        if not waiting:
            break
        if attempt and pause:
            time.sleep(pause)
        asked = [(fallbacks if attempt else prompts)[i] for i in waiting]
        try:
            answers = generator(asked)
        except Exception as failure:  # the last attempt's failure is the caller's to see
            if attempt + 1 == attempts:
                raise RuntimeError("the generator failed at every attempt") from failure
            continue
        for i, text in zip(waiting, answers, strict=True):
            texts[i] = text or ""
        waiting = [i for i in waiting if "{" not in texts[i]]
    return texts


def generated(prompt: Column, fallback: Column, make: Callable[[], Generator]) -> Column:
    @F.pandas_udf("string")
    def ask(prompts: pd.Series, fallbacks: pd.Series) -> pd.Series:
        return pd.Series(invoke(held(make), prompts.fillna("").tolist(), fallbacks.fillna("").tolist()))

    return ask(prompt, fallback)


def embedded(text: Column, make: Callable[[], Embedder]) -> Column:
    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(held(make)(texts.fillna("").tolist()), dtype=np.float64)))

    return encode(text)


def entailment(claim: Column, window: Column, make: Callable[[], Scorer]) -> Column:
    """The chance of entailment by a scorer's logits."""

    @F.pandas_udf("array<double>")
    def logits(claims: pd.Series, windows: pd.Series) -> pd.Series:
        pairs = list(zip(windows.fillna(""), claims.fillna(""), strict=True))
        return pd.Series(list(np.asarray(held(make)(pairs), dtype=np.float64).reshape(len(pairs), 3)))

    return softmax(logits(claim, window), 2)


def softmax(logits: Column, index: int) -> Column:
    """The share of one of an array of logits."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.get(powers, F.lit(index)) / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- stand-ins

DIMENSION = 64


def hashed_embedder() -> Embedder:
    """Counts of words by a checksum, of length one."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSION))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                row[zlib.crc32(word.encode()) % DIMENSION] += 1.0
            row[0] += 1e-3  # no text is a vector of zeros
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return encode


PASSAGE = re.compile(r"^\[(\d+)\] (?:(.*?): )?(.*)$", re.MULTILINE)


def scripted_generator() -> Generator:
    """JSON made of the prompt alone, with what generators do wrong: names changed or invented, texts cut off."""

    def one(prompt: str) -> str:
        role = prompt.partition("\n")[0]
        number = zlib.crc32(prompt.encode())
        cites = []
        for _, label, body in PASSAGE.findall(prompt):
            name = re.sub(r" \(\d+\)$", "", label)
            at = zlib.crc32(f"{name}|{role}".encode()) % 6
            said = f"Imaginary {name} v. Nobody" if at == 0 else f"{name}x" if at == 1 else name
            held_words = body.split()[: 6 + at]
            cites.append({"case_name": said, "holding": " ".join(held_words), "self_confidence": 0.5 + at / 20})
        listed = re.findall(r"^(.*): CCS=([0-9.]+) \[(\w+)\]$", prompt, re.MULTILINE)
        if role == "DEFENSE":
            found = {"counter_argument": f"against {number % 97}", "counter_citations": cites, "challenge_strength": (number % 10) / 10, "concede": not cites or number % 23 == 0}
        elif role == "REFLECTION":
            weak = [name for name, score, _ in listed if float(score) < 0.6]
            found = {"gaps": [f"no support for {n}" for n in weak], "targeted_queries": [f"{n} holding" for n in weak], "argument_quality": 0.5}
        elif role == "JUDGE":
            found = {"verdict": f"settled {number % 89}", "verified_citations": [{"case_name": n} for n, _, tier in listed if tier == "SUPPORTED"], "confidence": (number % 100) / 100}
        else:
            found = {"argument": f"argued {number % 83}", "citations": cites, "overall_confidence": 0.6}
        text = json.dumps(found)
        return (text, f"Here it is: {text} Done.", text[:-1] + ",}", text[:-1])[number % 4]

    return lambda prompts: [one(p) for p in prompts]
