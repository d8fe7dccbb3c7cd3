"""Reading JSON that a generator left incomplete.

Stages, the first that gives an object wins: as it is; the outermost braces
with trailing commas removed; from the first brace with open strings, lists
and objects closed; known fields one by one; the raw text under one key.
Anything but an object counts as a failure of its stage.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names a generator is asked for, with the type of each.
FIELDS = {
    "argument": "text", "counter_argument": "text", "verdict": "text", "legal_holding": "text", "reasoning": "text", "reason": "text",
    "overall_confidence": "number", "challenge_strength": "number", "confidence": "number", "argument_quality": "number",
    "concede": "flag", "continue_debate": "flag", "challenges": "list", "gaps": "list", "targeted_queries": "list",
}
# The names in a citation, as (name in the result, type); some have two names.
CITATION_FIELDS = {
    "case_name": ("case_name", "text"), "court": ("court", "text"), "holding": ("holding", "text"), "reporter_cite": ("reporter_cite", "text"), "citation": ("reporter_cite", "text"),
    "year": ("year", "whole"), "self_confidence": ("self_confidence", "number"), "ccs": ("self_confidence", "number"),
}

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.DOTALL)
_COMMA = re.compile(r",\s*([}\]])")


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _closed(text: str) -> str:
    """``text`` with what is still open at its end closed."""
    waiting: list[str] = []
    quoted = skip = False
    for ch in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            waiting.append("}" if ch == "{" else "]")
        elif waiting and ch == waiting[-1]:
            waiting.pop()
    return text + '"' * quoted + "".join(reversed(waiting))


def _unquoted(text: str) -> str:
    try:
        return json.loads(f'"{text}"', strict=False)
    except ValueError:
        return text


def _typed(kind: str, tokens: list[str], at: int):
    """The value that begins at a token, if it is of that type, else None."""
    first = tokens[at] if at < len(tokens) else ""
    if kind == "text":
        return _unquoted(first[1:-1]) if first.startswith('"') else None
    if kind == "flag":
        return {"true": True, "false": False}.get(first.lower())
    if kind == "list":
        if first != "[" or "]" not in tokens[at:]:
            return None
        return [_unquoted(t[1:-1]) for t in tokens[at : tokens.index("]", at)] if t.startswith('"')]
    number = re.match(r"\d+" if kind == "whole" else r"\d+(?:\.\d+)?", first)
    return None if number is None else int(number[0]) if kind == "whole" else float(number[0])


def _fields(text: str) -> dict:
    """What can be told of a broken object: its tokens are read once, and each known name takes the value after it."""
    spans = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    tokens = [t for t, _, _ in spans]
    found: dict = {}
    cites: list[dict] = []
    opened: list[tuple[int, dict, bool]] = []  # start, citation so far, holds other objects
    for i, (token, start, end) in enumerate(spans):
        if token == "{":
            opened = [(at, cite, True) for at, cite, _ in opened]
            opened.append((start, {}, False))
        elif token == "}" and opened:
            at, cite, nested = opened.pop()
            if cite.get("case_name") and not nested:
                cites.append(_object(text[at:end]) or cite)
        elif token.startswith('"') and tokens[i + 1 : i + 2] == [":"]:
            name = token[1:-1]
            if name in FIELDS and name not in found and (value := _typed(FIELDS[name], tokens, i + 2)) is not None:
                found[name] = value
            if name in CITATION_FIELDS and opened:
                key, kind = CITATION_FIELDS[name]
                if key not in opened[-1][1] and (value := _typed(kind, tokens, i + 2)) is not None:
                    opened[-1][1][key] = value
    if cites:
        found |= {"citations": cites, "counter_citations": cites, "verified_citations": cites}
    return found


def salvage(raw: str | None, fallback_key: str = "text") -> tuple[dict, int]:
    """The object and the stage, from 1, that found it; an empty text is an empty object of stage 0."""
    text = (raw or "").strip()
    if not text:
        return {}, 0
    if (found := _object(text)) is not None:
        return found, 1
    first, last = text.find("{"), text.rfind("}")
    if 0 <= first < last and (found := _object(_COMMA.sub(r"\1", text[first : last + 1]))) is not None:
        return found, 2
    if first >= 0:
        body = text[first:].partition("```")[0].strip()
        if (found := _object(_COMMA.sub(r"\1", _closed(body)))) is not None:
            return found, 3
    if found := _fields(text):
        return found, 4
    return {fallback_key: raw}, 5


SALVAGED = T.StructType([T.StructField(n, t) for n, t in (("stage", T.IntegerType()), ("json", T.StringType()), ("argument", T.StringType()), ("verdict", T.StringType()), ("confidence", T.DoubleType()), ("n_citations", T.IntegerType()))])


@F.pandas_udf(SALVAGED)
def salvage_udf(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for text in raw:
        found, stage = salvage(text)
        number = next((found[k] for k in ("confidence", "overall_confidence") if isinstance(found.get(k), int | float)), None)
        cites = next((found[k] for k in ("citations", "verified_citations", "counter_citations") if isinstance(found.get(k), list)), [])
        said = {k: v if isinstance(v := found.get(k), str) else None for k in ("argument", "verdict")}
        rows.append((stage, json.dumps(found, sort_keys=True, ensure_ascii=False), said["argument"], said["verdict"], number, len(cites)))
    return pd.DataFrame(rows, columns=["stage", "json", "argument", "verdict", "confidence", "n_citations"])
