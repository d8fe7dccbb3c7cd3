"""Values from the first of several places that has one, and which place that was."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A name and what is found there: a text, null or "" where there is nothing.
Rule = tuple[str, Column]


def first_place(rules: Sequence[Rule], otherwise: Column | None = None) -> Column:
    """(place, value) of the first rule that finds something, in the order given.

    Where none does, ``otherwise`` is evaluated (``F.raise_error`` fails the job); without it both are "".
    """
    found = [(name, F.nullif(value, F.lit(""))) for name, value in rules]
    result = F.lit(None).cast("struct<place:string,value:string>")
    for name, value in reversed(found):
        result = F.when(value.isNotNull(), F.struct(F.lit(name).alias("place"), value.alias("value"))).otherwise(result)
    none = F.struct(F.lit("").alias("place"), (F.lit("") if otherwise is None else otherwise.cast("string")).alias("value"))
    return F.coalesce(result, none)


def pattern(text: Column, regex: str) -> Column:
    """The first group of the first match, "" without one; null is empty."""
    return F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), regex, 1)
