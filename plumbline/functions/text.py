"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Split at white space, in the case it has, without empty strings."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased words: what the lexical index is made of."""
    return words(F.lower(text))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def name_key(text: Column) -> Column:
    """The form in which names are compared."""
    return F.lower(stripped(text))


def long_words(text: Column, stop: Iterable[str] = ()) -> Column:
    """Distinct words of at least three letters, lower-cased, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else found


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ""."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def whole_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def year_of_date(date: Column) -> Column:
    return whole_number(F.substring(date, 1, 4))


def safe_year(value: Column) -> Column:
    """A whole number, else the first four digits in a row, else 0."""
    digits = F.nullif(F.regexp_extract(value, r"\d{4}", 0), F.lit(""))
    return F.coalesce(value.try_cast("int"), digits.try_cast("int"), F.lit(0))


def clean_name(name: Column) -> Column:
    """A name without the brackets, then the quotes, that a generator may wrap it in."""

    def unwrap(c: Column, pattern: str) -> Column:
        return stripped(F.regexp_replace(c, pattern, "$1"))

    return unwrap(unwrap(stripped(F.coalesce(name, F.lit(""))), r"(?s)^\[(.*)\]$"), r'(?s)^"(.*)"$')


def stable_key(text: Column) -> Column:
    return F.substring(F.sha1(name_key(text).cast("binary")), 1, 16)


def sha_prefix(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def reporter_cite(volume: Column, reporter: Column, page: Column) -> Column:
    return F.concat_ws(" ", volume, reporter, page.cast("string"))


def snippet(text: Column, length: int = 200) -> Column:
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def clamp(value: Column, default: float) -> Column:
    """A number from 0 to 1; ``default`` where there is none."""
    number = value.try_cast("double")
    return F.when(number.isNull(), F.lit(default)).otherwise(F.greatest(F.least(number, F.lit(1.0)), F.lit(0.0)))


def as_list(value: Column) -> Column:
    """A string as a list of one; null and "" as an empty list."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(value))


def repaired_commas(json: Column) -> Column:
    return F.regexp_replace(json, r",\s*([}\]])", "$1")


def passages(docs: Column, most: int = 500) -> Column:
    """Numbered lines of an array of (case_name, year, text)."""

    def line(d: Column, i: Column) -> Column:
        label = F.concat_ws(" ", F.nullif(d["case_name"], F.lit("")), F.when(d["year"] > 0, F.concat(F.lit("("), d["year"].cast("string"), F.lit(")"))))
        body = F.replace(F.substring(d["text"], 1, most), F.lit("\n"), F.lit(" "))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.concat_ws(": ", F.nullif(label, F.lit("")), body))

    return F.array_join(F.transform(docs, line), "\n")


def report_lines(scores: Column) -> Column:
    """``name: CCS=0.00 [tier]`` for an array of (case_name, ccs, tier)."""
    return F.array_join(F.transform(scores, lambda s: F.format_string("%s: CCS=%.2f [%s]", s["case_name"], s["ccs"], s["tier"])), "\n")


def history_lines(turns: Column, most: int = 400) -> Column:
    """Turns of an array of (ord, role, argument), in order, a blank line between them."""
    return F.array_join(F.transform(F.array_sort(turns), lambda t: F.concat(F.lit("["), F.upper(t["role"]), F.lit("] "), F.substring(t["argument"], 1, most))), "\n\n")


def counter_queries(query: Column, citations: Column) -> Column:
    """Queries against an argument: one on limits, three on treatment, two on holdings of (case_name, holding)."""
    limits = F.array(F.concat(query, F.lit(" exception distinguished does not apply")))
    named = F.filter(F.slice(citations, 1, 3), lambda c: F.coalesce(c["case_name"], F.lit("")) != "")
    held = F.filter(F.slice(citations, 1, 2), lambda c: F.length(F.coalesce(c["holding"], F.lit(""))) > 10)
    treatment = F.transform(named, lambda c: F.concat(c["case_name"], F.lit(" overruled distinguished limited")))
    holdings = F.transform(held, lambda c: F.concat(F.substring(c["holding"], 1, 80), F.lit(" limitation exception")))
    return F.concat(limits, treatment, holdings)


def augmented(query: Column, more: Column, round_no: Column) -> Column:
    """From the second round on, the query with the first two queries of the reflection."""
    return F.when(round_no > 0, F.concat_ws(" ", query, F.array_join(F.slice(more, 1, 2), " "))).otherwise(query)


def with_jurisdiction(query: Column, jurisdiction: Column) -> Column:
    return F.trim(F.concat_ws(" ", query, F.nullif(jurisdiction, F.lit(""))))
