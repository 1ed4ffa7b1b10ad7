"""Text normal forms as JVM-side column expressions.

Patterns spell out Unicode classes because Java's `\\s` and `\\w` are ASCII-only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions.binding import let

SPACE_CLASS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
SPACES = f"[{SPACE_CLASS}]+"


def _untidy(outside: str, outside_not_space: str) -> str:
    """Runs of `outside` characters, except a run that is exactly one space.

    Both arguments are character classes. Leaving lone spaces unmatched gives the
    same result as matching every run and is much cheaper: prose is mostly words
    between single spaces.
    """
    return f"{outside_not_space}{outside}*| {outside}+"


UNTIDY_SPACES = _untidy(f"[{SPACE_CLASS}]", f"[{SPACE_CLASS}&&[^ ]]")
# The complement of [a-z0-9+@./:-] spelt as ranges: Java tests ranges several times
# faster than a negated class that lists single characters.
NOT_MATCHED = r"\x00-\x1F\x21-\x2A\x2C\x3B-\x3F\x41-\x60\x{7B}-\x{10FFFF}"
UNTIDY_MATCH = _untidy(f"[ {NOT_MATCHED}]", f"[{NOT_MATCHED}]")
UNTIDY_WORDS = _untidy(r"[^\p{L}\p{N}_]", r"[^\p{L}\p{N}_ ]")


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Every run of white space becomes one space; ends trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(blank_if_null(c), UNTIDY_SPACES, " "))


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends only."""
    return F.regexp_replace(
        blank_if_null(c), f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", ""
    )


def word_count(cleaned: Column) -> Column:
    """Words of a text that is already clean (single spaces)."""
    return F.when(cleaned == "", F.lit(0)).otherwise(
        F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit(""))) + 1
    )


def words_of(cleaned: Column) -> Column:
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(
        F.split(cleaned, " ")
    )


def match_text(c: Column) -> Column:
    """Lower-case text reduced to the characters used for lexical matching."""
    return F.trim(F.regexp_replace(F.lower(blank_if_null(c)), UNTIDY_MATCH, " "))


def query_terms(matched: Column) -> Column:
    """Terms of a `match_text` value: two characters or more, no stop words, duplicates kept."""
    return F.filter(
        F.split(matched, " "),
        lambda t: (F.length(t) >= 2) & ~t.isin(fixed.QUERY_STOPWORDS),
    )


def dedupe_key(c: Column) -> Column:
    """Words only, lower case: equal keys mean equal text for deduplication."""
    return F.trim(F.regexp_replace(F.lower(blank_if_null(c)), UNTIDY_WORDS, " "))


def labelled_lines(pairs: list[tuple[str, Column]]) -> Column:
    """`Label: value` lines joined by newlines; empty values dropped."""

    def line(label: str) -> Callable[[Column], Column]:
        return lambda v: F.when(v != "", F.concat(F.lit(f"{label}: "), v))

    return F.concat_ws("\n", *[let(clean_text(value), line(label)) for label, value in pairs])


def preview(cleaned: Column, limit: int = fixed.PREVIEW_CHARS) -> Column:
    return F.when(F.length(cleaned) <= limit, cleaned).otherwise(
        F.concat(F.rtrim(F.substring(cleaned, 1, limit)), F.lit("..."))
    )


def contains_any(c: Column, needles: list[str]) -> Column:
    """One boolean expression over literal substrings; stays inside codegen."""
    found = F.contains(c, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(c, F.lit(needle))
    return found


def has_any(tokens: Column, values: list[str]) -> Column:
    """Does the array hold any of the literal values?"""
    return F.arrays_overlap(tokens, F.array(*[F.lit(v) for v in values]))


def markdown_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def parse_float(c: Column) -> Column:
    return c.try_cast("double")


def truthy(c: Column) -> Column:
    return F.lower(strip(c.cast("string"))).isin("true", "1", "yes")
