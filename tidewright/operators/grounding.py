"""Checks of a text against the source it must follow, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
PRICE = r"\$[0-9]+(?:\.[0-9][0-9])?"


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def ungrounded_numbers(text: Column, source: Column) -> Column:
    """Numbers of the text that the source does not have."""
    return F.array_sort(F.array_except(numbers(text), numbers(source)))


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.lit(0).cast("long")).otherwise(F.size(F.split(F.trim(text), r"\s+")).cast("long"))


def banned(text: Column, phrases: list[str]) -> Column:
    """The banned phrases that occur, case aside, in the order given."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in phrases]))


def has_price(text: Column) -> Column:
    return text.rlike(PRICE)
