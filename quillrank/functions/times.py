"""Dates and durations as they appear on pages. Bad input gives NULL, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.text import SPACES, WORD, text_or_null

_VISIBLE = rf"(?<![{WORD}])on{SPACES}([A-Z][a-z]{{2}}{SPACES}[0-9]{{1,2}},{SPACES}[0-9]{{4}})"
_CLOCK = rf"(?<![{WORD}])([0-9]{{1,2}}):([0-9]{{2}})(?![{WORD}])"
_PERIOD = r"^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?"


def visible_date(text: Column) -> Column:
    """First ``on Jul 02, 2024`` in the text."""
    found = F.regexp_replace(F.regexp_extract(text, _VISIBLE, 1), SPACES, " ")
    return F.try_to_date(text_or_null(found), "MMM d, yyyy")


def has_bad_visible_date(text: Column) -> Column:
    """A date-shaped text that is no date; counted as a reject."""
    return (F.regexp_extract(text, _VISIBLE, 1) != "") & visible_date(text).isNull()


def iso_date(text: Column) -> Column:
    """First ten characters as a date."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def _half_up(seconds: Column) -> Column:
    return F.when(seconds >= 30, 1).otherwise(0)


def clock_minutes(text: Column) -> Column:
    """First ``m:ss`` in the text, rounded at half a minute."""
    minutes = text_or_null(F.regexp_extract(text, _CLOCK, 1)).cast("int")
    seconds = text_or_null(F.regexp_extract(text, _CLOCK, 2)).cast("int")
    return (minutes + _half_up(seconds)).cast("int")


def period_minutes(text: Column) -> Column:
    """``PT1H2M30S`` in minutes; a bare ``PT`` is 0, forms with days are NULL."""
    def part(k: int) -> Column:
        return F.coalesce(text_or_null(F.regexp_extract(text, _PERIOD, k)).try_cast("int"), F.lit(0))

    total = part(1) * 60 + part(2) + _half_up(part(3))
    return F.when(text.startswith("PT"), total.cast("int"))
