"""Event year and event name, read off URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.config import Site
from quillrank.functions.text import text_or_null


def event_year(url: Column, site: Site) -> Column:
    found = F.regexp_extract(url, rf"(?i){re.escape(site.event_key)}[^/]*?(20\d{{2}})", 1)
    return text_or_null(found).cast("int")


def _title_case(c: Column) -> Column:
    """Capital after every non-letter, the rest small."""
    marked = F.regexp_replace(c, r"(\p{L}+)", "\u0001$1")
    words = F.transform(
        F.split(marked, "\u0001"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)),
    )
    return F.array_join(words, "")


def event_name_of_slug(slug: Column, site: Site) -> Column:
    """Readable event name; an unknown city keeps whatever else the slug says."""
    year = F.regexp_extract(slug, r"(20\d{2})", 1)
    words = F.replace(F.lower(slug), F.lit("-"), F.lit(" "))

    def has(*needles: str) -> Column:
        found = F.lit(False)
        for needle in needles:
            found = found | F.contains(words, F.lit(needle))
        return found

    rest = F.trim(F.replace(words, F.lit(site.event_key), F.lit("")))
    city = (
        F.when(has("sf", "san francisco"), F.lit("SF"))
        .when(has("newyork", "new york"), F.lit("New York"))
        .when(has("london"), F.lit("London"))
        .otherwise(_title_case(rest))
    )
    return F.concat_ws(" ", F.lit(site.event), text_or_null(city), text_or_null(year))


def event_of_url(url: Column, site: Site) -> Column:
    slug = F.regexp_extract(url, rf"/({re.escape(site.event_key)}[^/]+)/", 1)
    return F.when(slug != "", event_name_of_slug(slug, site))


def event_of_campaign(href: Column, site: Site) -> Column:
    pattern = rf"{re.escape(site.event)}([A-Za-z]+)(\d{{4}})"
    city = F.regexp_extract(href, pattern, 1)
    name = F.when(F.lower(city) == "sanfrancisco", F.lit("San Francisco")).otherwise(city)
    return F.when(
        city != "", F.concat_ws(" ", F.lit(site.event), name, F.regexp_extract(href, pattern, 2))
    )
