"""Listing cards: the only extraction that needs the page's tag nesting.

A small Arrow-batched helper walks one page and returns its cards and links;
dates, durations, speakers and addresses are then native expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.config import Site
from quillrank.functions import events, times, urls
from quillrank.functions.rows import unnest
from quillrank.functions.text import collapse, text_or_null
from quillrank.operators.links import accepted_schedule_links, keep_first, resolved_links
from quillrank.operators.page_walk import walk_page

_TEXTS = T.ArrayType(T.StringType())
_CARD = T.StructType(
    [
        T.StructField("head", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("clock", T.StringType()),
        T.StructField("first_name", T.IntegerType()),
        T.StructField("end_name", T.IntegerType()),
        T.StructField("track", T.StringType()),
        T.StructField("transcript", T.BooleanType()),
    ]
)
_ANCHOR = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("href", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("card", T.IntegerType()),
        T.StructField("same", T.BooleanType()),
    ]
)
_PAGE = T.StructType(
    [
        T.StructField("cards", T.ArrayType(_CARD)),
        T.StructField("links", T.ArrayType(_ANCHOR)),
        T.StructField("names", _TEXTS),
        T.StructField("error", T.StringType()),
    ]
)


def page_cards(html: Column, site: Site) -> Column:
    """Cards and item links of each page, Arrow batch by Arrow batch.

    A page that cannot be walked gives ``error`` and nothing else; its neighbours
    are not touched by it.
    """
    item_path, tracks = site.item_path, tuple(site.tracks)

    def one(html: str | None) -> dict:
        if html is None:
            return {"cards": [], "links": [], "names": [], "error": None}
        try:
            return walk_page(html, item_path, tracks)
        except Exception as error:  # whatever markup does to the parser
            return {"cards": [], "links": [], "names": [], "error": f"{type(error).__name__}: {error}"}

    @F.pandas_udf(_PAGE)
    def walk(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(html) for html in pages], columns=["cards", "links", "names", "error"])

    # Only pages that mention an item link travel to Python.
    return walk(F.when(F.contains(html, F.lit(item_path)), html))


def _card_fields(card: Column, names: Column) -> Column:
    inside = F.slice(names, card["first_name"] + 1, card["end_name"] - card["first_name"])
    return F.struct(
        times.visible_date(card["date"]).alias("published_date"),
        times.clock_minutes(card["clock"]).alias("duration_minutes"),
        F.coalesce(times.has_bad_visible_date(card["date"]), F.lit(False)).alias("bad_date"),
        card["head"].alias("text"),
        text_or_null(F.array_join(F.array_distinct(inside), ", ")).alias("speaker"),
        card["track"].alias("track"),
        card["transcript"].alias("transcript"),
    )


def _listing(link: Column, cards: Column, base: Column, site: Site) -> Column:
    """One link with the facts of its card; a link outside any card is its own card."""
    def fact(name: str) -> Column:
        return F.get(cards, link["card"])[name]

    inside = link["card"].isNotNull()
    text = F.when(inside, fact("text")).otherwise(collapse(link["title"]))
    published = F.when(inside, fact("published_date")).otherwise(times.visible_date(link["title"]))
    minutes = F.when(inside, fact("duration_minutes")).otherwise(times.clock_minutes(link["title"]))
    same = F.when(inside, link["same"]).otherwise(text == link["title"])
    summary = F.when(~same, text_or_null(text))
    return F.struct(
        link["pos"].alias("pos"),
        urls.canonical(urls.absolute(base, link["href"]), site).alias("url"),
        link["title"].alias("title"),
        # A card's text is a stand-in for a summary: its first 500 characters.
        F.substring(summary, 1, 500).alias("summary"),
        published.alias("published_date"),
        F.year(published).alias("year"),
        fact("speaker").alias("speaker"),
        minutes.alias("duration_minutes"),
        fact("track").alias("track"),
        minutes.isNotNull().alias("has_video"),
        F.coalesce(fact("transcript"), F.lit(False)).alias("has_transcript"),
    )


def spread(pages: DataFrame) -> DataFrame:
    """The same pages over all tasks: walking costs far more than moving, and a table or file may come in few parts."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = [c for c in pages.columns if c != "html"]
    return pages.repartition(parts, F.xxhash64(*named))


def with_listing(pages: DataFrame, site: Site) -> DataFrame:
    """Add ``links`` (raw item links) and ``listing`` (accepted card rows) to each page."""
    df = pages.withColumn("_page", page_cards(F.col("html"), site))
    df = df.withColumns({"links": F.col("_page.links"), "walk_error": F.col("_page.error")}).withColumn(
        "_cards", F.transform(F.col("_page.cards"), lambda c: _card_fields(c, F.col("_page.names")))
    )
    cards, base = F.col("_cards"), F.col("url")
    accepted = F.filter(
        F.col("links"),
        lambda a: urls.is_item_link(a["href"], site)
        & (a["title"] != "")
        & ~F.lower(a["title"]).isin(*site.generic_card_titles),
    )
    df = df.withColumn("listing", F.transform(accepted, lambda a: _listing(a, cards, base, site)))
    df = df.withColumn(
        "listing",
        F.filter("listing", lambda x: x["published_date"].isNotNull() | x["duration_minutes"].isNotNull()),
    )
    return keep_first(df, "listing").drop("_page")


def _listing_columns(site: Site) -> list[Column]:
    return [
        F.col("a.pos").alias("pos"),
        F.col("a.url").alias("url"),
        F.col("a.url").alias("presentation_url"),
        F.col("a.title").alias("title"),
        F.col("a.summary").alias("summary"),
        F.col("a.published_date").alias("published_date"),
        F.col("a.year").alias("year"),
        F.col("a.speaker").alias("speaker"),
        F.col("a.duration_minutes").alias("duration_minutes"),
        F.lit(site.name).alias("source"),
        F.col("a.conference").alias("conference"),
        F.col("a.track").alias("track"),
        F.col("a.has_video").alias("has_video"),
        F.lit(False).alias("has_slides"),
        F.col("a.has_transcript").alias("has_transcript"),
    ]


def listing_items(pages: DataFrame, site: Site) -> DataFrame:
    """One row per listing card link that shows a date or a duration."""
    found = with_listing(pages, site)
    carry = [c for c in pages.columns if c not in ("url", "html")]
    rows = unnest(found, carry, F.col("listing"), "a")
    rows = rows.withColumn("a", F.col("a").withField("conference", events.event_of_url(F.col("a.url"), site)))
    return rows.select(*carry, *_listing_columns(site))


def page_results(pages: DataFrame, site: Site) -> DataFrame:
    """Every page with ``found``, an array of its items, and ``walk_error``.

    Items are the page's cards, or its plain item links where no card qualifies. The
    choice is made inside the page's row, so neither side is shuffled.
    """
    found = with_listing(pages, site)
    base = F.col("url")
    schedule = resolved_links(accepted_schedule_links(F.col("links"), site), base, site)
    found = found.withColumn("_plain", F.when(F.size("listing") == 0, schedule))
    found = keep_first(found, "_plain")
    base_year, base_event = events.event_year(base, site), events.event_of_url(base, site)
    found = found.withColumn("_base_year", base_year).withColumn("_base_event", base_event)

    from_cards = F.transform(
        "listing", lambda a: a.withField("conference", events.event_of_url(a["url"], site))
    )
    from_links = F.transform(
        "_plain",
        lambda a: F.struct(
            a["pos"].alias("pos"),
            a["url"].alias("url"),
            a["title"].alias("title"),
            F.lit(None).cast("string").alias("summary"),
            F.lit(None).cast("date").alias("published_date"),
            F.coalesce(F.col("_base_year"), events.event_year(a["href"], site)).alias("year"),
            F.lit(None).cast("string").alias("speaker"),
            F.lit(None).cast("int").alias("duration_minutes"),
            F.lit(None).cast("string").alias("track"),
            F.lit(False).alias("has_video"),
            F.lit(False).alias("has_transcript"),
            F.coalesce(F.col("_base_event"), events.event_of_campaign(a["href"], site)).alias("conference"),
        ),
    )
    chosen = F.when(F.size("listing") > 0, from_cards).otherwise(from_links)
    carry = [c for c in pages.columns if c not in ("url", "html")]
    return found.select(*carry, "walk_error", chosen.alias("found"))


def result_items(results: DataFrame, site: Site) -> DataFrame:
    """One row per item of ``page_results``."""
    carry = [c for c in results.columns if c not in ("walk_error", "found")]
    return unnest(results, carry, F.col("found"), "a").select(*carry, *_listing_columns(site))


def page_items(pages: DataFrame, site: Site) -> DataFrame:
    """Items of every page, one row each."""
    return result_items(page_results(pages, site), site)


def walk_errors(pages: DataFrame, site: Site) -> DataFrame:
    """Pages whose markup could not be walked, with the reason."""
    return pages.select("page_id", page_cards(F.col("html"), site)["error"].alias("error")).filter("error is not null")


def rejected_dates(pages: DataFrame, site: Site) -> DataFrame:
    """Per page, how many cards show a date that is none."""
    found = with_listing(pages, site)
    return found.select(
        "page_id", F.size(F.filter("_cards", lambda c: c["bad_date"])).alias("rejects")
    ).filter("rejects > 0")
