"""Links of a page: extraction, item filter, first occurrence per page.

Everything works inside the page's own row, on an array of links, so no page
is shuffled: a page's links never meet those of another page before ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import Site
from quillrank.functions import urls
from quillrank.functions.rows import unnest
from quillrank.functions.text import collapse, decode_entities, fold, visible_text, without_hidden

# An opening link tag and everything up to its end, the next link or the end of the page.
_ANCHOR = r"(?is)<a\s[^>]*>.*?(?=</a\s*>|<a\s|\z)"
_HREF = r"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def page_anchors(html: Column) -> Column:
    """Array of ``(pos, href, title)`` for every ``<a href>`` of a page, in page order."""
    tags = F.filter(
        F.regexp_extract_all(without_hidden(html), F.lit(_ANCHOR), F.lit(0)),
        lambda tag: F.regexp_like(tag, F.lit(_HREF)),
    )

    def link(tag: Column, pos: Column) -> Column:
        # At most one of the three quoting styles is non-empty.
        href = F.concat(*[F.regexp_extract(tag, _HREF, k) for k in (1, 2, 3)])
        return F.struct(
            pos.cast("int").alias("pos"),
            decode_entities(href).alias("href"),
            visible_text(F.regexp_replace(tag, r"^<[^>]*>", "")).alias("title"),
        )

    return F.transform(tags, link)


def _ordered_by_key(links: Column, key: str) -> Column:
    return F.array_sort(
        links,
        lambda a, b: F.when(a[key] < b[key], -1)
        .when(a[key] > b[key], 1)
        .when(a["pos"] < b["pos"], -1)
        .when(a["pos"] > b["pos"], 1)
        .otherwise(0),
    )


def keep_first(df: DataFrame, links: str, key: str = "url") -> DataFrame:
    """Keep the first link per ``key`` inside the array column ``links``.

    Sort by (key, pos), then keep an element whose left neighbour has another
    key: linear after the sort and without leaving the row.
    """
    df = df.withColumn(links, _ordered_by_key(F.col(links), key))
    ordered = F.col(links)
    return df.withColumn(
        links,
        F.filter(
            ordered,
            lambda x, i: (i == 0) | (F.get(ordered, i - 1)[key] != x[key]),
        ),
    )


def resolved_links(links: Column, base: Column, site: Site) -> Column:
    """Links with their canonical absolute address."""
    return F.transform(
        links,
        lambda a: F.struct(
            a["pos"].alias("pos"),
            a["href"].alias("href"),
            a["title"].alias("title"),
            urls.canonical(urls.absolute(base, a["href"]), site).alias("url"),
        ),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """All links of all pages, one row each, with absolute addresses."""
    links = unnest(pages, ["page_id", F.col("url").alias("page_url")], page_anchors(F.col("html")), "a")
    return links.select(
        "page_id",
        "page_url",
        "a.pos",
        "a.href",
        "a.title",
        urls.absolute(F.col("page_url"), F.col("a.href")).alias("link_url"),
    )


def accepted_schedule_links(links: Column, site: Site) -> Column:
    """Item links with a real title; rejected links do not claim their address."""
    return F.filter(
        links,
        lambda a: urls.is_item_link(a["href"], site)
        & (a["title"] != "")
        & ~F.lower(a["title"]).isin(*site.generic_schedule_titles),
    )


def item_links(pages: DataFrame, site: Site) -> DataFrame:
    """First accepted item link per canonical address and page."""
    accepted = accepted_schedule_links(page_anchors(F.col("html")), site)
    found = pages.select("page_id", F.col("url").alias("page_url"), accepted.alias("links"))
    found = found.withColumn("links", resolved_links(F.col("links"), F.col("page_url"), site))
    found = keep_first(found, "links")
    return unnest(found, ["page_id", "page_url"], F.col("links"), "a").select(
        "page_id", "page_url", "a.pos", "a.href", "a.title", "a.url"
    )


def link_words(title: Column) -> Column:
    return fold(collapse(title))
