"""Which pages to read next: pagination links of seeds, and what is not cached yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.config import Site
from quillrank.functions import urls
from quillrank.functions.rows import unnest
from quillrank.operators.links import keep_first, link_words, page_anchors


_COLUMNS = ("seed_order", "seed_url", "page_no", "url", "key")


def _seed_rows(seeds: DataFrame) -> DataFrame:
    """The seeds as pages number 0; needs no markup."""
    key = urls.no_slash(F.col("url"))
    return seeds.select("seed_order", F.col("url").alias("seed_url"), F.lit(0).alias("page_no"), "url", key.alias("key"))


def _linked_rows(seeds: DataFrame, site: Site, max_pages: int) -> DataFrame:
    """Pagination links of each seed, numbered from 1 in page order."""
    kept = F.filter(
        page_anchors(F.col("html")),
        lambda a: urls.is_next_page(link_words(a["title"]), a["href"], site),
    )
    found = seeds.select("seed_order", F.col("url").alias("seed_url"), kept.alias("links"))
    seed_url = F.col("seed_url")

    def target(a):
        link = urls.absolute(seed_url, a["href"])
        return F.struct(a["pos"].alias("pos"), link.alias("url"), urls.no_slash(link).alias("key"))

    found = found.withColumn("links", F.transform("links", target))
    found = found.withColumn("links", F.filter("links", lambda a: a["key"] != urls.no_slash(seed_url)))
    found = keep_first(found, "links", "key")
    by_page_order = F.array_sort(F.transform("links", lambda a: F.struct(a["pos"], a["url"], a["key"])))
    numbered = F.transform(
        F.slice(by_page_order, 1, max(max_pages - 1, 0)), lambda a, i: a.withField("page_no", (i + 1).cast("int"))
    )
    return unnest(found, ["seed_order", "seed_url"], numbered, "a").select("seed_order", "seed_url", "a.page_no", "a.url", "a.key")


def frontier(seeds: DataFrame, site: Site, max_pages: int) -> DataFrame:
    """Seed pages and their pagination links in page order, ``max_pages`` per seed.

    ``seeds`` has ``seed_order, url, html``. The seed counts towards the limit.
    """
    if max_pages < 1:
        return _seed_rows(seeds).filter(F.lit(False))
    return _seed_rows(seeds).unionByName(_linked_rows(seeds, site, max_pages))


def frontier_across_seeds(seeds: DataFrame, site: Site, max_pages: int) -> DataFrame:
    """The frontier without pages an earlier seed has already brought; seeds themselves always stay.

    Markup is read once: seeds come from their addresses alone. The rank filter is
    pushed below the shuffle, so a page that a third of all seeds link to sends at
    most one row per task.
    """
    if max_pages < 1:
        return _seed_rows(seeds).filter(F.lit(False))
    order = Window.partitionBy("key").orderBy("seed_order", "page_no")
    pages = _seed_rows(seeds).unionByName(_linked_rows(seeds, site, max_pages))
    first = pages.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(*_COLUMNS)
    return _seed_rows(seeds).unionByName(first.filter("page_no > 0"))


def fetch_plan(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Addresses whose cache key is not in the cached-page table."""
    keyed = wanted.select("url", urls.cache_key(F.col("url")).alias("cache_key")).distinct()
    return keyed.join(cached.select("cache_key").distinct(), "cache_key", "left_anti").select("url", "cache_key")
