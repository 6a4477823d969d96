"""Listings, queues and candidate batches over the stored items.

NULLs sort as smallest everywhere, and every order ends with the address, so
results do not depend on how rows are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.config import ELIGIBLE, Site
from quillrank.functions import urls


def list_order() -> list[Column]:
    return [
        F.col("year").asc_nulls_first(),
        F.col("decision").asc_nulls_first(),
        F.col("score").desc_nulls_last(),
        F.col("title").asc_nulls_first(),
        F.col("url").asc(),
    ]


def score_first() -> list[Column]:
    return [
        F.col("score").desc_nulls_last(),
        F.col("year").desc_nulls_last(),
        F.col("title").asc_nulls_first(),
        F.col("url").asc(),
    ]


def latest_first() -> list[Column]:
    return [F.col("year").desc_nulls_last(), F.col("published_date").desc_nulls_last()] + [
        F.col("score").desc_nulls_last(),
        F.col("title").asc_nulls_first(),
        F.col("url").asc(),
    ]


def filtered(
    items: DataFrame,
    decisions: Sequence[str] | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
    year: int | None = None,
    conference_year: int | None = None,
) -> DataFrame:
    """Typed filters that reach the scan. Undated items fail a year filter; no decisions means all."""
    if year is not None:
        items = items.filter(F.col("year") == year)
    if start_year is not None:
        items = items.filter(F.col("year") >= start_year)
    if end_year is not None:
        items = items.filter(F.col("year") <= end_year)
    if conference_year is not None:
        items = items.filter(F.col("conference_year") == conference_year)
    if decisions:
        items = items.filter(F.col("decision").isin(*decisions))
    return items


def list_items(items: DataFrame, **filters) -> DataFrame:
    return filtered(items, **filters).orderBy(*list_order())


def unreported(items: DataFrame, decisions: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Items in no issue yet, best first."""
    queue = filtered(items, decisions).filter(F.col("issue_number").isNull()).orderBy(*score_first())
    return queue if limit is None else queue.limit(limit)


def best_per_key(items: DataFrame) -> DataFrame:
    """The best item of each slash-insensitive address.

    The rank filter is pushed below the shuffle: per task and key one row is sent.
    """
    order = Window.partitionBy("_key").orderBy(
        F.col("score").desc_nulls_last(), F.col("title").asc_nulls_first(), F.col("url").asc()
    )
    keyed = items.withColumn("_key", urls.item_key(F.col("presentation_url"), F.col("url")))
    return keyed.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def published_keys(items: DataFrame) -> DataFrame:
    """Addresses any of whose rows already has an issue."""
    done = items.filter(F.col("github_issue_number").isNotNull() | F.col("issue_number").isNotNull())
    return done.select(urls.item_key(F.col("presentation_url"), F.col("url")).alias("_key")).distinct()


def open_items(
    items: DataFrame,
    decisions: Sequence[str] | None = None,
    as_of: date | None = None,
    recent_days: int | None = None,
    waiting: DataFrame | None = None,
    **filters,
) -> DataFrame:
    """One item per address that has no issue under any slash variant.

    ``waiting`` has the ``_key`` of addresses whose issue is on its way.

    All rows of an address share the fate of its key, so picking the best row
    first and dropping published keys second gives the same items with one row
    per key on either side of the anti join: no key can be hot.
    """
    rows = filtered(items, decisions, **filters).filter(
        F.col("github_issue_number").isNull() & F.col("issue_number").isNull()
    )
    if recent_days is not None:
        rows = rows.filter(F.col("published_date") >= F.date_sub(F.lit(as_of).cast("date"), recent_days))
    done = published_keys(items)
    if waiting is not None:
        done = done.unionByName(waiting.select("_key").distinct())
    return best_per_key(rows).join(done, "_key", "left_anti").drop("_key")


def sync_candidates(items: DataFrame, limit: int, latest: bool = False, **filters) -> DataFrame:
    order = latest_first() if latest else score_first()
    return open_items(items, **filters).orderBy(*order).limit(limit)


def repair_candidates(
    items: DataFrame,
    limit: int,
    decisions: Sequence[str] | None = None,
    latest: bool = False,
    waiting: DataFrame | None = None,
    **filters,
) -> DataFrame:
    """Items whose issue exists but is not on the project board, nor on its way there."""
    rows = filtered(items, decisions, **filters).filter(
        F.col("github_issue_number").isNotNull()
        & F.col("github_issue_url").isNotNull()
        & F.col("github_project_item_id").isNull()
    )
    if waiting is not None:
        rows = rows.join(waiting.select("url").distinct(), "url", "left_anti")
    return rows.orderBy(*(latest_first() if latest else score_first())).limit(limit)


def backfill_batch(
    items: DataFrame,
    limit: int,
    decisions: Sequence[str] | None,
    start_year: int | None = None,
    end_year: int | None = None,
    with_project: bool = True,
    waiting: DataFrame | None = None,
) -> DataFrame:
    """Repairs first, new items in what is left of the budget, latest first in each.

    ``waiting`` (kind, _key, url) is what an outbox already holds; it is not picked again.
    """
    span = {"start_year": start_year, "end_year": end_year}
    of = {k: waiting.filter(F.col("kind") == k) if waiting is not None else None for k in ("create", "repair")}
    new = sync_candidates(items, limit, latest=True, decisions=decisions, waiting=of["create"], **span).withColumn("kind", F.lit("create"))
    if not with_project:
        return new
    repair = repair_candidates(items, limit, decisions, latest=True, waiting=of["repair"], **span).withColumn("kind", F.lit("repair"))
    return repair.unionByName(new).orderBy(F.col("kind").desc(), *latest_first()).limit(limit)


def latest_year(items: DataFrame) -> DataFrame:
    return items.agg(F.max("year").alias("latest_year"))


def weekly_eligible(items: DataFrame) -> DataFrame:
    return items.filter(F.col("decision").isin(*ELIGIBLE))


def historical_sources(years: DataFrame, site: Site) -> DataFrame:
    """Archive addresses of every year: five known forms each, newest year first."""
    base, key = f"https://{site.host}", site.event_key
    # Source names and address forms, newest form first.
    forms = [
        (f"{key}-sf", f"{base}/{key}-san-francisco-", "/"),
        (f"{key}-sf-legacy", f"{base}/conferences/{key}sf", "/"),
        (f"{key}-newyork", f"{base}/{key}-new-york-", "/"),
        (f"{key}-newyork-legacy", f"{base}/{key}-newyork-", "/"),
        (f"{key}-london", f"{base}/{key}-london-", "/"),
    ]
    year = F.col("year").cast("string")
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("source_name"),
                F.concat(F.lit(head), year, F.lit(tail)).alias("source_url"),
            )
            for i, (name, head, tail) in enumerate(forms)
        ]
    )
    return years.select("year", F.inline(rows))


def year_span(spark, start_year: int, end_year: int) -> DataFrame:
    return spark.range(start_year, end_year + 1).select(F.col("id").cast("int").alias("year"))


def pending_sources(
    sources: DataFrame, ledger: DataFrame, limit: int, retry_failed: bool = False
) -> DataFrame:
    """Sources not attempted yet; with ``retry_failed`` only successes count as attempts."""
    done = ledger.filter(F.col("status") == "success") if retry_failed else ledger
    left = sources.join(done.select("source_url").distinct(), "source_url", "left_anti")
    return left.orderBy(F.col("year").desc(), "ordinal").limit(limit)
