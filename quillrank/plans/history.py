"""Working through archive sources: which to read, what came of each."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.config import Settings
from quillrank.operators.cards import page_results, result_items, spread
from quillrank.operators.merge import (
    canonical_items,
    last_writes,
    overlay_detail,
    upsert,
    with_write_defaults,
)
from quillrank.operators.detail import detail_items
from quillrank.operators.scoring import score_items
from quillrank.operators.transitions import upsert_ledger
from quillrank.plans.crawl import item_records
from quillrank.schema import ITEM, conform
from quillrank.sources.state import SnapshotStore

MISSING_PAGE = "page not available"


def read_pages(pages: DataFrame, settings: Settings) -> DataFrame:
    """Every page once: ``source_url, page_no, error, found`` (its items).

    ``pages``: source_url, page_no, url, html, error. Markup that cannot be read is
    an error of its page like one that came with it.
    """
    results = page_results(spread(pages), settings.site)
    return results.withColumn("error", F.coalesce("error", "walk_error")).drop("walk_error")


def source_outcomes(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Sources with ``error``: the first page error, or that there is no page at all."""
    state = results.groupBy("source_url").agg(
        F.count("*").alias("_pages"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_no"))).alias("_error"),
    )
    joined = sources.join(state, "source_url", "left")
    error = F.when(F.col("_pages").isNull(), F.lit(MISSING_PAGE)).otherwise(F.col("_error"))
    return joined.withColumn("error", F.substring(error, 1, 500)).drop("_pages", "_error")


def source_rows(outcomes: DataFrame, results: DataFrame, settings: Settings) -> DataFrame:
    """Item writes of all sources whose pages are complete, stamped with the edition year.

    The join moves short records of a source, never its page texts.
    """
    good = outcomes.filter(F.col("error").isNull())
    # Sources are worked through newest first, so a later write has a smaller year.
    good = good.select("source_url", "ordinal", (-F.col("year")).alias("edition_order"))
    found = result_items(results.drop("error").withColumn("walk_error", F.lit(None)), settings.site)
    rows = item_records(found, ("source_url", "page_no"))
    return rows.join(good, "source_url").withColumn("conference_year", (-F.col("edition_order")).cast("int"))


def run_results(outcomes: DataFrame, rows: DataFrame, run_ts: datetime) -> DataFrame:
    """One ledger line per source; the count is of writes, not of distinct items."""
    counts = rows.groupBy("source_url").agg(F.count("*").alias("row_count"))
    joined = outcomes.join(counts, "source_url", "left")
    failed = F.col("error").isNotNull()
    return joined.select(
        "source_url",
        "year",
        "source_name",
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, 0).otherwise(F.coalesce("row_count", F.lit(0))).cast("bigint").alias("row_count"),
        "error",
        F.lit(run_ts).cast("timestamp").alias("attempted_at"),
        F.lit(0).alias("seq"),
    )


def collapsed_rows(rows: DataFrame, settings: Settings, run_ts: datetime, details: DataFrame | None = None) -> DataFrame:
    """One scored record per address out of all writes of a run."""
    order = ("edition_order", "ordinal", "page_no", "pos")
    one = last_writes(
        with_write_defaults(canonical_items(rows.drop("source_url"), settings.site), run_ts), order
    )
    if details is not None:
        detail = canonical_items(detail_items(spread(details), settings.site), settings.site)
        detail = detail.groupBy("url").agg(
            F.max_by(F.struct(*[c for c in detail.columns if c != "url"]), F.struct("page_id")).alias("_d")
        ).select("url", "_d.*")
        one = overlay_detail(one, detail)
    return score_items(conform(one, ITEM), settings)


def run_sources(
    items: SnapshotStore,
    ledger: SnapshotStore,
    sources: DataFrame,
    pages: DataFrame,
    settings: Settings,
    run_ts: datetime,
    run_id: str,
    details: DataFrame | None = None,
) -> None:
    """Read all given sources in one job, then record what came of each.

    Pages are read once, into a folder of the run; items and counts both come from
    there and so always match. The items go first: if the ledger write is lost, the sources are simply
    read again and the upsert changes nothing.
    """
    spark = items.spark
    folder = f"{items.path}/runs/{hashlib.sha256(run_id.encode()).hexdigest()[:16]}"
    results = read_pages(pages, settings)
    results.write.mode("overwrite").parquet(f"{folder}/pages")
    results = spark.read.schema(results.schema).parquet(f"{folder}/pages")
    outcomes = source_outcomes(sources, results)
    outcomes.write.mode("overwrite").parquet(f"{folder}/outcomes")
    outcomes = spark.read.schema(outcomes.schema).parquet(f"{folder}/outcomes")
    rows = source_rows(outcomes, results, settings)
    new = collapsed_rows(rows, settings, run_ts, details)
    items.update(lambda state: upsert(state, new, settings.site, (), collapsed=True), run_id)
    lines = run_results(outcomes, rows, run_ts)
    ledger.update(lambda old: upsert_ledger(old, lines), run_id)
