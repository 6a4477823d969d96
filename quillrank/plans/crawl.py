"""From pages to stored items: extract, filter, enrich, score, upsert."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.config import Settings
from quillrank.operators.cards import page_items, spread
from quillrank.operators.detail import detail_items
from quillrank.operators.merge import (
    canonical_items,
    inside_years,
    last_writes,
    overlay_detail,
    upsert,
    with_write_defaults,
)
from quillrank.operators.scoring import score_items
from quillrank.schema import ITEM, conform
from quillrank.sources.state import SnapshotStore


def extracted_items(pages: DataFrame, settings: Settings, seq: Sequence[str]) -> DataFrame:
    """Item records of all pages, with the columns that order their writes."""
    return item_records(page_items(spread(pages), settings.site), seq)


def item_records(found: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Items with all record fields, and the columns that order their writes."""
    record = conform(found.drop(*seq, "pos"), ITEM).columns
    missing = {f.name: F.lit(None).cast(f.dataType) for f in ITEM.fields if f.name not in found.columns}
    return found.withColumns(missing).select(*record, *seq, "pos")


def crawl_items(
    pages: DataFrame,
    settings: Settings,
    run_ts: datetime,
    details: DataFrame | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
    seq: Sequence[str] = ("page_id",),
) -> DataFrame:
    """One scored record per address found on ``pages``.

    Copies of an address are collapsed before the detail join: the detail is the
    same for all of them, so joining first would only carry more rows. The join
    and the later merge then reuse the partitioning by address.
    """
    rows = inside_years(extracted_items(pages, settings, seq), start_year, end_year)
    rows = with_write_defaults(canonical_items(rows, settings.site), run_ts)
    rows = last_writes(rows, [*seq, "pos"])
    if details is not None:
        detail = canonical_items(detail_items(spread(details), settings.site), settings.site)
        detail = detail.groupBy("url").agg(
            F.max_by(F.struct(*[c for c in detail.columns if c != "url"]), F.struct("page_id")).alias("_d")
        ).select("url", "_d.*")
        rows = inside_years(overlay_detail(rows, detail), start_year, end_year)
        rows = rows.withColumn("year", F.coalesce("year", F.year("published_date")))
    return score_items(conform(rows, ITEM), settings)


def crawl(store: SnapshotStore, pages: DataFrame, settings: Settings, run_ts: datetime, run_id: str, **options) -> int:
    """Crawl ``pages`` into the store as one new version."""
    new = crawl_items(pages, settings, run_ts, **options)
    return store.update(lambda state: upsert(state, new, settings.site, (), collapsed=True), run_id)


def rescore(store: SnapshotStore, settings: Settings, run_ts: datetime, run_id: str) -> int:
    """Score every stored item again. Keys stay, so nothing is joined."""
    def change(state: DataFrame) -> DataFrame:
        again = score_items(state, settings)
        return again.withColumn("updated_at", F.lit(run_ts).cast("timestamp"))

    return store.update(change, run_id)
