"""Overlaying details, year filter, defaults, and the upsert by canonical address."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import Site
from quillrank.functions import urls
from quillrank.functions.text import text_or_null
from quillrank.schema import ITEM, STATE, TRACKING, conform

# Kept from the first write of an item, or only replaced by a known value.
_STICKY = ("url", "conference_year", "fetched_at")
WRITTEN = [name for name in ITEM.names if name not in _STICKY]


def overlay_detail(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Detail facts win where present; flags add up; items without detail stay as they are.

    Both sides meet on ``url``. A detail page without any title does not
    overwrite the listing title.
    """
    texts = ("summary", "speaker", "conference")
    facts = ("published_date",)
    numbers = ("year", "duration_minutes")
    flags = ("has_video", "has_slides", "has_transcript")
    used = ["title", *texts, *facts, *numbers, *flags]
    d = detail.select("url", *[F.col(c).alias(f"_d_{c}") for c in used])
    joined = listing.join(d, "url", "left")
    title = F.nullif(text_or_null(F.col("_d_title")), F.lit("Untitled"))
    new: dict[str, Column] = {"title": F.coalesce(title, F.col("title"))}
    new |= {c: F.coalesce(text_or_null(F.col(f"_d_{c}")), F.col(c)) for c in texts}
    new |= {c: F.coalesce(F.col(f"_d_{c}"), F.col(c)) for c in facts}
    new |= {c: F.coalesce(F.nullif(F.col(f"_d_{c}"), F.lit(0)), F.col(c)) for c in numbers}
    new |= {
        c: F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"_d_{c}"), F.lit(False)) for c in flags
    }
    return joined.withColumns(new).select(*listing.columns)


def inside_years(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Drop items dated outside the range; undated items stay."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("year") >= start)
    if end is not None:
        inside = inside & (F.col("year") <= end)
    return df.filter(F.col("year").isNull() | inside)


def with_write_defaults(df: DataFrame, run_ts: datetime) -> DataFrame:
    """Fill what every stored item has."""
    now = F.lit(run_ts).cast("timestamp")
    return df.withColumns(
        {
            "presentation_url": F.coalesce(text_or_null(F.col("presentation_url")), F.col("url")),
            "year": F.coalesce(F.nullif(F.col("year"), F.lit(0)), F.year("published_date")),
            "fetched_at": F.coalesce(F.col("fetched_at"), now),
            "updated_at": now,
        }
    )


def canonical_items(df: DataFrame, site: Site) -> DataFrame:
    link = F.coalesce(text_or_null(F.col("presentation_url")), F.col("url"))
    return df.withColumn("presentation_url", urls.canonical(link, site)).withColumn(
        "url", urls.canonical(F.col("url"), site)
    )


def last_writes(batch: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Collapse a batch of writes to one row per address, as if written one by one.

    The last write in ``seq`` order wins as a whole; the edition year keeps its
    last known value and the fetch time its first. Aggregates combine before
    the shuffle, so copies of one address never gather in one task.
    """
    order = F.struct(*[F.col(c) for c in seq])
    others = [c for c in batch.columns if c not in (*_STICKY, *seq)]
    grouped = batch.groupBy("url").agg(
        F.max_by(F.struct(*others), order).alias("_last"),
        F.max_by("conference_year", F.when(F.col("conference_year").isNotNull(), order)).alias("conference_year"),
        F.min_by("fetched_at", order).alias("fetched_at"),
    )
    return grouped.select("url", "conference_year", "fetched_at", "_last.*")


def upsert(state: DataFrame, batch: DataFrame, site: Site, seq: Sequence[str], collapsed: bool = False) -> DataFrame:
    """New state after writing ``batch``.

    A written item replaces every descriptive column, NULLs included; it keeps
    its first fetch time, its publishing columns and its known edition year.
    ``collapsed`` says the batch already has one row per canonical address.
    """
    rows = batch if collapsed else last_writes(canonical_items(batch, site), seq)
    new = conform(rows, ITEM)
    new = new.select("url", F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in ITEM.names if c != "url"])
    old = state.withColumn("_old", F.lit(True))
    joined = old.join(new, "url", "full_outer")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    columns = {"url": F.col("url")}
    for name in ITEM.names:
        if name in WRITTEN:
            columns[name] = F.when(is_new, F.col(f"_n_{name}")).otherwise(F.col(name))
    columns["conference_year"] = F.coalesce("_n_conference_year", "conference_year")
    columns["fetched_at"] = F.when(is_old, F.col("fetched_at")).otherwise(F.col("_n_fetched_at"))
    for name in TRACKING.names:
        columns[name] = F.col(name)
    columns["watch_status"] = F.coalesce("watch_status", F.lit("new"))
    return joined.select(*[columns[name].alias(name) for name in STATE.names])


def differences(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``key, kind, changed, was, now`` of every row of two states with one row per ``key``.

    ``kind`` is new, gone, changed or same; ``changed`` names the columns that differ, of
    ``columns`` or of all; two NULLs are equal. ``was`` and ``now`` are the compared columns.
    """
    names = [c for c in (columns or after.columns) if c != key]
    old = before.select(key, F.struct(*names).alias("was"))
    new = after.select(key, F.struct(*names).alias("now"))
    joined = old.join(new, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col("was")[c].eqNullSafe(F.col("now")[c]), F.lit(c)) for c in names]))
    both = F.col("was").isNotNull() & F.col("now").isNotNull()
    joined = joined.withColumn("changed", F.when(both, changed).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.size("changed") > 0, "changed").otherwise("same")
    return joined.select(key, kind.alias("kind"), "changed", "was", "now")
