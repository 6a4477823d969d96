"""State changes that come back from publishing, and the source ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.schema import LEDGER


def _last_events(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One event per key, the last in ``seq`` order; combines before the shuffle."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("seq")).alias("_event"))
    return last.withColumn("_hit", F.lit(True))


def _apply(state: DataFrame, events: DataFrame, columns: list[str], new: dict[str, str | Column]) -> DataFrame:
    joined = state.join(_last_events(events, "url", columns), "url", "left")
    hit = F.col("_hit").isNotNull()

    def value(name: str) -> Column:
        source = new[name]
        return F.col(f"_event.{source}") if isinstance(source, str) else source

    changed = {name: F.when(hit, value(name)).otherwise(F.col(name)) for name in new}
    return joined.withColumns(changed).select(*state.columns)


def _queued() -> Column:
    return F.when(F.col("watch_status") == "new", F.lit("queued")).otherwise(F.col("watch_status"))


def mark_reported(state: DataFrame, events: DataFrame) -> DataFrame:
    """``events``: url, issue_number, issue_url, at, seq. Addresses match exactly."""
    return _apply(
        state,
        events,
        ["issue_number", "issue_url", "at"],
        {
            "issue_number": "issue_number",
            "issue_url": "issue_url",
            "last_reported_at": "at",
            "watch_status": _queued(),
        },
    )


def record_issues(state: DataFrame, events: DataFrame) -> DataFrame:
    """``events``: url, issue_number, issue_url, node_id, at, seq."""
    return _apply(
        state,
        events,
        ["issue_number", "issue_url", "node_id", "at"],
        {
            "github_issue_number": "issue_number",
            "github_issue_url": "issue_url",
            "github_issue_node_id": "node_id",
            "issue_number": "issue_number",
            "issue_url": "issue_url",
            "last_synced_at": "at",
            "watch_status": _queued(),
        },
    )


def record_project_items(state: DataFrame, events: DataFrame) -> DataFrame:
    """``events``: url, project_item_id, at, seq."""
    return _apply(
        state,
        events,
        ["project_item_id", "at"],
        {"github_project_item_id": "project_item_id", "last_synced_at": "at"},
    )


def upsert_ledger(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Record attempts. Year and name of a known source stay as first written.

    ``results``: source_url, year, source_name, status, row_count, error, attempted_at, seq.
    """
    outcome = ["status", "row_count", "error", "attempted_at"]
    new = results.groupBy("source_url").agg(
        F.max_by(F.struct(*outcome), F.col("seq")).alias("_last"),
        F.min_by(F.struct("year", "source_name"), F.col("seq")).alias("_first"),
    )
    old = ledger.withColumn("_old", F.lit(True))
    joined = old.join(new, "source_url", "full_outer")
    is_new, is_old = F.col("_last").isNotNull(), F.col("_old").isNotNull()
    columns = {
        "source_url": F.col("source_url"),
        **{c: F.when(is_old, F.col(c)).otherwise(F.col(f"_first.{c}")) for c in ("year", "source_name")},
        **{c: F.when(is_new, F.col(f"_last.{c}")).otherwise(F.col(c)) for c in outcome},
    }
    return joined.select(*[columns[c].alias(c) for c in LEDGER.names])
