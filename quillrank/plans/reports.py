"""Report jobs: stored items, the report's filter, its lines, one file."""

from __future__ import annotations

from datetime import date

from quillrank.config import ELIGIBLE, Settings
from quillrank.operators import reports, selection
from quillrank.sources.sinks import write_long_report, write_report
from quillrank.sources.state import SnapshotStore


def report_years(store: SnapshotStore, settings: Settings, start_year: int | None = None, end_year: int | None = None) -> tuple[int, int]:
    """The years of a report: from the first configured to the latest stored one."""
    start = start_year or settings.start_year
    return start, end_year or selection.latest_year(store.read()).first()["latest_year"] or start


def watchlist_report(
    store: SnapshotStore,
    settings: Settings,
    path: str,
    top: int,
    as_of: date,
    title: str,
    start_year: int | None = None,
    end_year: int | None = None,
    edition: int | None = None,
) -> None:
    """The historical report. With ``edition`` only that edition's items count, whenever they were published."""
    if edition is not None:
        start = end = edition
        rows, column = selection.filtered(store.read(), conference_year=edition), "conference_year"
    else:
        start, end = report_years(store, settings, start_year, end_year)
        rows, column = selection.filtered(store.read(), start_year=start, end_year=end), "year"
    lines = reports.watchlist_lines(rows, start, end, top, as_of, f"{title}: {start}-{end}", column)
    write_report(lines, path)


def weekly_report(store: SnapshotStore, path: str, top: int, as_of: date, title: str) -> None:
    write_report(reports.weekly_lines(selection.weekly_eligible(store.read()), top, as_of, title), path)


def review_report(store: SnapshotStore, path: str, title: str, limit: int | None = None) -> None:
    """The checklist of unreported items; ``limit`` None takes all."""
    queue = selection.unreported(store.read(), list(ELIGIBLE), limit)
    write_long_report(reports.review_lines(queue, title), reports.review_order(), path)
