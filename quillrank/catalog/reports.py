"""Queries over reports, payloads, labels, fields and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.catalog.selection import SOURCES_SQL, backfill_batch_sql, sources_pending
from quillrank.catalog.views import AS_OF, SCORED_SQL, SITE, scored_view, table
from quillrank.config import ELIGIBLE
from quillrank.operators import payloads as work
from quillrank.operators import reports, selection
from quillrank.plans import reports as jobs
from quillrank.session import shared_folder
from quillrank.sources import sinks
from quillrank.sources.state import SnapshotStore

_ELIGIBLE_SQL = ", ".join(f"'{d}'" for d in ELIGIBLE)
_TITLE = "Item Site/Summit Watchlist: 2017-2023"


def report_counts(spark, folder):
    return reports.summary_counts(scored_view(spark, folder))


def report_rollup(spark, folder):
    return reports.rollup_counts(scored_view(spark, folder))


def source_distinct(spark, folder):
    """Items of each source over two runs: exact numbers, and whether the merged sketches come within three standard errors."""
    items = scored_view(spark, folder)
    runs = [items.filter("lang <> 'fr'"), items.filter("lang <> 'de'")]
    estimated = reports.merged_distinct(*(reports.distinct_sketches(r) for r in runs))
    exact = runs[0].union(runs[1]).filter("source is not null").groupBy("source").agg(F.count_distinct("url").alias("addresses"))
    close = F.abs(F.col("distinct_items") - F.col("addresses")) <= F.greatest(F.lit(1.0), 3 * 0.0163 * F.col("addresses"))
    return estimated.join(exact, "source").select("source", "runs", "addresses", close.alias("within_error"))


def watchlist_top(spark, folder):
    rows = reports.watchlist_top(scored_view(spark, folder), 2017, 2023, 3)
    return rows.select("report_year", "decision", "number", "url", "title", "score")


def edition_top(spark, folder):
    rows = reports.watchlist_top(scored_view(spark, folder), 2017, 2023, 3, "conference_year")
    return rows.select("report_year", "decision", "number", "url", "title", "score")


def weekly_top(spark, folder):
    rows = reports.weekly_top(selection.weekly_eligible(scored_view(spark, folder)), 12)
    return rows.select("decision", "number", "url", "title", "score")


def _lines(df):
    return df.select(F.array_join(F.transform("part", lambda p: p.cast("string")), ".").alias("part"), "line")


def watchlist_lines(spark, folder):
    rows = selection.filtered(scored_view(spark, folder), start_year=2017, end_year=2023)
    return _lines(reports.watchlist_lines(rows, 2017, 2023, 3, AS_OF, _TITLE))


def weekly_lines(spark, folder):
    rows = selection.weekly_eligible(scored_view(spark, folder))
    return _lines(reports.weekly_lines(rows, 12, AS_OF, "Item Site/Summit Weekly Watchlist"))


def review_lines(spark, folder):
    queue = selection.unreported(scored_view(spark, folder), list(ELIGIBLE))
    return reports.review_lines(queue, "Review batch").select("part", "url", "line_no", "line")


def report_text(spark, folder):
    """The weekly report written by its job from a store, and its file read back."""
    store = SnapshotStore(spark, shared_folder(spark, "items"))
    store.commit(scored_view(spark, folder), "seed")
    path = shared_folder(spark, "report")
    jobs.weekly_report(store, path, 12, AS_OF, "Item Site/Summit Weekly Watchlist")
    return spark.read.text(path).select(F.col("value").alias("line"))


def backfill_documents(spark, folder):
    batch = selection.backfill_batch(scored_view(spark, folder), 40, list(ELIGIBLE), 2016, 2030)
    return sinks.backfill_documents(batch, SITE)


def source_documents(spark, folder):
    return sinks.source_documents(sources_pending(spark, folder))


def payloads(spark, folder):
    rows = work.payloads(scored_view(spark, folder), SITE)
    return rows.select("url", "title", "body", F.array_join("labels", "|").alias("labels"))


def payload_documents(spark, folder):
    return sinks.preview_rows(scored_view(spark, folder), SITE)


def labels_needed(spark, folder):
    """Labels in use that do not exist yet; the source names count as existing."""
    existing = table(spark, folder, "documents").select(F.concat(F.lit("topic/"), F.col("lang")).alias("label"))
    existing = existing.unionByName(scored_view(spark, folder).select(F.concat(F.lit("year/"), F.col("conference_year").cast("string")).alias("label")))
    return work.labels_needed(scored_view(spark, folder), existing.filter("label is not null"), SITE)


def _board_fields(spark, folder):
    """Fields of a board, made of the nations: some fit the specification, one twice."""
    n = table(spark, folder, "nation")
    key = F.col("n_nationkey")
    names = F.array(*[F.lit(x) for x in ("Status ", "Year", " Decision", "Score", "Speaker", "Status")])
    name = F.coalesce(F.get(names, key), F.col("n_name"))
    select = key.isin(0, 2, 5)
    words = F.array(*[F.lit(x) for x in ("Backlog", "Queued", "watch", "skim", "transcript", "background")])
    options = F.transform(words, lambda w: F.struct(F.concat(F.lit("o"), key.cast("string"), F.lit("-"), w).alias("id"), w.alias("name")))
    return n.select(
        key.alias("pos"), F.concat(F.lit("f"), key.cast("string")).alias("id"), name.alias("name"),
        F.when(select, F.lit(work.SELECT_TYPE)).otherwise(F.lit("ProjectV2Field")).alias("type"),
        F.when(select, options).alias("options"),
    )


def field_rows(spark, folder):
    return work.field_rows(scored_view(spark, folder), _board_fields(spark, folder), "Backlog").withColumn(
        "option_id", F.coalesce("option_id", F.lit(""))
    )


def fields_missing(spark, folder):
    rows = work.fields_missing(work.field_specs(spark), _board_fields(spark, folder))
    return rows.select("name", "data_type", F.array_join("options", ",").alias("options"))


def export_rows(spark, folder):
    rows = sinks.export_rows(scored_view(spark, folder))
    return rows.select(
        *[c for c in rows.columns if c not in ("published_date", "fetched_at", "updated_at")],
        F.col("published_date").cast("string").alias("published"),
    )


def slug_sql(expr: str) -> str:
    return f"replace(replace(lower(trim({expr})), 'ß', 'ss'), ' ', '-')"


_LABELS_SQL = f"""list_sort(list_distinct(list_concat(list_concat(
  ['video', 'summit', 'decision/' || decision], CASE WHEN year IS NOT NULL THEN ['year/' || year] ELSE [] END),
  list_transform(tags, lambda t: 'topic/' || {slug_sql('t')}))))"""

_SHORT_SQL = "format('{:g}', score)"
_RANKED_SQL = "row_number() OVER (PARTITION BY {year}, decision ORDER BY score DESC NULLS LAST, title, url)"
_WHO_SQL = """CASE WHEN coalesce(speaker, '') = '' AND coalesce(company, '') = '' THEN ''
  ELSE ' - ' || concat_ws(', ', nullif(speaker, ''), nullif(company, '')) END"""
_LINK_SQL = "coalesce(nullif(presentation_url, ''), url)"
_BUCKET_SQL = "list_position(['watch', 'skim', 'transcript', 'background', 'skip'], decision)"
_CAP_SQL = "upper(left(decision, 1)) || substr(decision, 2)"

PAYLOAD_SQL = f"""
pay AS (
  SELECT url,
    '[' || coalesce(CAST(year AS VARCHAR), 'unknown-year') || '][' || coalesce(nullif(conference, ''), 'Summit') || '] ' || title AS title,
    '- Presentation: ' || {_LINK_SQL} || chr(10) || '- Speaker: ' || coalesce(nullif(speaker, ''), 'Unknown') || chr(10) ||
    '- Company: ' || coalesce(nullif(company, ''), 'Unknown') || chr(10) ||
    '- Year: ' || coalesce(CAST(year AS VARCHAR), 'unknown-year') || chr(10) ||
    '- Conference: ' || coalesce(nullif(conference, ''), 'Summit') || chr(10) || '- Score: ' || {_SHORT_SQL} || chr(10) ||
    '- Decision: ' || decision || chr(10) ||
    '- Duration: ' || coalesce(CAST(nullif(duration_minutes, 0) AS VARCHAR), 'Unknown') || ' minutes' || chr(10) || chr(10) ||
    'Why: ' || reason || chr(10) || chr(10) ||
    'Tags: ' || CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'none' END AS body,
    {_LABELS_SQL} AS labels
  FROM scored)"""

QUERIES = {
    "report_rollup": (
        report_rollup,
        f"""WITH {SCORED_SQL} SELECT year, decision, source, count(*) AS items, max(score) AS top_score,
  CAST(GROUPING_ID(year, decision, source) AS BIGINT) AS grouping_id FROM scored GROUP BY CUBE (year, decision, source)""",
    ),
    "source_distinct": (
        source_distinct,
        f"""WITH {SCORED_SQL},
runs AS (SELECT 1 AS run, source, url FROM scored WHERE lang <> 'fr' UNION ALL SELECT 2, source, url FROM scored WHERE lang <> 'de')
SELECT source, count(DISTINCT run) AS runs, count(DISTINCT url) AS addresses, true AS within_error FROM runs WHERE source IS NOT NULL GROUP BY source""",
    ),
    "report_counts": (
        report_counts,
        f"""WITH {SCORED_SQL} SELECT count(*) AS total, count(*) FILTER (decision = 'watch') AS watch,
  count(*) FILTER (decision = 'skim') AS skim, count(*) FILTER (decision = 'skip') AS skipped FROM scored""",
    ),
    "watchlist_top": (
        watchlist_top,
        f"""WITH {SCORED_SQL} SELECT year AS report_year, decision, CAST({_RANKED_SQL.format(year='year')} AS INTEGER) AS number, url, title, score
FROM scored WHERE year BETWEEN 2017 AND 2023 QUALIFY number <= 3""",
    ),
    "edition_top": (
        edition_top,
        f"""WITH {SCORED_SQL} SELECT conference_year AS report_year, decision,
  CAST({_RANKED_SQL.format(year='conference_year')} AS INTEGER) AS number, url, title, score
FROM scored WHERE conference_year BETWEEN 2017 AND 2023 QUALIFY number <= 3""",
    ),
    "weekly_top": (
        weekly_top,
        f"""WITH {SCORED_SQL}, best AS (
  SELECT * FROM scored WHERE decision IN ({_ELIGIBLE_SQL})
  ORDER BY score DESC NULLS LAST, year ASC NULLS FIRST, decision, title, url LIMIT 12)
SELECT decision, CAST(row_number() OVER (PARTITION BY decision ORDER BY score DESC, year ASC NULLS FIRST, title, url) AS INTEGER) AS number,
  url, title, score FROM best""",
    ),
    "watchlist_lines": (
        watchlist_lines,
        f"""WITH {SCORED_SQL},
span AS (SELECT * FROM scored WHERE year BETWEEN 2017 AND 2023),
n AS (SELECT count(*) AS t, count(*) FILTER (decision = 'watch') AS w, count(*) FILTER (decision = 'skim') AS s,
  count(*) FILTER (decision = 'skip') AS k FROM span),
head AS (SELECT unnest(['# {_TITLE}', '', '## Summary', '', '- total crawled: ' || t, '- total watch: ' || w,
  '- total skim: ' || s, '- total skipped: ' || k, '- date generated: 2025-06-30']) AS line, unnest(range(9)) AS i FROM n),
top AS (
  SELECT *, {_RANKED_SQL.format(year='year')} AS number, {_BUCKET_SQL} AS b FROM span QUALIFY number <= 3),
groups AS (SELECT DISTINCT year, decision, b FROM top),
years AS (SELECT DISTINCT year FROM top)
SELECT '-1.0.0.' || i AS part, line FROM head
UNION ALL SELECT year || '.0.0.0', '' FROM years
UNION ALL SELECT year || '.0.0.1', '## ' || year FROM years
UNION ALL SELECT year || '.' || b || '.0.0', '' FROM groups
UNION ALL SELECT year || '.' || b || '.0.1', '### ' || {_CAP_SQL} FROM groups
UNION ALL SELECT year || '.' || b || '.0.2', '' FROM groups
UNION ALL SELECT year || '.' || b || '.' || number || '.0', number || '. ' || title || {_WHO_SQL} || ' - ' || {_SHORT_SQL} FROM top
UNION ALL SELECT year || '.' || b || '.' || number || '.1', '   - URL: ' || {_LINK_SQL} FROM top
UNION ALL SELECT year || '.' || b || '.' || number || '.2', '   - Why: ' || reason FROM top
UNION ALL SELECT year || '.' || b || '.' || number || '.3', '   - Tags: ' || array_to_string(tags, ', ') FROM top WHERE len(tags) > 0""",
    ),
    "weekly_lines": (
        weekly_lines,
        f"""WITH {SCORED_SQL}, best AS (
  SELECT *, {_BUCKET_SQL} AS b FROM scored WHERE decision IN ({_ELIGIBLE_SQL})
  ORDER BY score DESC NULLS LAST, year ASC NULLS FIRST, decision, title, url LIMIT 12),
top AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY score DESC, year ASC NULLS FIRST, title, url) AS number FROM best),
groups AS (SELECT DISTINCT decision, b FROM top)
SELECT '-1.0.0.0' AS part, '# Item Site/Summit Weekly Watchlist: 2025-06-30' AS line
UNION ALL SELECT '0.' || b || '.0.0', '' FROM groups
UNION ALL SELECT '0.' || b || '.0.1', '## ' || {_CAP_SQL} FROM groups
UNION ALL SELECT '0.' || b || '.0.2', '' FROM groups
UNION ALL SELECT '0.' || b || '.' || number || '.0', number || '. [' || title || '](' || {_LINK_SQL} || ') - ' || {_SHORT_SQL} FROM top
UNION ALL SELECT '0.' || b || '.' || number || '.1', '   - Why: ' || reason FROM top""",
    ),
    "review_lines": (
        review_lines,
        f"""WITH {SCORED_SQL}, queue AS (SELECT * FROM scored WHERE issue_number IS NULL AND decision IN ({_ELIGIBLE_SQL}))
SELECT CAST(0 AS INTEGER) AS part, NULL AS url, CAST(unnest(range(4)) AS INTEGER) AS line_no, unnest(['# Review batch', '', 'Review queue:', '']) AS line
UNION ALL SELECT 1, url, CAST(0 AS INTEGER),
  '- [ ] [' || title || '](' || {_LINK_SQL} || ')' || {_WHO_SQL} || ' - ' || {_SHORT_SQL} || ' (' || decision || ')' AS line FROM queue
UNION ALL SELECT 1, url, 1, '  - Why: ' || reason FROM queue
UNION ALL SELECT 1, url, 2, '  - Tags: ' || array_to_string(tags, ', ') FROM queue WHERE len(tags) > 0""",
    ),
    "backfill_documents": (
        backfill_documents,
        f"""WITH {SCORED_SQL},{PAYLOAD_SQL},
batch AS ({backfill_batch_sql()})
SELECT kind, batch.url AS url, CAST(CASE WHEN kind = 'repair'
  THEN to_json({{'url': s.url, 'title': s.title, 'issue_number': s.github_issue_number, 'issue_url': s.github_issue_url}})
  ELSE to_json({{'url': pay.url, 'title': pay.title, 'body': pay.body, 'labels': pay.labels}}) END AS VARCHAR) AS document
FROM batch JOIN scored s ON s.doc_id = batch.doc_id JOIN pay ON pay.url = batch.url""",
    ),
    "source_documents": (
        source_documents,
        f"""WITH {SOURCES_SQL} SELECT source_url,
  CAST(to_json({{'source_url': source_url, 'year': year, 'ordinal': ordinal, 'source_name': source_name}}) AS VARCHAR) AS document FROM sources
WHERE source_url NOT IN (SELECT source_url FROM ledger) ORDER BY year DESC, ordinal LIMIT 18""",
    ),
    "payloads": (
        payloads,
        f"WITH {SCORED_SQL},{PAYLOAD_SQL} SELECT url, title, body, array_to_string(labels, '|') AS labels FROM pay",
    ),
    "payload_documents": (
        payload_documents,
        f"""WITH {SCORED_SQL},{PAYLOAD_SQL}
SELECT url, CAST(to_json({{'url': url, 'title': title, 'body': body, 'labels': labels}}) AS VARCHAR) AS document FROM pay""",
    ),
    "labels_needed": (
        labels_needed,
        f"""WITH {SCORED_SQL}, used AS (SELECT DISTINCT unnest({_LABELS_SQL}) AS label FROM scored),
existing AS (SELECT 'topic/' || lang AS label FROM documents UNION SELECT 'year/' || conference_year FROM scored WHERE conference_year IS NOT NULL)
SELECT label, CASE WHEN label LIKE 'decision/%' THEN '0969da' WHEN label LIKE 'year/%' THEN '6f42c1'
  WHEN label LIKE 'topic/%' THEN '1f883d' ELSE '57606a' END AS color
FROM used WHERE label NOT IN (SELECT label FROM existing)""",
    ),
    "field_rows": (
        field_rows,
        f"""WITH {SCORED_SQL},
vals AS (
  SELECT url, 'f0' AS field_id, 'Status' AS name, 'select' AS kind, 'Backlog' AS value, 'o0-Backlog' AS option_id FROM scored
  UNION ALL SELECT url, 'f1', 'Year', 'number', CAST(year AS VARCHAR), '' FROM scored
  UNION ALL SELECT url, 'f2', 'Decision', 'select', decision, 'o2-' || decision FROM scored WHERE decision <> 'skip'
  UNION ALL SELECT url, 'f3', 'Score', 'number', CAST(score AS VARCHAR), '' FROM scored
  UNION ALL SELECT url, 'f4', 'Speaker', 'text', speaker, '' FROM scored)
SELECT * FROM vals WHERE value IS NOT NULL""",
    ),
    "fields_missing": (
        fields_missing,
        """WITH spec(name, data_type, options) AS (VALUES
  ('Status', 'SINGLE_SELECT', 'Backlog,Queued,Watching,Watched,Skipped,Rewatch'), ('Year', 'NUMBER', ''),
  ('Decision', 'SINGLE_SELECT', 'watch,skim,transcript,background,skip'), ('Score', 'NUMBER', ''), ('Speaker', 'TEXT', ''),
  ('Conference', 'TEXT', ''), ('Presentation URL', 'TEXT', '')),
board AS (SELECT trim(CASE n_nationkey WHEN 0 THEN 'Status ' WHEN 1 THEN 'Year' WHEN 2 THEN ' Decision' WHEN 3 THEN 'Score'
  WHEN 4 THEN 'Speaker' WHEN 5 THEN 'Status' ELSE n_name END) AS name FROM nation)
SELECT name, data_type, options FROM spec WHERE name NOT IN (SELECT name FROM board)""",
    ),
    "export_rows": (
        export_rows,
        f"""WITH {SCORED_SQL}
SELECT url, title, presentation_url, summary, year, conference_year, speaker, company, duration_minutes, source, conference, track,
  view_count, like_count, CAST(to_json(topics) AS VARCHAR) AS topics, has_video, has_slides, has_transcript, score, decision, reason,
  CAST(to_json(tags) AS VARCHAR) AS tags, CAST(published_date AS VARCHAR) AS published FROM scored""",
    ),
}

QUERIES["report_text"] = (report_text, f"SELECT line FROM ({QUERIES['weekly_lines'][1]})")
