"""Queries over merging, upserts, snapshots, state changes and the stream."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from quillrank.catalog.extraction import PAGE_SITE, _FACTS_SQL, _LINKS_SQL, card_pages, detail_pages
from quillrank.catalog.reports import PAYLOAD_SQL
from quillrank.catalog.selection import LATEST_SQL, open_sql
from quillrank.catalog.views import ITEMS_SQL, RUN_TS, SCORED_SQL, SETTINGS, SITE, item_view, scored_view, table
from quillrank.config import Settings, Site
from quillrank.functions import urls
from quillrank.operators import detail, links, merge, transitions
from quillrank.plans import history
from quillrank.schema import ITEM, LEDGER, STATE, conform, upgrade_state
from quillrank.session import shared_folder
from quillrank.sources.state import SnapshotStore, text_rows, typed_rows
from quillrank.streaming.ingest import ingest_pages, page_stream, queue_work, run_into_store

_SHOWN = ["title", "summary", "year", "conference_year", "speaker", "company", "duration_minutes", "conference", "view_count",
          "like_count", "has_video", "has_slides", "has_transcript", "watch_status", "issue_number", "issue_url",
          "github_issue_number", "github_issue_url", "github_issue_node_id", "github_project_item_id"]


def _shown(df, *more):
    return df.select(
        *more, "url", "presentation_url", *_SHOWN, F.col("published_date").cast("string").alias("published"),
        F.array_join("topics", "|").alias("topics"),
    )


_SHOWN_SQL = ", ".join(["url", "presentation_url", *_SHOWN]) + ", CAST(published_date AS VARCHAR) AS published, array_to_string(topics, '|') AS topics"


def detail_overlay(spark, folder):
    """Items with the facts of their detail pages; neighbours share an address."""
    items = item_view(spark, folder)
    facts = detail.detail_items(detail_pages(spark, folder), SITE)
    # The detail of document n belongs to the slashed address of the pair n.
    rows = merge.overlay_detail(items, facts)
    return rows.select(
        "doc_id", "url", "title", "summary", F.col("published_date").cast("string").alias("published"), "year",
        "speaker", "duration_minutes", "conference", "has_video", "has_slides", "has_transcript", "track", "source",
    )


def year_filter(spark, folder):
    rows = merge.inside_years(item_view(spark, folder), 2018, 2020)
    return rows.select("doc_id", "url", "year")


def write_defaults(spark, folder):
    """Defaults on items that lack a year, a link and times."""
    bare = item_view(spark, folder).withColumns(
        {"year": F.when(F.col("doc_id") % 2 == 0, 0).otherwise(F.lit(None)).cast("int"),
         "fetched_at": F.when(F.col("doc_id") % 3 == 0, F.col("fetched_at"))}
    )
    rows = merge.with_write_defaults(bare, RUN_TS)
    return rows.select(
        "doc_id", "presentation_url", "year",
        F.col("fetched_at").cast("string").alias("fetched"), F.col("updated_at").cast("string").alias("updated"),
    )


def _two_runs(spark, folder):
    """A first run without the French documents, a second one without the German."""
    view = item_view(spark, folder)
    first = view.filter("lang <> 'fr'")
    second = view.filter("lang <> 'de'").withColumns(
        {"title": F.concat(F.lit("new "), F.col("title")), "speaker": F.lit(None).cast("string"),
         "fetched_at": F.lit(datetime(2025, 1, 1)).cast("timestamp")}
    )
    return first, second


def _writes(rows):
    return rows.select("doc_id", *ITEM.names)


def upsert_items(spark, folder):
    first, second = _two_runs(spark, folder)
    empty = spark.createDataFrame([], STATE)
    state = merge.upsert(empty, _writes(first), SITE, ["doc_id"])
    marks = first.filter("issue_number is not null").select(
        urls.canonical(F.col("url"), SITE).alias("url"), "issue_number", "issue_url",
        F.lit(RUN_TS).cast("timestamp").alias("at"), F.col("doc_id").alias("seq"),
    )
    state = transitions.mark_reported(state, marks)
    rows = merge.upsert(state, _writes(second), SITE, ["doc_id"])
    return _shown(rows, F.col("fetched_at").cast("string").alias("fetched"))


def last_writes(spark, folder):
    """All writes of a run collapsed to one row per address."""
    rows = merge.last_writes(merge.canonical_items(_writes(item_view(spark, folder)), SITE), ["doc_id"])
    return rows.select("url", "title", "year", "conference_year", "company", "view_count")


def schema_upgrade(spark, folder):
    """A snapshot from before the newer columns existed."""
    old = item_view(spark, folder).drop(
        "conference_year", "github_issue_node_id", "github_project_item_id", "last_synced_at", "watch_status", "tags"
    ).withColumn("presentation_url", F.lit(None).cast("string"))
    rows = upgrade_state(old.drop("doc_id", "lang", "github_issue_number", "github_issue_url"))
    return _shown(rows, F.size("tags").alias("tag_count"))


def text_state_roundtrip(spark, folder):
    """State written as text rows and read back as typed rows."""
    rows = typed_rows(text_rows(item_view(spark, folder).drop("doc_id", "lang")))
    return _shown(rows, F.col("updated_at").cast("string").alias("updated"))


def snapshot_roundtrip(spark, folder):
    """Items upserted into a new store, rescored values read back from the snapshot."""
    store = SnapshotStore(spark, shared_folder(spark, "snapshot"))
    store.update(lambda state: merge.upsert(state, _writes(scored_view(spark, folder)), SITE, ["doc_id"]), "first")
    return store.read().select("url", "title", "score", "decision", "watch_status")


_COMPARED = ["title", "summary", "conference_year", "speaker", "company", "view_count"]


def changes_between(spark, folder):
    """Two runs into a store, the second without some items: what happened to each row."""
    first, second = _two_runs(spark, folder)
    store = SnapshotStore(spark, shared_folder(spark, "items"))
    store.update(lambda state: merge.upsert(state, _writes(first), SITE, ["doc_id"]), "first")
    kept = F.col("view_count").isNull() | (F.col("view_count") % 10 != 3)
    store.update(lambda state: merge.upsert(state, _writes(second), SITE, ["doc_id"]).filter(kept), "second")
    rows = store.changes(1, 2, _COMPARED)
    return rows.select("url", "kind", F.array_join("changed", "|").alias("changed"))


def _label_events(spark, folder, *columns):
    items = item_view(spark, folder).select("doc_id", "url")
    labels = table(spark, folder, "labels").join(items, "doc_id")
    number = F.col("doc_id") + 100000
    made = {
        "issue_number": number,
        "issue_url": F.concat(F.lit("https://tracker.example.org/new/"), number.cast("string")),
        "node_id": F.concat(F.lit("NODE"), F.col("doc_id").cast("string")),
        "project_item_id": F.concat(F.lit("ITEM"), F.col("doc_id").cast("string")),
        "at": F.lit(RUN_TS).cast("timestamp"),
        "seq": F.col("doc_id"),
    }
    return labels.select("url", *[made[c].alias(c) for c in (*columns, "at", "seq")])


def mark_reported(spark, folder):
    rows = transitions.mark_reported(item_view(spark, folder), _label_events(spark, folder, "issue_number", "issue_url"))
    return _shown(rows, "doc_id", F.col("last_reported_at").cast("string").alias("reported"))


def record_issues(spark, folder):
    events = _label_events(spark, folder, "issue_number", "issue_url", "node_id")
    rows = transitions.record_issues(item_view(spark, folder), events)
    return _shown(rows, "doc_id", F.col("last_synced_at").cast("string").alias("synced"))


def record_project_items(spark, folder):
    rows = transitions.record_project_items(item_view(spark, folder), _label_events(spark, folder, "project_item_id"))
    return _shown(rows, "doc_id", F.col("last_synced_at").cast("string").alias("synced"))


def ledger_upsert(spark, folder):
    """Customers as known sources, orders as attempts on them."""
    source = F.concat(F.lit("https://items.example.org/c"), F.col("key").cast("string"))
    known = table(spark, folder, "customer").filter("c_mktsegment <> 'BUILDING'").withColumn("key", F.col("c_custkey"))
    ledger = known.select(
        source.alias("source_url"), F.lit(2001).alias("year"), F.col("c_name").alias("source_name"),
        F.lit("failed").alias("status"), F.lit(0).cast("bigint").alias("row_count"), F.lit("old").alias("error"),
        F.lit(datetime(2000, 1, 1)).cast("timestamp").alias("attempted_at"),
    )
    orders = table(spark, folder, "orders").withColumn("key", F.col("o_custkey"))
    ok = F.col("o_orderstatus") != "F"
    results = orders.select(
        source.alias("source_url"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("source_name"),
        F.when(ok, "success").otherwise("failed").alias("status"), F.col("o_orderkey").alias("row_count"),
        F.when(~ok, F.lit("page not available")).alias("error"), F.col("o_orderdate").alias("attempted_at"),
        F.col("o_orderkey").alias("seq"),
    )
    return transitions.upsert_ledger(conform(ledger, LEDGER), results).withColumn(
        "attempted_at", F.col("attempted_at").cast("string")
    )


_SOURCE_SETTINGS = Settings(site=PAGE_SITE)


def _archive(spark, folder):
    """Hosts as sources with their pages; one host cannot be read."""
    pages = table(spark, folder, "pages")
    host = urls.netloc(F.col("url"))
    feed = host == "spam-farm.example.org"
    read = pages.select(
        host.alias("source_url"), F.col("page_id").alias("page_no"), "url", "html",
        F.when(feed, F.lit("410 gone")).alias("error"),
    )
    sources = read.select("source_url").distinct().select(
        "source_url", F.lit(2020).alias("year"), F.lit(0).alias("ordinal"), F.col("source_url").alias("source_name")
    )
    return sources, read


def source_runs(spark, folder):
    """Hosts as sources: outcome and number of item writes of each."""
    sources, read = _archive(spark, folder)
    results = history.read_pages(read, _SOURCE_SETTINGS)
    outcomes = history.source_outcomes(sources, results)
    rows = history.source_rows(outcomes, results, _SOURCE_SETTINGS)
    return history.run_results(outcomes, rows, RUN_TS).select("source_url", "year", "source_name", "status", "row_count", "error")


def _worked_off(spark, folder):
    """The same sources read into stores."""
    sources, read = _archive(spark, folder)
    items = SnapshotStore(spark, shared_folder(spark, "items"))
    ledger = SnapshotStore(spark, shared_folder(spark, "ledger"), LEDGER, "source_url")
    history.run_sources(items, ledger, sources, read, _SOURCE_SETTINGS, RUN_TS, "run")
    return items, ledger


def source_run_items(spark, folder):
    items, _ = _worked_off(spark, folder)
    return items.read().select("url", "title", "conference_year", "watch_status")


def source_run_ledger(spark, folder):
    _, ledger = _worked_off(spark, folder)
    return ledger.read().select("source_url", "year", "source_name", "status", "row_count", "error")


def source_run_details(spark, folder):
    """Card pages in five sources, worked off together with the items' detail pages."""
    cards = card_pages(spark, folder)
    name = F.concat(F.lit("archive "), (F.col("page_id") % 5).cast("string"))
    read = cards.select(name.alias("source_url"), F.col("page_id").alias("page_no"), "url", "html", F.lit(None).cast("string").alias("error"))
    sources = read.select("source_url").distinct().select(
        "source_url", F.lit(2020).alias("year"), F.lit(0).alias("ordinal"), F.col("source_url").alias("source_name")
    )
    items = SnapshotStore(spark, shared_folder(spark, "items"))
    ledger = SnapshotStore(spark, shared_folder(spark, "ledger"), LEDGER, "source_url")
    settings = replace(SETTINGS, site=Site())
    history.run_sources(items, ledger, sources, read, settings, RUN_TS, "run", detail_pages(spark, folder))
    return items.read().select(
        "url", "title", "year", "conference_year", "speaker", "duration_minutes", "has_video", "has_slides", "has_transcript",
        F.col("published_date").cast("string").alias("published"),
    )


def _page_records(pages):
    """Item records of a batch of pages, one per address: the last page wins."""
    rows = links.item_links(pages, PAGE_SITE)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in ITEM.fields if f.name not in rows.columns}
    rows = rows.withColumns(missing).select(*ITEM.names, "page_id", "pos")
    return conform(merge.last_writes(merge.with_write_defaults(rows, RUN_TS), ["page_id", "pos"]), ITEM)


def ingest_stream(spark, folder):
    """The page table read as a stream into a new store."""
    store = SnapshotStore(spark, shared_folder(spark, "ingest"))
    # The table may be one file or a folder of files.
    stream = page_stream(spark, f"{folder}/pages.parquet*")
    run_into_store(stream, store, shared_folder(spark, "offsets"), _page_records, SETTINGS)
    return store.read().select("url", "title", "presentation_url", "watch_status")


def ingest_items(spark, folder):
    """Card pages in several files, one file a micro-batch: cards, scores, one merge."""
    pages = shared_folder(spark, "pages")
    card_pages(spark, folder).repartition(4, "page_id").write.parquet(pages)
    store = SnapshotStore(spark, shared_folder(spark, "ingest"))
    stream = page_stream(spark, pages, files_per_batch=1)
    ingest_pages(stream, store, shared_folder(spark, "offsets"), replace(SETTINGS, site=Site()), RUN_TS)
    return store.read().select("url", "title", "year", "duration_minutes", "track", "has_video", "has_transcript", "watch_status")


def outbox_items(spark, folder):
    """Work queued three times from the same items: each address once."""
    store = SnapshotStore(spark, shared_folder(spark, "items"))
    store.commit(scored_view(spark, folder), "seed")
    settings = replace(SETTINGS, sync={**SETTINGS.sync, "batch_limit": 30}, start_year=2016, end_year=2024)
    outbox = shared_folder(spark, "outbox")
    for run in ("a", "b", "b", "c"):
        queue_work(store, settings, outbox, run)
    return spark.read.parquet(outbox).select("kind", "url", "title")


_TWO_RUNS_SQL = f"""{ITEMS_SQL},
keyed AS (SELECT *, rtrim(url, '/') || '/' AS key, rtrim(coalesce(presentation_url, url), '/') || '/' AS link FROM items),
run1 AS (SELECT * FROM keyed WHERE lang <> 'fr'),
run2 AS (SELECT * REPLACE ('new ' || title AS title, NULL AS speaker) FROM keyed WHERE lang <> 'de'),
last1 AS (SELECT * FROM run1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) = 1),
last2 AS (SELECT * FROM run2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) = 1),
cy AS (
  SELECT key, arg_max(conference_year, (run, doc_id)) AS conference_year FROM (
    SELECT key, 1 AS run, doc_id, conference_year FROM run1 UNION ALL SELECT key, 2, doc_id, conference_year FROM run2)
  WHERE conference_year IS NOT NULL GROUP BY key),
marks AS (SELECT * FROM run1 WHERE issue_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) = 1),
merged AS (
  SELECT * FROM last2 UNION ALL SELECT * FROM last1 WHERE key NOT IN (SELECT key FROM last2))"""

_DETAIL_SQL = """det AS (
  SELECT 'https://items.example.org/presentations/d' || doc_id || '/' AS url,
    CASE doc_id % 6 WHEN 4 THEN 'Heading ' || title WHEN 5 THEN NULL ELSE title END AS title,
    CASE WHEN doc_id % 6 < 4 THEN text ELSE 'Meta ' || title END AS summary,
    CASE WHEN doc_id % 6 < 4 THEN day END AS day,
    CASE WHEN doc_id % 6 IN (0, 3) THEN 'Ann ' || doc_id || ', Bo ' || doc_id WHEN doc_id % 6 = 1 THEN 'Ann ' || doc_id END AS speaker,
    CASE WHEN doc_id % 6 < 4 AND doc_id % 5 > 1 THEN nullif((doc_id % 3) * 60 + doc_id % 50 + CASE WHEN doc_id % 60 >= 30 THEN 1 ELSE 0 END, 0) END AS minutes,
    (doc_id % 6 < 4 AND doc_id % 3 = 0) OR doc_id % 7 = 0 AS v, doc_id % 4 = 0 AS s, doc_id % 2 = 0 AS t
  FROM facts)"""

_EVENTS_SQL = f"""{ITEMS_SQL},
ev AS (
  SELECT i.url, max(l.doc_id) AS d FROM labels l JOIN items i USING (doc_id) GROUP BY i.url)"""

_STATUS_SQL = "CASE WHEN d IS NOT NULL AND watch_status = 'new' THEN 'queued' ELSE watch_status END AS watch_status"
_ISSUE_SQL = (
    "CASE WHEN d IS NOT NULL THEN d + 100000 ELSE issue_number END AS issue_number, "
    "CASE WHEN d IS NOT NULL THEN 'https://tracker.example.org/new/' || (d + 100000) ELSE issue_url END AS issue_url"
)

QUERIES = {
    "detail_overlay": (
        detail_overlay,
        f"""WITH {ITEMS_SQL},
{_FACTS_SQL},
{_DETAIL_SQL}
SELECT i.doc_id, i.url, coalesce(d.title, i.title) AS title, coalesce(nullif(d.summary, ''), i.summary) AS summary,
  CAST(coalesce(d.day, i.published_date) AS VARCHAR) AS published, CAST(coalesce(year(d.day), i.year) AS INTEGER) AS year,
  coalesce(d.speaker, i.speaker) AS speaker, CAST(coalesce(d.minutes, i.duration_minutes) AS INTEGER) AS duration_minutes,
  i.conference, i.has_video OR coalesce(d.v, false) AS has_video, i.has_slides OR coalesce(d.s, false) AS has_slides,
  i.has_transcript OR coalesce(d.t, false) AS has_transcript, i.track, i.source
FROM items i LEFT JOIN det d ON i.url = d.url""",
    ),
    "year_filter": (
        year_filter,
        f"WITH {ITEMS_SQL} SELECT doc_id, url, year FROM items WHERE year IS NULL OR year BETWEEN 2018 AND 2020",
    ),
    "write_defaults": (
        write_defaults,
        f"""WITH {ITEMS_SQL} SELECT doc_id, coalesce(presentation_url, url) AS presentation_url,
  CAST(year(published_date) AS INTEGER) AS year,
  CASE WHEN doc_id % 3 = 0 THEN '2024-01-01 00:00:00' ELSE '2025-07-01 00:00:00' END AS fetched,
  '2025-07-01 00:00:00' AS updated FROM items""",
    ),
    "upsert_items": (
        upsert_items,
        f"""WITH {_TWO_RUNS_SQL}
SELECT m.key AS url, m.link AS presentation_url, m.title, m.summary, m.year, c.conference_year, m.speaker, m.company,
  m.duration_minutes, m.conference, m.view_count, m.like_count, m.has_video, m.has_slides, m.has_transcript,
  CASE WHEN k.key IS NOT NULL THEN 'queued' ELSE 'new' END AS watch_status, k.issue_number, k.issue_url,
  CAST(NULL AS BIGINT) AS github_issue_number, CAST(NULL AS VARCHAR) AS github_issue_url,
  CAST(NULL AS VARCHAR) AS github_issue_node_id, CAST(NULL AS VARCHAR) AS github_project_item_id,
  CAST(m.published_date AS VARCHAR) AS published, array_to_string(m.topics, '|') AS topics,
  CASE WHEN m.key IN (SELECT key FROM last1) THEN '2024-01-01 00:00:00' ELSE '2025-01-01 00:00:00' END AS fetched
FROM merged m LEFT JOIN cy c ON m.key = c.key LEFT JOIN marks k ON m.key = k.key""",
    ),
    "changes_between": (
        changes_between,
        f"""WITH {_TWO_RUNS_SQL},
cy1 AS (SELECT key, arg_max(conference_year, doc_id) AS conference_year FROM run1 WHERE conference_year IS NOT NULL GROUP BY key),
was AS (SELECT l.* REPLACE (c.conference_year AS conference_year) FROM last1 l LEFT JOIN cy1 c ON l.key = c.key),
now AS (
  SELECT m.* REPLACE (c.conference_year AS conference_year) FROM merged m LEFT JOIN cy c ON m.key = c.key
  WHERE m.view_count IS NULL OR m.view_count % 10 <> 3)
SELECT coalesce(w.key, n.key) AS url,
  CASE WHEN w.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'gone' WHEN diff <> '' THEN 'changed' ELSE 'same' END AS kind,
  CASE WHEN w.key IS NULL OR n.key IS NULL THEN '' ELSE diff END AS changed
FROM was w FULL OUTER JOIN now n ON w.key = n.key, LATERAL (SELECT concat_ws('|', {', '.join(f"CASE WHEN w.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in _COMPARED)}) AS diff)""",
    ),
    "last_writes": (
        last_writes,
        f"""WITH {ITEMS_SQL},
keyed AS (SELECT *, rtrim(url, '/') || '/' AS key FROM items)
SELECT k.key AS url, title, year, c.conference_year, company, view_count FROM keyed k
LEFT JOIN (SELECT key, arg_max(conference_year, doc_id) AS conference_year FROM keyed WHERE conference_year IS NOT NULL GROUP BY key) c ON k.key = c.key
QUALIFY row_number() OVER (PARTITION BY k.key ORDER BY doc_id DESC) = 1""",
    ),
    "schema_upgrade": (
        schema_upgrade,
        f"""WITH {ITEMS_SQL},
old AS (
  SELECT * REPLACE (url AS presentation_url, CAST(NULL AS INTEGER) AS conference_year, 'new' AS watch_status,
    issue_number AS github_issue_number, issue_url AS github_issue_url,
    CAST(NULL AS VARCHAR) AS github_issue_node_id, CAST(NULL AS VARCHAR) AS github_project_item_id) FROM items)
SELECT {_SHOWN_SQL}, CAST(0 AS INTEGER) AS tag_count FROM old""",
    ),
    "text_state_roundtrip": (
        text_state_roundtrip,
        f"""WITH {ITEMS_SQL},
full_items AS (
  SELECT * REPLACE (coalesce(presentation_url, url) AS presentation_url,
    CASE WHEN github_issue_number IS NULL AND issue_number IS NOT NULL THEN issue_url ELSE github_issue_url END AS github_issue_url,
    coalesce(github_issue_number, issue_number) AS github_issue_number) FROM items)
SELECT {_SHOWN_SQL}, '2024-01-02 00:00:00' AS updated FROM full_items""",
    ),
    "snapshot_roundtrip": (
        snapshot_roundtrip,
        f"""WITH {SCORED_SQL}
SELECT rtrim(url, '/') || '/' AS url, title, score, decision, 'new' AS watch_status FROM scored
QUALIFY row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY doc_id DESC) = 1""",
    ),
    "mark_reported": (
        mark_reported,
        f"""WITH {_EVENTS_SQL},
hit AS (SELECT i.*, e.d FROM items i LEFT JOIN ev e ON i.url = e.url),
after AS (SELECT * EXCLUDE (issue_number, issue_url, watch_status), {_ISSUE_SQL}, {_STATUS_SQL} FROM hit)
SELECT doc_id, {_SHOWN_SQL}, CASE WHEN d IS NOT NULL THEN '2025-07-01 00:00:00' END AS reported FROM after""",
    ),
    "record_issues": (
        record_issues,
        f"""WITH {_EVENTS_SQL},
hit AS (SELECT i.*, e.d FROM items i LEFT JOIN ev e ON i.url = e.url),
after AS (
  SELECT * EXCLUDE (issue_number, issue_url, watch_status, github_issue_number, github_issue_url, github_issue_node_id),
    {_ISSUE_SQL}, {_STATUS_SQL},
    CASE WHEN d IS NOT NULL THEN d + 100000 ELSE github_issue_number END AS github_issue_number,
    CASE WHEN d IS NOT NULL THEN 'https://tracker.example.org/new/' || (d + 100000) ELSE github_issue_url END AS github_issue_url,
    CASE WHEN d IS NOT NULL THEN 'NODE' || d ELSE github_issue_node_id END AS github_issue_node_id
  FROM hit)
SELECT doc_id, {_SHOWN_SQL}, CASE WHEN d IS NOT NULL THEN '2025-07-01 00:00:00' END AS synced FROM after""",
    ),
    "record_project_items": (
        record_project_items,
        f"""WITH {_EVENTS_SQL},
hit AS (SELECT i.*, e.d FROM items i LEFT JOIN ev e ON i.url = e.url),
after AS (
  SELECT * REPLACE (CASE WHEN d IS NOT NULL THEN 'ITEM' || d ELSE github_project_item_id END AS github_project_item_id) FROM hit)
SELECT doc_id, {_SHOWN_SQL}, CASE WHEN d IS NOT NULL THEN '2025-07-01 00:00:00' END AS synced FROM after""",
    ),
    "ledger_upsert": (
        ledger_upsert,
        """WITH known AS (SELECT c_custkey AS key, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'),
seen AS (
  SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS row_count,
    arg_max(o_orderdate, o_orderkey) AS last_at, arg_min(year(o_orderdate), o_orderkey) AS first_year,
    arg_min(o_orderpriority, o_orderkey) AS first_name
  FROM orders GROUP BY 1)
SELECT 'https://items.example.org/c' || coalesce(k.key, s.key) AS source_url,
  CAST(CASE WHEN k.key IS NOT NULL THEN 2001 ELSE first_year END AS INTEGER) AS year,
  CASE WHEN k.key IS NOT NULL THEN c_name ELSE first_name END AS source_name,
  CASE WHEN s.key IS NULL OR status = 'F' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN s.key IS NULL THEN 0 ELSE row_count END AS row_count,
  CASE WHEN s.key IS NULL THEN 'old' WHEN status = 'F' THEN 'page not available' END AS error,
  CASE WHEN s.key IS NULL THEN '2000-01-01 00:00:00' ELSE strftime(last_at, '%Y-%m-%d %H:%M:%S') END AS attempted_at
FROM known k FULL OUTER JOIN seen s ON k.key = s.key""",
    ),
    "source_runs": (
        source_runs,
        rf"""WITH {_LINKS_SQL},
ok AS (
  SELECT *, regexp_extract(rtrim(regexp_extract(href, '^([^?#;]*)', 1), '/'), '([^/]*)$', 1) AS slug FROM full_links),
found AS (
  SELECT DISTINCT page_id, page_url, CASE WHEN regexp_extract(link_url, '^[a-z]+://([^/?#]*)', 1) LIKE '%example.com'
    THEN rtrim(regexp_extract(link_url, '^([^?#;]*)', 1), '/') || '/' ELSE link_url END AS url
  FROM ok WHERE slug <> '' AND NOT regexp_matches(slug, '^\d+$') AND title <> '' AND lower(title) NOT IN ('la', 'the')),
hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
counts AS (SELECT regexp_extract(page_url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n FROM found GROUP BY 1)
SELECT h.host AS source_url, CAST(2020 AS INTEGER) AS year, h.host AS source_name,
  CASE WHEN h.host = 'spam-farm.example.org' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN h.host = 'spam-farm.example.org' THEN 0 ELSE coalesce(n, 0) END AS row_count,
  CASE WHEN h.host = 'spam-farm.example.org' THEN '410 gone' END AS error
FROM hosts h LEFT JOIN counts c ON h.host = c.host""",
    ),
    "source_run_items": (
        source_run_items,
        rf"""WITH {_LINKS_SQL},
ok AS (
  SELECT *, regexp_extract(rtrim(regexp_extract(href, '^([^?#;]*)', 1), '/'), '([^/]*)$', 1) AS slug FROM full_links
  WHERE regexp_extract(page_url, '^[a-z]+://([^/?#]*)', 1) <> 'spam-farm.example.org'),
named AS (
  SELECT *, CASE WHEN regexp_extract(link_url, '^[a-z]+://([^/?#]*)', 1) LIKE '%example.com'
    THEN rtrim(regexp_extract(link_url, '^([^?#;]*)', 1), '/') || '/' ELSE link_url END AS url
  FROM ok WHERE slug <> '' AND NOT regexp_matches(slug, '^\d+$') AND title <> '' AND lower(title) NOT IN ('la', 'the')),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1)
SELECT url, title, CAST(2020 AS INTEGER) AS conference_year, 'new' AS watch_status FROM firsts
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC, pos DESC) = 1""",
    ),
    "source_run_details": (
        source_run_details,
        f"""WITH {_FACTS_SQL},
{_DETAIL_SQL}
SELECT c.url, coalesce(d.title, c.title) AS title, CAST(coalesce(year(d.day), c.year) AS INTEGER) AS year, CAST(2020 AS INTEGER) AS conference_year,
  coalesce(d.speaker, c.speaker) AS speaker, CAST(coalesce(d.minutes, c.duration_minutes) AS INTEGER) AS duration_minutes,
  c.has_video OR coalesce(d.v, false) AS has_video, coalesce(d.s, false) AS has_slides, c.has_transcript OR coalesce(d.t, false) AS has_transcript,
  coalesce(CAST(d.day AS VARCHAR), c.published) AS published
FROM cards c LEFT JOIN det d ON c.url = d.url""",
    ),
    "ingest_items": (
        ingest_items,
        f"""WITH {_FACTS_SQL}
SELECT url, title, year, duration_minutes, track, has_video, has_transcript, 'new' AS watch_status FROM cards""",
    ),
    "outbox_items": (
        outbox_items,
        f"""WITH {SCORED_SQL},{open_sql('AND year BETWEEN 2016 AND 2024')},{PAYLOAD_SQL},
best AS (SELECT url FROM open_items ORDER BY {LATEST_SQL} LIMIT 90)
SELECT 'create' AS kind, pay.url, pay.title FROM pay JOIN best ON pay.url = best.url""",
    ),
    "ingest_stream": (
        ingest_stream,
        rf"""WITH {_LINKS_SQL},
ok AS (
  SELECT *, regexp_extract(rtrim(regexp_extract(href, '^([^?#;]*)', 1), '/'), '([^/]*)$', 1) AS slug FROM full_links),
named AS (
  SELECT *, CASE WHEN regexp_extract(link_url, '^[a-z]+://([^/?#]*)', 1) LIKE '%example.com'
    THEN rtrim(regexp_extract(link_url, '^([^?#;]*)', 1), '/') || '/' ELSE link_url END AS url
  FROM ok WHERE slug <> '' AND NOT regexp_matches(slug, '^\d+$') AND title <> '' AND lower(title) NOT IN ('la', 'the')),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1)
SELECT url, title, url AS presentation_url, 'new' AS watch_status FROM firsts
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC, pos DESC) = 1""",
    ),
}

# The ledger of a run says what the run's results say.
QUERIES["source_run_ledger"] = (source_run_ledger, QUERIES["source_runs"][1])
