"""Queries over listings, queues and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.catalog.views import AS_OF, SCORED_SQL, SITE, scored_view, table
from quillrank.config import ELIGIBLE
from quillrank.session import shared_folder
from quillrank.operators import paging, selection

_COLUMNS_SQL = "doc_id, url, title, year, CAST(published_date AS VARCHAR) AS published, score, decision"
_ELIGIBLE_SQL = ", ".join(f"'{d}'" for d in ELIGIBLE)
LATEST_SQL = "year DESC NULLS LAST, published_date DESC NULLS LAST, score DESC NULLS LAST, title, url"
_SCORE_SQL = "score DESC NULLS LAST, year DESC NULLS LAST, title, url"
_KEY_SQL = "rtrim(coalesce(presentation_url, url), '/')"


def _shown() -> list:
    published = F.col("published_date").cast("string").alias("published")
    return ["doc_id", "url", "title", "year", published, "score", "decision"]


def _select(sql_rest: str) -> str:
    return f"WITH {SCORED_SQL} SELECT {_COLUMNS_SQL} FROM scored {sql_rest}"


def open_sql(where: str = "") -> str:
    """CTE ``open_items``: best open row per address."""
    return f"""
open_rows AS (
  SELECT *, row_number() OVER (PARTITION BY {_KEY_SQL} ORDER BY score DESC NULLS LAST, title, url) AS rn
  FROM scored t
  WHERE github_issue_number IS NULL AND issue_number IS NULL AND decision IN ({_ELIGIBLE_SQL}) {where}
    AND NOT EXISTS (
      SELECT 1 FROM scored s
      WHERE rtrim(coalesce(s.presentation_url, s.url), '/') = rtrim(coalesce(t.presentation_url, t.url), '/')
        AND (s.github_issue_number IS NOT NULL OR s.issue_number IS NOT NULL))
),
open_items AS (SELECT * FROM open_rows WHERE rn = 1)"""


def list_items(spark, folder):
    rows = selection.list_items(scored_view(spark, folder), start_year=2018, end_year=2021, decisions=["watch", "skim"])
    return rows.select(*_shown())


def list_numbered(spark, folder):
    """The whole listing numbered, two of its pages from the written numbers."""
    path = shared_folder(spark, "listing")
    paging.numbered(scored_view(spark, folder), selection.list_order()).select("number", *_shown()).write.parquet(path)
    listing = spark.read.parquet(path)
    first = listing.agg((F.max("number") / 3).cast("long")).first()[0] or 0
    pages = [paging.page(listing, after, 50).withColumn("page", F.lit(no)) for no, after in ((1, 0), (2, first))]
    return listing.withColumn("page", F.lit(0)).union(pages[0]).union(pages[1])


def edition_items(spark, folder):
    return selection.list_items(scored_view(spark, folder), conference_year=2019).select(*_shown())


def unreported_top(spark, folder):
    return selection.unreported(scored_view(spark, folder), list(ELIGIBLE), limit=30).select(*_shown())


def unreported_all(spark, folder):
    return selection.unreported(scored_view(spark, folder)).select(*_shown())


def open_items(spark, folder):
    return selection.open_items(scored_view(spark, folder), list(ELIGIBLE)).select(*_shown())


def canonical_dedupe(spark, folder):
    return selection.best_per_key(scored_view(spark, folder)).select("_key", *_shown()).withColumnRenamed("_key", "item_key")


def published_keys(spark, folder):
    return selection.published_keys(scored_view(spark, folder)).select(F.col("_key").alias("item_key"))


def sync_candidates_latest(spark, folder):
    rows = selection.sync_candidates(
        scored_view(spark, folder), 25, latest=True, decisions=list(ELIGIBLE), start_year=2016, end_year=2024
    )
    return rows.select(*_shown())


def sync_candidates_year(spark, folder):
    return selection.sync_candidates(scored_view(spark, folder), 25, decisions=list(ELIGIBLE), year=2020).select(*_shown())


def recent_candidates(spark, folder):
    rows = selection.open_items(scored_view(spark, folder), list(ELIGIBLE), as_of=AS_OF, recent_days=365)
    return rows.select(*_shown())


def repair_candidates(spark, folder):
    rows = selection.repair_candidates(
        scored_view(spark, folder), 25, list(ELIGIBLE), latest=True, start_year=2016, end_year=2030
    )
    return rows.select(*_shown(), "github_issue_number", "github_issue_url", "github_issue_node_id")


def backfill_batch(spark, folder):
    rows = selection.backfill_batch(scored_view(spark, folder), 40, list(ELIGIBLE), 2016, 2030)
    return rows.select("kind", *_shown())


def latest_year(spark, folder):
    return selection.latest_year(scored_view(spark, folder))


def weekly_eligible(spark, folder):
    return selection.weekly_eligible(scored_view(spark, folder)).select(*_shown())


def recent_events(spark, folder):
    """The recency filter and best-per-key choice on the event stream's users."""
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    recent = events.filter(F.col("day") >= F.date_sub(F.lit("2024-01-20").cast("date"), 7))
    return recent.groupBy("user_id").agg(
        F.count("*").alias("recent"), F.max_by("event_id", F.struct("value", "event_id")).alias("best_event")
    )


def _order_years(spark, folder):
    return table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")).distinct()


def _order_ledger(spark, folder):
    """Archive attempts read off the orders: one per year and priority before 1997."""
    orders = table(spark, folder, "orders").filter(F.col("o_orderdate") < "1997-01-01")
    ordinal = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    attempts = orders.groupBy(F.year("o_orderdate").alias("year"), ordinal.alias("ordinal")).agg(F.count("*").alias("n"))
    sources = selection.historical_sources(_order_years(spark, folder), SITE)
    status = F.when(F.col("ordinal") < 2, "success").otherwise("failed")
    return attempts.join(sources, ["year", "ordinal"]).withColumn("status", status)


def sources_all(spark, folder):
    """All archive addresses for the years of the orders, with the orders behind each."""
    orders = table(spark, folder, "orders")
    per_year = orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"))
    return selection.historical_sources(per_year.select("year"), SITE).join(per_year, "year")


def sources_pending(spark, folder):
    sources = selection.historical_sources(_order_years(spark, folder), SITE)
    return selection.pending_sources(sources, _order_ledger(spark, folder), 18)


def sources_retry(spark, folder):
    sources = selection.historical_sources(_order_years(spark, folder), SITE)
    return selection.pending_sources(sources, _order_ledger(spark, folder), 100, retry_failed=True)


SOURCES_SQL = """
years AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders FROM orders GROUP BY 1),
forms(ordinal, source_name, head) AS (VALUES
  (0, 'summit-sf', 'https://items.example.org/summit-san-francisco-'),
  (1, 'summit-sf-legacy', 'https://items.example.org/conferences/summitsf'),
  (2, 'summit-newyork', 'https://items.example.org/summit-new-york-'),
  (3, 'summit-newyork-legacy', 'https://items.example.org/summit-newyork-'),
  (4, 'summit-london', 'https://items.example.org/summit-london-')),
sources AS (SELECT year, orders, CAST(ordinal AS INTEGER) AS ordinal, source_name, head || year || '/' AS source_url FROM years CROSS JOIN forms),
attempts AS (
  SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS ordinal
  FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
ledger AS (
  SELECT s.source_url, CASE WHEN s.ordinal < 2 THEN 'success' ELSE 'failed' END AS status
  FROM attempts a JOIN sources s ON a.year = s.year AND a.ordinal = s.ordinal)"""

def backfill_batch_sql() -> str:
    """The batch over ``scored``, to stand alone or in brackets."""
    return f"""SELECT * FROM (WITH {open_sql('AND year BETWEEN 2016 AND 2030')},
repairs AS (
  SELECT 'repair' AS kind, {_COLUMNS_SQL} FROM scored
  WHERE github_issue_number IS NOT NULL AND github_issue_url IS NOT NULL AND github_project_item_id IS NULL
    AND decision IN ({_ELIGIBLE_SQL}) AND year BETWEEN 2016 AND 2030 ORDER BY {LATEST_SQL} LIMIT 40),
creates AS (
  SELECT 'create' AS kind, {_COLUMNS_SQL},
    row_number() OVER (ORDER BY {LATEST_SQL}) AS pos FROM open_items)
SELECT * FROM repairs UNION ALL
SELECT * EXCLUDE (pos) FROM creates WHERE pos <= greatest(40 - (SELECT count(*) FROM repairs), 0))"""


_LIST_SQL = "year ASC NULLS FIRST, decision ASC NULLS FIRST, score DESC NULLS LAST, title ASC NULLS FIRST, url"

QUERIES = {
    "list_numbered": (
        list_numbered,
        f"""WITH {SCORED_SQL},
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_LIST_SQL}) AS number, {_COLUMNS_SQL} FROM scored),
k AS (SELECT CAST(floor(max(number) / 3) AS BIGINT) AS after FROM n)
SELECT *, CAST(0 AS INTEGER) AS page FROM n UNION ALL SELECT *, CAST(1 AS INTEGER) FROM n WHERE number <= 50
UNION ALL SELECT n.*, CAST(2 AS INTEGER) FROM n, k WHERE number > after AND number <= after + 50""",
    ),
    "list_items": (list_items, _select("WHERE year BETWEEN 2018 AND 2021 AND decision IN ('watch', 'skim')")),
    "edition_items": (edition_items, _select("WHERE conference_year = 2019")),
    "unreported_top": (
        unreported_top,
        _select(f"WHERE issue_number IS NULL AND decision IN ({_ELIGIBLE_SQL}) ORDER BY {_SCORE_SQL} LIMIT 30"),
    ),
    "unreported_all": (unreported_all, _select("WHERE issue_number IS NULL")),
    "open_items": (open_items, f"WITH {SCORED_SQL},{open_sql()} SELECT {_COLUMNS_SQL} FROM open_items"),
    "canonical_dedupe": (
        canonical_dedupe,
        f"""WITH {SCORED_SQL}, ranked AS (
  SELECT *, {_KEY_SQL} AS item_key,
    row_number() OVER (PARTITION BY {_KEY_SQL} ORDER BY score DESC NULLS LAST, title, url) AS rn FROM scored)
SELECT item_key, {_COLUMNS_SQL} FROM ranked WHERE rn = 1""",
    ),
    "published_keys": (
        published_keys,
        f"WITH {SCORED_SQL} SELECT DISTINCT {_KEY_SQL} AS item_key FROM scored WHERE github_issue_number IS NOT NULL OR issue_number IS NOT NULL",
    ),
    "sync_candidates_latest": (
        sync_candidates_latest,
        f"WITH {SCORED_SQL},{open_sql('AND year >= 2016 AND year <= 2024')} SELECT {_COLUMNS_SQL} FROM open_items ORDER BY {LATEST_SQL} LIMIT 25",
    ),
    "sync_candidates_year": (
        sync_candidates_year,
        f"WITH {SCORED_SQL},{open_sql('AND year = 2020')} SELECT {_COLUMNS_SQL} FROM open_items ORDER BY {_SCORE_SQL} LIMIT 25",
    ),
    "recent_candidates": (
        recent_candidates,
        f"""WITH {SCORED_SQL},{open_sql("AND published_date >= DATE '2025-06-30' - 365")} SELECT {_COLUMNS_SQL} FROM open_items""",
    ),
    "repair_candidates": (
        repair_candidates,
        f"""WITH {SCORED_SQL} SELECT {_COLUMNS_SQL}, github_issue_number, github_issue_url, github_issue_node_id FROM scored
WHERE github_issue_number IS NOT NULL AND github_issue_url IS NOT NULL AND github_project_item_id IS NULL
  AND decision IN ({_ELIGIBLE_SQL}) AND year BETWEEN 2016 AND 2030 ORDER BY {LATEST_SQL} LIMIT 25""",
    ),
    "backfill_batch": (
        backfill_batch,
        f"WITH {SCORED_SQL} {backfill_batch_sql()}",
    ),
    "latest_year": (latest_year, f"WITH {SCORED_SQL} SELECT max(year) AS latest_year FROM scored"),
    "weekly_eligible": (weekly_eligible, _select(f"WHERE decision IN ({_ELIGIBLE_SQL})")),
    "recent_events": (
        recent_events,
        """SELECT user_id, count(*) AS recent,
  (array_agg(event_id ORDER BY value DESC, event_id DESC))[1] AS best_event
FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20' - 7 GROUP BY user_id""",
    ),
    "sources_all": (sources_all, f"WITH {SOURCES_SQL} SELECT year, ordinal, source_name, source_url, orders FROM sources"),
    "sources_pending": (
        sources_pending,
        f"""WITH {SOURCES_SQL} SELECT year, ordinal, source_name, source_url FROM sources
WHERE source_url NOT IN (SELECT source_url FROM ledger) ORDER BY year DESC, ordinal LIMIT 18""",
    ),
    "sources_retry": (
        sources_retry,
        f"""WITH {SOURCES_SQL} SELECT year, ordinal, source_name, source_url FROM sources
WHERE source_url NOT IN (SELECT source_url FROM ledger WHERE status = 'success') ORDER BY year DESC, ordinal LIMIT 100""",
    ),
}
