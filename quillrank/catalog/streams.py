"""Queries over streams with state: changes of addresses, answers to queued work, counts by event time."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.catalog.extraction import PAGE_SITE
from quillrank.catalog.selection import LATEST_SQL, open_sql
from quillrank.catalog.views import SCORED_SQL, SETTINGS, scored_view, table
from quillrank.operators import links
from quillrank.session import shared_folder
from quillrank.sources.pages import read_saved_pages, save_pages, saved_page_id, saved_page_stream
from quillrank.sources.sinks import SETTLED, outbox_status
from quillrank.sources.state import SnapshotStore
from quillrank.streaming.changes import answered, changed_writes, windowed_counts, work_off, worked_off
from quillrank.streaming.ingest import queue_work

START = datetime(2025, 1, 1)
HOUR = timedelta(hours=1)
_TITLE = "(?is)<title>(.*?)</title>"


def _arrivals(spark: SparkSession, rows: DataFrame, parts: int, name: str) -> DataFrame:
    """``rows`` as a stream, one file after the other in the order of ``part``."""
    folder = shared_folder(spark, name)
    for part in range(parts):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{folder}/{part:03d}")
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def stream_changes(spark, folder):
    """Pages that come four times, some of them late, some twice, some with a new title: what each time was new."""
    pages = table(spark, folder, "pages")
    times = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter((F.col("page_id") + F.col("part")) % 4 != 0)
    late = F.when((F.col("page_id") % 7 == 0) & (F.col("part") == 2), 90).otherwise(0)
    at = F.lit(START).cast("timestamp") + F.make_dt_interval(hours=F.col("part"), mins=-late)
    title = F.concat(F.regexp_extract("html", _TITLE, 1), F.when((F.col("page_id") % 5 == 0) & (F.col("part") >= 2), " v2").otherwise(""))
    address = F.substring_index("url", "?", 1)
    writes = times.select(address.alias("url"), at.alias("at"), (F.col("page_id") * 10 + F.col("part")).alias("seq"), title.alias("title"), "part")
    stream = _arrivals(spark, writes, 4, "writes")
    out = shared_folder(spark, "changes")
    work_off(changed_writes(stream, ["title"], timedelta(days=30), 6 * HOUR), out, shared_folder(spark, "offsets"), "update")
    rows = spark.read.parquet(out).select("url", "kind", F.col("at").cast("string").alias("at"), "seq", "title")
    return rows


def outbox_retries(spark, folder):
    """Two runs queue work, the answers come in, a third run takes again what failed or was not answered in time."""
    store = SnapshotStore(spark, shared_folder(spark, "items"))
    store.commit(scored_view(spark, folder), "seed")
    settings = replace(SETTINGS, sync={**SETTINGS.sync, "batch_limit": 60}, start_year=2016, end_year=2024)
    outbox, settled = shared_folder(spark, "outbox"), shared_folder(spark, "settled")
    for run, day in (("a", 0), ("b", 5)):
        queue_work(store, settings, outbox, run, at=START + timedelta(days=day))
    asked = spark.read.parquet(outbox)
    number = F.regexp_extract("url", "d([0-9]+)/?$", 1).cast("long")
    # Of the first run every fourth is answered well, fails, is not answered, or is answered too late; of the second few are yet.
    answers = asked.filter((number % 4 != 2) & ((F.col("run") == "a") | (number % 4 == 0))).select(
        "kind", "_key", "run", (number % 4 != 1).alias("ok"),
        (F.col("queued_at") + F.when(number % 4 == 3, F.expr("INTERVAL 2 DAYS")).otherwise(F.expr("INTERVAL 1 HOUR"))).alias("answered_at"),
        F.when(F.col("run") == "a", 0).otherwise(1).alias("part"),
    )
    queue = _arrivals(spark, asked.withColumn("part", F.when(F.col("run") == "a", 0).otherwise(1)), 2, "asked")
    said = _arrivals(spark, answers, 2, "answers")
    work_off(answered(queue, said, timedelta(days=1), HOUR), settled, shared_folder(spark, "offsets"))
    known = worked_off(spark, settled, SETTLED)
    queue_work(store, settings, outbox, "c", at=START + timedelta(days=6), settled=known)
    return outbox_status(spark, outbox, known).select("run", "kind", "url", "status")


def windowed_outcomes(spark, folder):
    """Events of each day by type as the days close; those that arrive hours late apart."""
    events = table(spark, folder, "events")
    slow = F.when(F.col("event_id") % 13 == 0, F.col("event_id") % 700 + 121).otherwise(F.col("event_id") % 90)
    at = F.col("ts").cast("timestamp")
    timed = events.select(at.alias("at"), (at + F.make_dt_interval(mins=slow.cast("int"))).alias("arrived"), F.col("event_type").alias("type"))
    first, last = timed.agg(F.min("arrived"), F.max("arrived")).first()
    share = (F.unix_micros("arrived") - F.unix_micros(F.lit(first))) / max(1, int((last - first) / timedelta(microseconds=1)))
    stream = _arrivals(spark, timed.withColumn("part", F.least(F.floor(share * 4), F.lit(3))), 4, "events")
    out = shared_folder(spark, "counts")
    work_off(windowed_counts(stream, "type", 24 * HOUR, 2 * HOUR), out, shared_folder(spark, "offsets"))
    return spark.read.parquet(out).select(F.col("from").cast("string").alias("day"), F.col("kind").alias("type"), "late", "rows")


def saved_pages(spark, folder):
    """Pages saved as files, one each, read back as a batch and as a stream of several triggers: what links they have."""
    saved, out = shared_folder(spark, "saved"), shared_folder(spark, "read")
    pages = table(spark, folder, "pages")
    save_pages(pages, saved)
    # A trigger has its price, however few files it takes: with more pages triggers take more files, not more turns.
    least, turns = 100, 25
    total = pages.count()
    at_once = max(least, -(-total // turns))
    of = saved_page_id().alias("page")
    # Files end with the line break that was written after each page.
    html = F.substring("html", F.lit(1), F.length("html") - 1).alias("html")
    base = f"https://{PAGE_SITE.host}/"

    def found(rows, files):
        # By default a task reads some thirty files, however small they are, and writes one of its own.
        own = rows.select("page_id", "url", html, of).coalesce(max(64, files // 1000))
        return own.select("page", F.md5("html").alias("digest"), F.size(links.page_anchors(F.col("html"))).alias("anchors"))

    work_off(saved_page_stream(spark, saved, base, at_once), out, shared_folder(spark, "offsets"), each=lambda rows: found(rows, at_once))
    batch = found(read_saved_pages(spark, saved, base), total).withColumn("read", F.lit("batch"))
    return batch.union(spark.read.parquet(out).select(*batch.drop("read").columns, F.lit("stream").alias("read")))


_SAVED_SQL = r"""
WITH p AS (SELECT page_id AS page, md5(html) AS digest,
  CAST(len(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?i)<a\s[^>]*>')) AS INTEGER) AS anchors FROM pages)
SELECT *, unnest(['batch', 'stream']) AS read FROM p"""

_CHANGES_SQL = rf"""
WITH w AS (
  SELECT split_part(url, '?', 1) AS url, part, page_id * 10 + part AS seq,
    TIMESTAMP '2025-01-01' + to_hours(part) - to_minutes(CASE WHEN page_id % 7 = 0 AND part = 2 THEN 90 ELSE 0 END) AS t,
    regexp_extract(html, '{_TITLE}', 1) || CASE WHEN page_id % 5 = 0 AND part >= 2 THEN ' v2' ELSE '' END AS title
  FROM pages, (SELECT unnest(range(0, 4)) AS part) WHERE (page_id + part) % 4 <> 0),
k AS (SELECT *, epoch_us(t)::HUGEINT * 1000000000 + seq AS place FROM w),
s AS (SELECT *, max(place) OVER (PARTITION BY url ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
taken AS (SELECT *, row_number() OVER o AS n, lag(title) OVER o AS was FROM s WHERE before IS NULL OR place > before WINDOW o AS (PARTITION BY url ORDER BY place))
SELECT url, CASE WHEN n = 1 THEN 'new' ELSE 'changed' END AS kind, strftime(t, '%Y-%m-%d %H:%M:%S') AS at, seq, title
FROM taken WHERE n = 1 OR title IS DISTINCT FROM was"""

_RETRIES_SQL = f"""
WITH {SCORED_SQL},{open_sql('AND year BETWEEN 2016 AND 2024')},
ranked AS (
  SELECT url, row_number() OVER (ORDER BY {LATEST_SQL}) AS place, CAST(regexp_extract(url, 'd([0-9]+)/?$', 1) AS BIGINT) % 4 AS m FROM open_items),
first AS (
  SELECT 'a' AS run, url, place, CASE WHEN m = 0 THEN 'acknowledged' ELSE 'returned' END AS status FROM ranked WHERE place <= 60
  UNION ALL SELECT 'b', url, place, CASE WHEN m = 0 THEN 'acknowledged' ELSE 'waiting' END FROM ranked WHERE place BETWEEN 61 AND 120),
again AS (
  SELECT 'c' AS run, url, place, 'waiting' AS status FROM ranked
  WHERE place > 120 OR url IN (SELECT url FROM first WHERE status = 'returned') ORDER BY place LIMIT 60)
SELECT run, 'create' AS kind, url, status FROM (SELECT * FROM first UNION ALL SELECT * FROM again)"""

_WINDOWS_SQL = """
WITH e AS (
  SELECT ts AS t0, event_type AS type, ts + to_minutes(CAST(CASE WHEN event_id % 13 = 0 THEN event_id % 700 + 121 ELSE event_id % 90 END AS INTEGER)) AS arrived FROM events),
t AS (SELECT type, arrived > t0 + INTERVAL 2 HOURS AS late, CASE WHEN arrived > t0 + INTERVAL 2 HOURS THEN arrived ELSE t0 END AS time FROM e)
SELECT strftime(date_trunc('day', time), '%Y-%m-%d %H:%M:%S') AS day, type, late, count(*) AS rows FROM t
WHERE date_trunc('day', time) + INTERVAL 1 DAY <= (SELECT max(time) - INTERVAL 2 HOURS FROM t) GROUP BY ALL"""

QUERIES = {
    "saved_pages": (saved_pages, _SAVED_SQL),
    "stream_changes": (stream_changes, _CHANGES_SQL),
    "outbox_retries": (outbox_retries, _RETRIES_SQL),
    "windowed_outcomes": (windowed_outcomes, _WINDOWS_SQL),
}
