"""The same crawl, page by page as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.config import Settings
from quillrank.operators.merge import last_writes, upsert
from quillrank.operators.selection import backfill_batch
from quillrank.plans.crawl import crawl_items
from quillrank.schema import ITEM, conform
from quillrank.sources.pages import PAGES
from quillrank.sources.sinks import queued, write_outbox
from quillrank.sources.state import SnapshotStore

_PENDING = T.StructType([*ITEM.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])


def page_stream(spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity a checkpoint was given when it was made; it survives restarts."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def merge_pending(store: SnapshotStore, settings: Settings, stream: str, name: str = "ingest") -> int:
    """Merge what ``stream`` appended since its last merge, as one new version.

    The merge's run id names the stream and its last batch, so a replay changes
    nothing and another stream, or a new checkpoint, is never taken for this one.
    """
    prefix = f"{name}:{stream}:"
    number = F.substring_index("run_id", ":", -1).cast("long")
    done = store.versions().filter(F.col("run_id").startswith(prefix)).agg(F.max(number)).first()[0]
    try:
        rows = store.spark.read.schema(_PENDING).parquet(f"{store.path}/pending")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return store.version()
    rows = rows.filter((F.col("stream") == stream) & (F.col("batch") > (-1 if done is None else done))).drop("stream")
    last = rows.agg(F.max("batch")).first()[0]
    if last is None:
        return store.version()
    new = last_writes(rows, ["batch"])
    version = store.update(lambda state: upsert(state, new, settings.site, (), collapsed=True), f"{prefix}{last}")
    _drop_pending(store, stream, last)
    return version


def _drop_pending(store: SnapshotStore, stream: str, last: int) -> None:
    """Delete the batches of ``stream`` that a committed merge has taken up."""
    spark = store.spark
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store.path}/pending/stream={stream}")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in system.listStatus(folder):
        number = entry.getPath().getName().removeprefix("batch=")
        if number.isdigit() and int(number) <= last:
            system.delete(entry.getPath(), True)


def run_into_store(
    stream: DataFrame,
    store: SnapshotStore,
    checkpoint: str,
    to_items: Callable[[DataFrame], DataFrame],
    settings: Settings,
    name: str = "ingest",
) -> int:
    """Work off all that has arrived and merge it; the store's version after it.

    A micro-batch only appends its own writes, one row per address. The state is
    read and written once, when the trigger's data is worked off. A batch that is
    replayed replaces its own folder.
    """
    spark = store.spark

    def keep(batch: DataFrame, batch_id: int) -> None:
        folder = f"{store.path}/pending/stream={_stream_id(spark, checkpoint)}/batch={batch_id}"
        conform(to_items(batch), ITEM).write.mode("overwrite").parquet(folder)

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return merge_pending(store, settings, _stream_id(spark, checkpoint), name)


def queue_work(
    store: SnapshotStore,
    settings: Settings,
    outbox: str,
    run_id: str,
    with_project: bool = False,
    at: datetime | None = None,
    settled: DataFrame | None = None,
) -> None:
    """Queue a bounded batch of work on the stored items, nothing that waits already; what ``settled`` returned may be taken again."""
    waiting = queued(store.spark, outbox, run_id, settled)
    batch = backfill_batch(
        store.read(), settings.batch_limit, settings.eligible, settings.start_year, settings.end_year, with_project, waiting
    )
    write_outbox(batch, settings.site, outbox, run_id, at)


def ingest_pages(
    stream: DataFrame,
    store: SnapshotStore,
    checkpoint: str,
    settings: Settings,
    run_ts: datetime,
    outbox: str | None = None,
    name: str = "ingest",
) -> int:
    """Crawl arriving pages; with ``outbox`` also queue a bounded batch once they are merged."""
    version = run_into_store(stream, store, checkpoint, lambda batch: crawl_items(batch, settings, run_ts), settings, name)
    if outbox and version:
        queue_work(store, settings, outbox, f"{name}-v{version}", at=run_ts)
    return version
