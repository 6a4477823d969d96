"""Where results go: CSV, JSON preview, Markdown, and the outbox of work items."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import urls
from quillrank.operators.payloads import payloads
from quillrank.operators.selection import list_order
from quillrank.schema import ITEM


def export_rows(items: DataFrame) -> DataFrame:
    """The 25 record fields with lists as JSON text."""
    lists = {f.name for f in ITEM.fields if f.dataType.typeName() == "array"}
    return items.select(*[F.to_json(c).alias(c) if c in lists else F.col(c) for c in ITEM.names])


def export_csv(items: DataFrame, path: str) -> None:
    """All items in list order; without items only the header ``url,title``."""
    if items.isEmpty():
        items.select("url", "title").coalesce(1).write.mode("overwrite").csv(path, header=True)
        return
    export_rows(items.orderBy(*list_order())).write.mode("overwrite").csv(path, header=True)


def preview_rows(items: DataFrame, site) -> DataFrame:
    """One JSON document per payload."""
    return payloads(items, site).select("url", F.to_json(F.struct("url", "title", "body", "labels")).alias("document"))


def write_preview(rows: DataFrame, path: str, mode: str = "dry-run") -> None:
    """Payload documents under ``items`` and a one-row summary under ``summary``."""
    rows.write.mode("overwrite").json(f"{path}/items")
    summary = rows.agg(F.count("*").alias("count")).select(F.lit(mode).alias("mode"), "count")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_report(lines: DataFrame, path: str) -> None:
    """A bounded report as one Markdown file in line order."""
    one = lines.repartition(1).sortWithinPartitions("part")
    one.select("line").write.mode("overwrite").text(path)


def write_long_report(lines: DataFrame, order, path: str) -> None:
    """A report of any length: part files follow each other in line order."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def backfill_documents(batch: DataFrame, site) -> DataFrame:
    """``kind, url, document`` of a batch: what a repair says, and the payloads of new items."""
    said = outbox_rows(batch, site)
    repair = F.to_json(F.struct("url", "title", "issue_number", "issue_url"))
    create = F.to_json(F.struct("url", "title", "body", "labels"))
    return said.select("kind", "url", F.when(F.col("kind") == "repair", repair).otherwise(create).alias("document"))


def source_documents(sources: DataFrame) -> DataFrame:
    """One JSON document per source, or per result of a run, with all its known fields."""
    return sources.select("source_url", F.to_json(F.struct(*sources.columns)).alias("document"))


def write_backfill_preview(batch: DataFrame, site, path: str, start_year: int | None, end_year: int | None, mode: str = "dry-run") -> None:
    """Documents under ``repairs`` and ``issues``; window and count under ``summary``."""
    rows = backfill_documents(batch, site)
    for kind, folder in (("repair", "repairs"), ("create", "issues")):
        rows.filter(F.col("kind") == kind).select("document").write.mode("overwrite").text(f"{path}/{folder}")
    summary = rows.agg(F.count("*").alias("count")).select(
        F.lit(mode).alias("mode"), F.lit(start_year).cast("int").alias("start_year"), F.lit(end_year).cast("int").alias("end_year"), "count"
    )
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_source_preview(sources: DataFrame, path: str, mode: str = "dry-run") -> None:
    """Documents under ``sources`` (or ``results`` after a run), their number under ``summary``."""
    rows = source_documents(sources)
    folder = "sources" if mode == "dry-run" else "results"
    rows.select("document").write.mode("overwrite").text(f"{path}/{folder}")
    summary = rows.agg(F.count("*").alias("count")).select(F.lit(mode).alias("mode"), "count")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


_OUTBOX = (
    "kind string, _key string, url string, title string, body string, labels array<string>, "
    "issue_number bigint, issue_url string, node_id string, queued_at timestamp"
)
#: What ``streaming.changes.answered`` says of queued items.
SETTLED = "kind string, _key string, url string, run string, queued_at timestamp, status string, answered_at timestamp"


def outbox_rows(batch: DataFrame, site) -> DataFrame:
    """What to do about each item of ``batch``: create its issue, or put the known one on the board."""
    if "kind" not in batch.columns:
        batch = batch.withColumn("kind", F.lit("create"))
    keyed = batch.withColumn("_key", urls.item_key(F.col("presentation_url"), F.col("url")))
    said = payloads(keyed, site, "kind", "_key", F.col("title").alias("_title"), "github_issue_number", "github_issue_url", "github_issue_node_id")
    repair = F.col("kind") == "repair"
    return said.select(
        "kind", "_key", "url",
        F.when(repair, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(~repair, F.col("body")).alias("body"),
        F.when(~repair, F.col("labels")).alias("labels"),
        F.when(repair, F.col("github_issue_number")).alias("issue_number"),
        F.when(repair, F.col("github_issue_url")).alias("issue_url"),
        F.when(repair, F.col("github_issue_node_id")).alias("node_id"),
    )


def write_outbox(batch: DataFrame, site, path: str, run_id: str, at: datetime | None = None) -> None:
    """Work items to be done, one folder per run; writing a run again replaces it."""
    rows = outbox_rows(batch, site).withColumn("queued_at", F.lit(at).cast("timestamp"))
    rows.write.mode("overwrite").parquet(f"{path}/run={run_id}")


def _outbox(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(f"{_OUTBOX}, run string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_OUTBOX}, run string")


def outbox_status(spark: SparkSession, path: str, settled: DataFrame | None = None) -> DataFrame:
    """``run, kind, _key, url, status`` of all work items: waiting, acknowledged, or returned.

    ``settled`` (``SETTLED``) tells what became of them. An item is returned when its
    creation failed or nobody answered; any success among its answers counts.
    """
    rows = _outbox(spark, path).select("run", "kind", "_key", "url")
    if settled is None:
        return rows.withColumn("status", F.lit("waiting"))
    item = ["run", "kind", "_key", "url"]
    known = settled.groupBy(*item).agg(F.bool_or(F.col("status") == "done").alias("done"))
    status = F.when(F.col("done"), "acknowledged").when(~F.col("done"), "returned").otherwise("waiting")
    return rows.join(known, item, "left").select(*item, status.alias("status"))


def queued(spark: SparkSession, path: str, run_id: str, settled: DataFrame | None = None) -> DataFrame:
    """``kind, _key, url`` of the work items that runs other than ``run_id`` put into the outbox and that did not come back."""
    rows = outbox_status(spark, path, settled).filter((F.col("run") != run_id) & (F.col("status") != "returned"))
    return rows.select("kind", "_key", "url")


def prune_outbox(spark: SparkSession, path: str, settled: DataFrame) -> list[str]:
    """Delete the folders of runs in which nothing waits, and name them.

    To be called once the state has the issues of what was acknowledged.
    """
    open_ = outbox_status(spark, path, settled).groupBy("run").agg(F.bool_or(F.col("status") == "waiting").alias("waits"))
    done = sorted(r["run"] for r in open_.filter("not waits").collect())  # one name a run
    for run in done:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return done
