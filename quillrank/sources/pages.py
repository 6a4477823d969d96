"""Reading pages: a table of ``page_id, url, html`` or a folder of saved files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def save_pages(pages: DataFrame, folder: str, parts: int = 64) -> None:
    """Save each page of ``pages(page_id, html)`` as a file, with a line break after it; rows of one id are one file.

    In a folder that is mounted, tasks write ``part=N/ID.html`` themselves: Spark's writer makes a
    folder for each page there and starts some eight processes to set its rights. Elsewhere
    Spark writes ``page_id=ID/``.
    """
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = pages.select("page_id", "html").repartition(parts, "page_id")
    if system.getUri().getScheme() != "file":
        # Each task puts its own files in place; one after the other at the end would take the driver longer than all else.
        rows.write.partitionBy("page_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
        return
    system.mkdirs(path)
    root = system.makeQualified(path).toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own, begun = f"{root}/part={task.partitionId():03d}", f".{task.taskAttemptId()}"
        last, file = None, None
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if file is None or page != last:
                    if file is None:
                        os.makedirs(own, exist_ok=True)
                    else:
                        file.close()
                        os.replace(f"{own}/{begun}", f"{own}/{last}.html")
                    last, file = page, open(f"{own}/{begun}", "wb")  # hidden until it is whole
                file.write((html or b"") + b"\n")
        if file is not None:
            file.close()
            os.replace(f"{own}/{begun}", f"{own}/{last}.html")
        yield from ()

    rows.sortWithinPartitions("page_id").mapInArrow(run, "none long").write.format("noop").mode("overwrite").save()


def saved_page_id(file: str = "seq") -> Column:
    """The page that a file of ``save_pages`` holds."""
    found = F.regexp_extract(file, r"/(?:page_id=)?(-?[0-9]+)(?:\.html|/[^/]*)$", 1)
    return F.nullif(found, F.lit("")).cast("long")


#: Small files are read as bytes: Spark's text reader sets up a Hadoop job for every file.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def _one_each(files: DataFrame, base_url: str) -> DataFrame:
    named = files.select(F.col("_metadata.file_path").alias("file"), F.col("content").cast("string").alias("html"))
    return named.select(F.xxhash64("file").alias("page_id"), F.lit(base_url).alias("url"), "html", F.col("file").alias("seq"))


def read_saved_pages(spark: SparkSession, folder: str, base_url: str) -> DataFrame:
    """One page per file. Saved files all resolve their links against ``base_url``.

    ``seq`` orders them by their path: of two files with the same item the later counts.
    """
    return _one_each(spark.read.schema(_FILES).format("binaryFile").load(folder), base_url)


def saved_page_stream(spark: SparkSession, folder: str, base_url: str, files_per_batch: int | None = None) -> DataFrame:
    """``read_saved_pages`` as a stream: each file once, as it is saved."""
    reader = spark.readStream.schema(_FILES).format("binaryFile")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _one_each(reader.load(folder), base_url)


def read_cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Saved pages named by the hash of their address: ``cache_key, html``."""
    files = spark.read.text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.html$", 1)
    return files.select(name.alias("cache_key"), F.col("value").alias("html"))
