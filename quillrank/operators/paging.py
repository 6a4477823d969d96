"""Pages of a listing of any length: numbers over the whole order, and pages by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.session import shared_folder


def numbered(items: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """``items`` numbered from 1 in ``order``, without bringing them together.

    Rows are sorted into ranges, which are written so that their borders are drawn once;
    each range counts on from the sizes of the earlier ones. ``order`` should tell all
    rows apart: equal ones are numbered in no certain order.
    """
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "ranges")
    items.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n")).collect()  # one row a range
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        starts.append((r["_range"], total))
        total += r["_n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rows = ranges.withColumn("_place", place).join(offsets, "_range")
    return rows.withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def page(numbered_items: DataFrame, after: int, size: int, name: str = "number") -> DataFrame:
    """The ``size`` rows that follow number ``after``; a filter on the number, so that files beyond it are skipped."""
    return numbered_items.filter((F.col(name) > after) & (F.col(name) <= after + size)).orderBy(name)
