"""Helpers shared by the operators: written tables, prefix sums over an order, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrank.session import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back: lineage ends, reruns agree."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """``df`` as a table in buckets of ``key``, and the table's name: joins on ``key`` leave it where it lies."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table), table


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_crc32(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def running(df: DataFrame, order: list[Column], weight: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before each row in ``order``.

    Rows are range-partitioned and written, so that boundaries are drawn once. Only
    one sum per partition is gathered; no task sees more than its own range.
    A last, arbitrary key keeps repeated rows from falling into one range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_weight", weight.cast("long")).withColumn("_row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, *order, F.col("_row")).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sums = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.sum("_weight")).collect())
    total, starts = 0, []
    for part, weight_of_part in sums:
        starts.append((part, total))
        total += weight_of_part
    offsets = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))  # a row per partition
    inside = Window.partitionBy("_range").orderBy(*order, F.col("_row")).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(offsets, "_range").withColumn(
        name, F.col("_start") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    )
    return summed.drop("_weight", "_row", "_range", "_start")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``: root is the smallest node reachable.

    Large-star and small-star steps in turn, each one aggregate and one join; every
    round is written, and rounds end when the edges no longer change.
    """
    def signature(rows: DataFrame):
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    seen = signature(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        small = small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()
        edges = materialize(small, "links")
        now = signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
