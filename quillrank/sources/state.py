"""Item state as versioned Parquet snapshots, and import of older text-typed rows.

A run reads version N, writes N+1 next to it in a folder of its own and then claims
the number: it creates the file ``versions/N.json``, which fails if there is one.
Readers follow these files, so a lost job leaves the last good version in place, and
of two runs that make the same version the second fails and leaves nothing behind.
Snapshots are bucketed by key: a merge shuffles the batch of writes to the snapshot's
buckets, never the snapshot itself; two versions are compared without any shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.operators.merge import differences
from quillrank.schema import STATE, conform, upgrade_state

_VERSIONS = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("buckets", T.IntegerType()),
    ]
)


class SnapshotStore:
    """Snapshots of one keyed table under ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType = STATE,
        key: str = "url",
        buckets: int | None = None,
        keep: int | None = None,
    ):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        # For new versions; fewer buckets than shuffle partitions would make Spark
        # shuffle the snapshot again. Every version remembers its own number.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # How many versions stay; None keeps all.
        self.keep = keep
        self._name = "snapshot_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(_VERSIONS).json(f"{self.path}/versions").filter("version is not null")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _VERSIONS)

    def _progress(self, run_id: str) -> tuple[int, bool]:
        """Newest complete version, and whether ``run_id`` is among the committed runs."""
        row = self.versions().agg(
            F.max("version").alias("version"), F.bool_or(F.col("run_id") == run_id).alias("seen")
        ).first()
        return row["version"] or 0, bool(row["seen"])

    def version(self) -> int:
        """Newest complete version, 0 before the first."""
        return self._progress("")[0]

    def _mark(self, version: int, run_id: str) -> str:
        return f"{version}-{hashlib.sha256(run_id.encode()).hexdigest()[:12]}"

    def _location(self, version: int, run_id: str) -> str:
        return f"{self.path}/v={self._mark(version, run_id)}"

    def _table(self, version: int, run_id: str) -> str:
        return f"{self._name}_{self._mark(version, run_id).replace('-', '_')}"

    def _line(self, version: int) -> Row:
        """What is known of ``version``."""
        line = self.versions().filter(F.col("version") == version).first()
        if line is None:
            raise ValueError(f"{self.path}: no version {version}")
        return line

    def _on_files(self, path: str):
        """The file system and the path in it."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _claim(self, version: int, run_id: str) -> bool:
        """Make ``version`` this run's, unless another run has it."""
        files, place = self._on_files(f"{self.path}/versions/{version}.json")
        said = json.dumps({"version": version, "run_id": run_id, "buckets": self.buckets}) + "\n"
        try:
            out = files.create(place, False)  # never overwrites
        except Py4JJavaError as error:
            if not files.exists(place):
                raise
            if "Exists" not in str(error.java_exception) and "exists" not in str(error.java_exception):
                raise
            return False
        out.write(bytearray(said.encode()))
        out.close()
        return self._line(version)["run_id"] == run_id

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        line = self._line(version)
        buckets, location = line["buckets"], self._location(version, line["run_id"])
        table = self._table(version, line["run_id"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"OPTIONS (path '{location}') "
            f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {buckets} BUCKETS"
        )
        return self.spark.table(table)

    def commit(self, df: DataFrame, run_id: str) -> int:
        """Write ``df`` as the next version. A run id commits once."""
        version, seen = self._progress(run_id)
        if seen:
            return version
        return self._write(conform(df, self.schema).repartition(self.buckets, self.key), version + 1, run_id)

    def _write(self, df: DataFrame, version: int, run_id: str) -> int:
        table, location = self._table(version, run_id), self._location(version, run_id)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        (
            df.write.bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .format("parquet")
            .option("path", location)
            .mode("overwrite")
            .saveAsTable(table)
        )
        if not self._claim(version, run_id):
            self._forget(version, run_id)
            raise RuntimeError(f"{self.path}: another run made version {version}")
        if self.keep is not None:
            for line in self.versions().filter(F.col("version") <= version - self.keep).collect():
                self._forget(line["version"], line["run_id"])
        return version

    def _forget(self, version: int, run_id: str) -> None:
        """Delete a version's files and table; what says that it was there stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(version, run_id)}")
        files, place = self._on_files(self._location(version, run_id))
        if files.exists(place):
            files.delete(place, True)

    def changes(self, since: int, until: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """What happened to each row between two versions, see ``operators.merge.differences``.

        Versions of the same buckets are compared bucket by bucket, without a shuffle.
        """
        return differences(self.read(since), self.read(until), self.key, columns)

    def update(self, change: Callable[[DataFrame], DataFrame], run_id: str) -> int:
        """Commit ``change(current state)`` unless this run already did.

        A change joins the bucketed state by its key or leaves rows in place, so
        its tasks already hold whole buckets and nothing is shuffled for the write.
        Only where there is no state in these buckets yet are rows dealt to them.
        """
        version, seen = self._progress(run_id)
        if seen:
            return version
        new = conform(change(self.read(version)), self.schema)
        if not version or self._line(version)["buckets"] != self.buckets:
            new = new.repartition(self.buckets, self.key)
        return self._write(new, version + 1, run_id)


def typed_rows(rows: DataFrame) -> DataFrame:
    """Items from text-typed rows: JSON lists, 0/1 flags, ISO dates and times."""
    kinds = {f.name: f.dataType for f in STATE.fields if f.name in rows.columns}

    def column(name: str):
        value, kind = F.col(name), kinds[name]
        if isinstance(kind, T.ArrayType):
            return F.from_json(F.coalesce(F.nullif(value, F.lit("")), F.lit("[]")), "array<string>")
        if isinstance(kind, T.BooleanType):
            return F.coalesce(value.cast("int"), F.lit(0)) != 0
        if isinstance(kind, T.DateType):
            return F.try_to_date(F.nullif(value.cast("string"), F.lit("")), "yyyy-MM-dd")
        if isinstance(kind, T.TimestampType):
            return F.try_to_timestamp(F.nullif(value.cast("string"), F.lit("")))
        return value.cast(kind)

    typed = rows.select(*[column(name).alias(name) for name in kinds])
    if "presentation_url" in kinds:
        typed = typed.withColumn("presentation_url", F.nullif(F.col("presentation_url"), F.lit("")))
    return upgrade_state(typed)


def text_rows(items: DataFrame) -> DataFrame:
    """The reverse of ``typed_rows``, for exchange with text-typed stores."""
    def column(field: T.StructField):
        value = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.to_json(value)
        if isinstance(field.dataType, T.BooleanType):
            return value.cast("int")
        if isinstance(field.dataType, T.DateType):
            return F.date_format(value, "yyyy-MM-dd")
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
        return value

    return items.select(*[column(f).alias(f.name) for f in items.schema.fields])
