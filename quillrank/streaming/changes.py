"""Streams that remember: what is new about an address, which work was answered, counts by event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups of addresses that share a state; fixed for the life of a checkpoint.
GROUPS = 4096


def changed_writes(writes: DataFrame, columns: Sequence[str], keep: timedelta, delay: timedelta) -> DataFrame:
    """The rows of a stream ``url, at, seq, <columns>`` that say something new: ``kind`` is new or changed.

    The state store holds the last write of each address for ``keep`` of event time; an
    address not written for longer is forgotten and new when it comes again. A write that
    is not later than the last one (by ``at``, then ``seq``) is passed over: it was late, or
    came twice. Writes more than ``delay`` behind the stream are not waited for.

    Addresses share ``GROUPS`` states by their hash: a call for each address costs far more than its rows.
    """
    columns = list(columns)
    known = {f.name: f.dataType for f in writes.schema.fields}
    out = T.StructType(
        [T.StructField("url", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("at_us", T.LongType()), T.StructField("seq", T.LongType())]
        + [T.StructField(c, known[c]) for c in columns]
    )
    hold = int(keep / timedelta(milliseconds=1))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {url: last for url, *last in zip(*state.get)} if state.exists else {}
        rows = [] if state.hasTimedOut else [r for frame in frames for r in zip(*(frame[c] for c in ("url", "at_us", "seq", "print", *columns)))]
        said: list[tuple] = []
        for url, at, seq, mark, *values in sorted(rows, key=lambda r: r[:3]):
            last = held.get(url)
            if last and (at, seq) <= tuple(last[:2]):
                continue
            if not last or mark != last[2]:
                said.append((url, "changed" if last else "new", at, seq, *values))
            held[url] = (int(at), int(seq), mark)
        # An address written in this batch is still known, whatever its time.
        now, written = state.getCurrentWatermarkMs(), {r[0] for r in rows}
        held = {url: last for url, last in held.items() if url in written or last[0] // 1000 + hold >= now}
        if held:
            state.update(([*held], *map(list, zip(*held.values()))))
            state.setTimeoutTimestamp(max(min(last[0] for last in held.values()) // 1000 + hold, now + 1))
        elif state.exists:
            state.remove()
        if said:
            yield pd.DataFrame(said, columns=out.names)

    marked = writes.filter("url is not null and at is not null").select(
        "url", "at", F.unix_micros("at").alias("at_us"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"),
        F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("print"), *columns,
        F.pmod(F.xxhash64("url"), F.lit(GROUPS)).alias("_group"),
    )
    found = marked.withWatermark("at", f"{int(delay.total_seconds())} seconds").groupBy("_group").applyInPandasWithState(
        step, out, "url array<string>, at_us array<long>, seq array<long>, print array<string>", "update", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("url", "kind", F.timestamp_micros("at_us").alias("at"), "seq", *columns)


def answered(asked: DataFrame, answers: DataFrame, wait: timedelta, delay: timedelta) -> DataFrame:
    """What became of each item of the stream ``asked(kind, _key, url, run, queued_at)``.

    ``answers(kind, _key, run, ok, answered_at)`` within ``wait`` settle an item as done or
    failed; once both streams are past that time, an item without any is unanswered.
    """
    seconds = [int(t.total_seconds()) for t in (wait, delay)]
    left = asked.select("kind", "_key", "url", "run", "queued_at").withWatermark("queued_at", f"{seconds[1]} seconds")
    names = {"kind": "_kind", "_key": "_of", "run": "_run"}
    right = answers.select(*[F.col(a).alias(b) for a, b in names.items()], "ok", "answered_at").withWatermark("answered_at", f"{seconds[1]} seconds")
    same = [F.col(a) == F.col(b) for a, b in names.items()]
    in_time = F.expr(f"answered_at >= queued_at AND answered_at <= queued_at + INTERVAL {seconds[0]} SECONDS")
    joined = left.join(right, same[0] & same[1] & same[2] & in_time, "left_outer")
    status = F.when(F.col("ok"), "done").when(F.col("answered_at").isNotNull(), "failed").otherwise("unanswered")
    return joined.select("kind", "_key", "url", "run", "queued_at", status.alias("status"), "answered_at")


def windowed_counts(events: DataFrame, kind: str, width: timedelta, delay: timedelta) -> DataFrame:
    """``from, kind, late, rows`` of a stream ``at, arrived, <kind>``, window by window as each is complete.

    Rows that arrive more than ``delay`` after they happened are counted apart (``late``), in the
    window of their arrival: their own may be closed.
    """
    late = F.col("arrived") > F.col("at") + F.expr(f"INTERVAL {int(delay.total_seconds())} SECONDS")
    timed = events.filter("at is not null and arrived is not null").select(
        F.when(late, F.col("arrived")).otherwise(F.col("at")).alias("time"), F.col(kind).alias("kind"), late.alias("late")
    )
    counted = timed.withWatermark("time", f"{int(delay.total_seconds())} seconds").groupBy(
        F.window("time", f"{int(width.total_seconds())} seconds").alias("w"), "kind", "late"
    )
    return counted.agg(F.count("*").alias("rows")).select(F.col("w.start").alias("from"), "kind", "late", "rows")


def work_off(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append what a stream gives of all that has arrived under ``path``; a batch that is replayed replaces its own folder."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def worked_off(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """What ``work_off`` has written, nothing before the first time."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
