"""Mixing sources to target sizes by pivotal dependent rounding.

Each source has a target size; every document of it should appear ``target / size of
the source`` times. The whole part is taken, the fraction is settled by pivotal
rounding: two documents with fractional copies exchange mass at random until one of
them has a whole number, in such a way that expectations hold and the words of the
two together do not change. What a bucket leaves open, at most one document of each
source, goes up a reduction tree; the last one of a source is rounded to the nearer
whole number. A source therefore misses its target by half a document at most, and
expectations hold for all but that one document.

Defined results: null texts have size 0; documents of size 0 take nothing; a null
source is a source of its own, ranked last; in an empty table nothing is taken.
Repeated rows are separate documents, told apart by a number, so that they spread over
the buckets. All chance comes from hashes of ids, so reruns agree however rows are spread.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import WORD, materialize, running

#: Documents of a first-level bucket, and buckets that meet in one node of the tree.
BUCKET_ROWS = 4096
FAN = 8
_TINY = 1e-9
_SCHEMA = (
    "row long, doc_id long, source string, size long, source_size long, target double, copies long, "
    "open double, spin long, bucket long"
)


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``: the number of words of its text."""
    return docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` of ``sizes(source, size)``.

    Sources in order of their code points get ``weights`` in turn and share the sum
    of all sizes; a target stops at ``most`` times its source's size and the excess
    is shared among the others by weight until none is above.
    """
    sources = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running(sources, [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight.cast("double")), "weights")
    cap = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit = 0.0
    while True:  # each pass stops further sources at their cap; most corpora need two or three
        free = cap >= F.col("weight") * unit
        row = ranked.agg(
            F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.when(~free, cap)).alias("capped")
        ).first()
        now = (total - (row["capped"] or 0.0)) / row["weight"] if row["weight"] else unit
        if now <= unit * (1 + 1e-12):
            break
        unit = now
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * unit).alias("target"))


def _chance(*values) -> float:
    digest = hashlib.blake2b(repr(values).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") / 2.0**64


def _pivot(table: pa.Table) -> pa.Table:
    """Settle the open documents of a table, but for one of each source."""
    rows = table.to_pylist()
    rows.sort(key=lambda r: (r["spin"], r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["source"] or ""))
    waiting: dict = {}
    for row in rows:
        if row["open"] is None:
            continue
        held = waiting.get(row["source"])
        if held is None:
            waiting[row["source"]] = row
            continue
        p, q, w, v = held["open"], row["open"], held["size"], row["size"]
        up, down = min((1 - p) * w, q * v), min(p * w, (1 - q) * v)  # words that may pass to and from the held one
        moved = up if _chance(held["spin"], row["spin"]) * (up + down) < down else -down
        for doc, share in ((held, p + moved / w), (row, q - moved / v)):
            doc["open"] = share
            if share < _TINY or share > 1 - _TINY:
                doc["copies"] += share > 0.5
                doc["open"] = None
        waiting[row["source"]] = next((d for d in (held, row) if d["open"] is not None), None)
    return pa.Table.from_pylist(rows, schema=table.schema)


def mix(sizes: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """``row, doc_id, source, size, source_size, target, copies`` of ``sizes(doc_id, source, size)``.

    ``wanted`` is a table as ``targets`` makes it. ``row`` is handed on where there is one.
    """
    handed = "row" in sizes.columns
    total = sizes.count()
    if handed:
        sizes = sizes.select("row", "doc_id", "source", "size", F.col("row").alias("nth"))
    else:
        # Equal rows are counted and told apart by a number, so that they need not share a bucket.
        alike = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
        first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BUCKET_ROWS))).alias("some")
        blocks = alike.select("doc_id", "source", "size", "n", first)
        here = F.least(F.lit(BUCKET_ROWS).cast("long"), F.col("n") - F.col("some") * BUCKET_ROWS)
        numbered = blocks.select("doc_id", "source", "size", "some", F.explode(F.sequence(F.lit(0).cast("long"), here - 1)).alias("nth"))
        sizes = numbered.select(F.lit(None).cast("long").alias("row"), "doc_id", "source", "size", (F.col("some") * BUCKET_ROWS + F.col("nth")).alias("nth"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = share - F.floor(share)
    even = (part < _TINY) | (part > 1 - _TINY) | (F.col("size") == 0)
    buckets = -(-max(total, 1) // BUCKET_ROWS)
    spin = F.xxhash64(F.lit(seed), "doc_id", "source", "size", "nth")
    w = wanted.withColumnRenamed("source", "_source")
    rows = sizes.join(w, sizes["source"].eqNullSafe(w["_source"])).select(
        "row", "doc_id", "source", "size", "source_size", "target",
        F.when(part > 1 - _TINY, F.round(share)).otherwise(F.floor(share)).cast("long").alias("copies"),
        F.when(~even, part).alias("open"),
        spin.alias("spin"),
        F.pmod(spin, F.lit(buckets)).alias("bucket"),
    )
    rows = materialize(rows, "shares")
    # Rows whose copies are whole from the start take no part.
    level = materialize(rows.filter("open is not null").groupBy("bucket").applyInArrow(_pivot, _SCHEMA), "rounding")
    settled = rows.filter("open is null").select(*level.columns).union(level.filter("open is null"))
    level = level.filter("open is not null")
    while buckets > 1:
        buckets = -(-buckets // FAN)
        level = level.withColumn("bucket", F.floor(F.col("bucket") / FAN))
        level = materialize(level.groupBy("bucket", "source").applyInArrow(_pivot, _SCHEMA), "rounding")
        settled = settled.union(level.filter("open is null"))
        level = level.filter("open is not null")
    last = level.withColumn("copies", F.col("copies") + (F.col("open") >= 0.5).cast("long"))  # one of each source
    return settled.union(last).select("row", "doc_id", "source", "size", "source_size", "target", "copies")
