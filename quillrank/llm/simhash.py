"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at
most two bits, one half differs in at most one bit, so both share that half with one
bit wiped (the wildcard), or share the whole half. Each fingerprint is indexed under
every one-wildcard variant of its halves; an equality join of the variants with the
wiped bit clear against those with it set finds the candidates, which are verified
on all 64 bits. Whole halves are joined for the pairs whose differences lie in the
other half alone. Every link is found, each once.

Defined results: null and empty texts have fingerprint zero and link like any other;
texts of one or two words have one shingle, the whole sequence. A null id takes no
part in choosing the smallest id; a component without any id is null. Repeated rows
are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.common import components, materialize

SEED = 42
SHINGLE = 3
#: Shingles whose bits are unpacked at once.
STEP = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(SHINGLE, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.zeros(len(words), dtype=np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    n = len(words) - width + 1
    ends = (starts + sizes)[width - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, n, STEP):
        spans = zip(starts[s : min(s + STEP, n)].tolist(), ends[s : s + STEP].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``fp``: the fingerprint as a signed 64-bit number."""
    rest = [c for c in docs.columns if c not in ("text", "fp")]
    kept = docs.select(*rest, "text")
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest)).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(fps)], names=[*rest, "fp"])

    return kept.mapInArrow(run, schema)


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """``a, b``: all pairs of the distinct fingerprints in ``fp`` that differ in 1 or 2 bits."""
    at = F.col("at")
    half = F.floor(at / 33).cast("int")
    spot = at % 33  # 32: no wildcard
    value = F.when(half == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    exact = F.col("spot") == 32
    bit = F.when(exact, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, spot)"))
    variants = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("at")).select(
        "fp", half.alias("half"), spot.alias("spot"), value.alias("value")
    )
    variants = variants.select(
        "fp",
        (F.expr("shiftleft(cast(half * 33 + spot as long), 32)") + F.col("value") - F.col("value").bitwiseAND(bit)).alias("key"),
        exact.alias("exact"),
        (F.col("value").bitwiseAND(bit) != 0).alias("set"),
        "half",
    )
    clear = variants.filter("not set").select(F.col("fp").alias("a"), "key", "exact", "half")
    full = variants.filter("set or exact").select(F.col("fp").alias("b"), "key")
    other = F.bit_count(
        F.when(F.col("half") == 0, F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), 32)).otherwise(
            F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(0xFFFFFFFF)
        )
    )
    # One difference in each half shows in both halves and counts in the first.
    found = F.when(F.col("exact"), (F.col("a") < F.col("b")) & (other == 2)).otherwise(
        (other == 0) | ((other == 1) & (F.col("half") == 0))
    )
    # Spark sizes the variants as if they were as many as the fingerprints, and would send all of them through the driver.
    return clear.hint("merge").join(full, "key").filter(found).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``fp``, ``component_id`` (smallest ``doc_id`` reachable)."""
    rows = materialize(fingerprints(docs.drop("component_id")), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(linked_pairs(classes))
    # Roots of linked classes only; every other class is its own component.
    linked = roots.join(classes, roots["node"] == classes["fp"]).select("fp", "root", "first")
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(firsts, "root").select("fp", "component_id")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, "fp")
