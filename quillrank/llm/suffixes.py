"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only where a text's own content says so: at minimisers, the least
hash of eight words within every stretch that a passage of the wanted length must hold.
Two copies of a passage keep the same suffixes. Suffixes whose eight words occur in no
other document are dropped; the rest are sorted by their words, and by the words before
them read backwards, and each is compared with its neighbours from other documents in
both orders: the match is extended to the right and to the left, and counts if it
reaches the wanted length. Overlapping matches of a document are joined into one span.

Sorting is by range, with ids as last keys, so suffixes that thousands of documents
share are spread over tasks; ranges are compared in streams, and the few rows at their
borders once more together.

Words are what white space leaves, compared as they are (by their 32-bit hashes, at
least ``length`` in a row). Defined results: null and empty texts and texts shorter than
the length have no spans; rows that repeat id and text are one document; a passage that
repeats only within one document is left alone; a null id is reported as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrank.llm.common import materialize

LENGTH = 50
GRAM = 8


def _words(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))


def _gram_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def minimisers(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the suffixes kept: any ``length`` words hold one at the same place."""
    if len(words) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = _gram_hashes(words)
    width = length - GRAM + 1
    kept = np.zeros(len(h), dtype=bool)
    for s in range(0, len(h) - width + 1, 1 << 14):
        stretch = h[s : s + (1 << 14) + width - 1]
        least = np.lib.stride_tricks.sliding_window_view(stretch, width).argmin(axis=1)
        kept[s + least + np.arange(len(least))] = True
    at = np.flatnonzero(kept)
    return at, h[at]


def _suffixes(docs: DataFrame, length: int) -> DataFrame:
    """``key, row, pos`` of the suffixes kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, positions, keys = [], [], []
            for row, text in zip(batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()):
                at, h = minimisers(_words(text or b""), length)
                rows.append(np.full(len(at), row))
                positions.append(at.astype(np.int32))
                keys.append(h.view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, rows, positions)], names=["key", "row", "pos"])

    return docs.select("row", "text").mapInArrow(run, "key long, row long, pos int")


_CONTEXT = "key long, row long, doc_id long, at array<int>, left binary, n_left int, right binary, n_right int"


def _in_context(docs: DataFrame, length: int) -> DataFrame:
    """The suffixes at ``spots`` of each document, with words to both sides.

    Places of a document with the same words around them share a row: ``at`` has them all.
    """
    before, after = length - GRAM, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc, text, spots in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spots").to_pylist()):
                words = _words(text)
                grams = _gram_hashes(words).view(np.int64)
                padded = np.concatenate([np.zeros(before, np.uint32), words, np.zeros(after, np.uint32)]).astype(">u4")
                places: dict[tuple, list[int]] = {}
                for pos in sorted(spots):
                    left = padded[pos : pos + before][::-1].tobytes()
                    right = padded[pos + before : pos + before + after].tobytes()
                    around = left, min(pos, before), right, min(len(words) - pos, after)
                    places.setdefault((int(grams[pos]), *around), []).append(pos)
                out += [(key, row, doc, at, *around) for (key, *around), at in places.items()]
            for s in range(0, len(out), 4096):
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
                names = ["key", "row", "doc_id", "at", "left", "n_left", "right", "n_right"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[s : s + 4096]), kinds)], names=names)

    return docs.select("row", "doc_id", "text", "spots").mapInArrow(run, _CONTEXT)


def _common(rows: pa.Table, side: str, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    words = np.frombuffer(b"".join(rows.column(side).to_pylist()), dtype=">u4").reshape(-1, width)
    same = words[a] == words[b]
    run = np.where(same.all(axis=1), width, same.argmin(axis=1))
    n = rows.column(f"n_{side}").to_numpy()
    return np.minimum(run, np.minimum(n[a], n[b]))


def _matches(rows: pa.Table, length: int) -> pa.Table:
    """Spans that neighbours of different documents in this order have in common."""
    doc, key = rows.column("row").to_numpy(), rows.column("key").to_numpy()
    n = len(doc)
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if n else np.zeros(0, np.int64)
    run = np.searchsorted(starts, np.arange(n), side="right") - 1
    pairs = []
    for other in (starts[run] - 1, np.append(starts[1:], n)[run] if n else starts):
        a = np.flatnonzero((other >= 0) & (other < n))
        b = other[a]
        ok = (key[a] == key[b]) & (doc[a] != doc[b])
        pairs.append((a[ok], b[ok]))
    a, b = (np.concatenate(c) for c in zip(*pairs))
    right = _common(rows, "right", a, b, length)
    left = _common(rows, "left", a, b, length - GRAM)
    ok = left + right >= length
    a, b, left, right = a[ok], b[ok], left[ok], right[ok]
    places = rows.column("at").combine_chunks()
    sizes = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, begins = places.flatten().to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    left, right = np.tile(left, 2), np.tile(right, 2)
    pair = np.repeat(np.arange(len(own)), sizes[own])
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
    own, other, left, right = own[pair], other[pair], left[pair], right[pair]
    pos = flat[begins[own] + nth]
    ids = rows.column("doc_id")
    return pa.table(
        {
            "row": pa.array(doc[own]),
            "doc_id": ids.take(pa.array(own)).combine_chunks(),
            "start": pa.array(pos - left),
            "end": pa.array(pos + right),
            "partner_id": ids.take(pa.array(other)).combine_chunks(),
        }
    )


_SPANS = "row long, doc_id long, start long, end long, partner_id long"


def _neighbours(suffixes: DataFrame, order: list[str], length: int) -> DataFrame:
    """Spans of neighbours in ``order``."""
    spark = suffixes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spans, and as rows of their own the rows at both borders of the range.
        held: pa.Table | None = None
        first: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if first is None:
                first = _border(rows, 1)
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            yield from _as_output(_matches(rows, length), None)
            held = _border(rows, -1)
        if held is not None:
            yield from _as_output(None, pa.concat_tables([first, held]))

    both = f"{_SPANS}, border struct<{', '.join(c.replace(' ', ': ', 1) for c in _CONTEXT.split(', '))}>"
    found = materialize(ranged.mapInArrow(run, both), "neighbours")
    # A few rows for each range: where one range ends and the next begins.
    borders = found.filter("border is not null").select("border.*").repartition(1).sortWithinPartitions(*order)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from _matches(pa.Table.from_batches(rows), length).to_batches()

    return found.filter("border is null").select(*[c.split()[0] for c in _SPANS.split(", ")]).union(borders.mapInArrow(across, _SPANS))


def _border(rows: pa.Table, side: int) -> pa.Table:
    """The outermost rows up to and with the first one of another document."""
    doc = rows.column("row").to_numpy()
    other = np.flatnonzero(doc != doc[0 if side > 0 else -1])
    if side > 0:
        return rows.slice(0, other[0] + 1 if len(other) else len(doc))
    return rows.slice(other[-1] if len(other) else 0)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _as_output(spans: pa.Table | None, borders: pa.Table | None) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SPANS.split(", ")]
    if spans is not None:
        for batch in spans.to_batches():
            kind = pa.struct([(c.split()[0], _KINDS[c.split()[1]]) for c in _CONTEXT.split(", ")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, kind)], names=[*names, "border"])
    if borders is not None:
        for batch in borders.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(batch.num_rows, pa.int64())] * 5, batch.to_struct_array()], names=[*names, "border"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, partner_id``: spans of words that other documents repeat.

    Positions count words from 0, the end is exclusive; ``partner_id`` is the smallest
    document found beside the span in either order.
    """
    docs = docs.select("doc_id", "text").filter("text is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    kept = materialize(_suffixes(docs, length), "suffixes")
    shared = kept.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a <> b").select("key")
    shared = materialize(shared, "shared")  # so that the join's sides are plain shuffles, which Spark can split
    spots = kept.join(shared, "key", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("spots"))
    # Rows that repeat id and text come once: the same row, the same suffixes.
    found = materialize(_in_context(docs.join(spots, "row"), length), "contexts")
    spans = _neighbours(found, ["key", "right", "left", "doc_id", "row", "n_left"], length).union(
        _neighbours(found, ["key", "left", "right", "doc_id", "row", "n_left"], length)
    )
    spans = spans.groupBy("row", "doc_id", "start", "end").agg(F.min("partner_id").alias("partner_id"))
    earlier = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True))
    so_far = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.withColumn("new", begins.cast("int")).withColumn("island", F.sum("new").over(so_far))
    merged = islands.groupBy("row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("partner_id").alias("partner_id")
    )
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id")
