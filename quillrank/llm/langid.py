"""Language ID with language-bitmask n-gram filters.

Every slot of a Bloom filter holds a bitmask of languages, so one lookup of an
n-gram (the AND of its slots) returns all languages that contain it. A text's hits
are counted per language, corrected for the filter's false positives, and the
largest count decides.

Defined results: null texts and texts without a letter are ``und`` with score 0; a
text with letters but no known n-gram gets the most frequent language with score 0;
without any labelled text everything is ``und``. Ties go to the language first by
code point. Rows are judged one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillrank.llm.common import materialize

ORDERS = (3, 4)
SLOT_BITS = 20
#: Code points worked on at once.
SLICE = 1 << 18


@dataclass
class LanguageFilters:
    """``slots[w]``: bitmasks of languages 64w to 64w + 63; ``fill``: share of slots set, by language."""

    languages: list[str]
    slots: np.ndarray
    fill: np.ndarray
    common: str


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), dtype=bool, count=1 << 16)


def _codes(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-case code points with 0 for all but letters, and at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    keep = letters[np.minimum(raw, 0xFFFF)]
    for c in np.unique(raw[raw > 0xFFFF]):
        keep[raw == c] = chr(c).isalpha()
    out = np.zeros(len(raw) + 2, dtype=np.uint64)
    out[1:-1] = np.where(keep, raw, 0)
    return out


def _grams(codes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts below ``limit`` and hashes of the n-grams; only their ends may be a word's edge."""
    for n in ORDERS:
        m = min(len(codes) - n + 1, limit)
        if m <= 0:
            continue
        solid = codes[1 : 1 + m] != 0
        for j in range(2, n - 1):
            solid &= codes[j : j + m] != 0
        at = np.flatnonzero(solid)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        yield at, h


def _slices(texts: list, letters: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, int]]:
    """Bounded runs of code points: documents, their starts, codes, and how many starts count."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        codes = _codes(text, letters)
        if len(codes) > SLICE:
            for s in range(0, len(codes), SLICE):
                yield [row], np.zeros(1, dtype=np.int64), codes[s : s + SLICE + max(ORDERS) - 1], SLICE
            continue
        rows.append(row)
        parts.append(codes)
        held += len(codes)
        if held >= SLICE:
            yield rows, np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts), held
            rows, parts, held = [], [], 0
    if rows:
        yield rows, np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts), held


def _slots(h: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(shift)) & low).astype(np.int64) for shift in (0, 22, 44)]


def fit(labelled: DataFrame, texts_per_language: int = 3000, grams_per_language: int = 4000) -> LanguageFilters:
    """Learn filters from ``text, lang`` of ``labelled``.

    Two bounds keep the fit small whatever the corpus: about ``texts_per_language``
    different texts of each language, chosen by a hash of the text and each taken once,
    and the most frequent ``grams_per_language`` n-grams of each order. Counts of texts
    cover all rows.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("lang is not null and text is not null").select("text", "lang")
    hashed = rows.select("text", "lang", F.xxhash64("text").alias("hash"))
    texts = materialize(hashed.groupBy("lang", "hash").agg(F.count("*").alias("n")), "texts")
    counts = texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()
    sizes = {r["lang"]: r["n"] for r in counts}
    languages = sorted(sizes, key=lambda x: x.encode("utf-8", "surrogatepass"))
    words = max(1, -(-len(languages) // 64))
    slots = np.zeros((words, 1 << SLOT_BITS), dtype=np.uint64)
    if not languages:
        return LanguageFilters([], slots, np.zeros(0), "und")
    shares = spark.createDataFrame([(r["lang"], min(1.0, texts_per_language / r["different"])) for r in counts], "lang string, share double")
    draw = F.pmod("hash", F.lit(1_000_003)) / 1_000_003
    chosen = hashed.join(F.broadcast(shares), "lang").filter(draw <= F.col("share"))  # a row per language
    chosen = chosen.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            texts, langs = (batch.column(c).to_pylist() for c in ("text", "lang"))
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for _, _, codes, limit in _slices(own, letters):
                    for n, (_, h) in zip(ORDERS, _grams(codes, limit)):
                        gram, times = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), n, dtype=np.int32)), pa.array(gram.view(np.int64)), pa.array(times)],
                            names=["lang", "n", "gram", "times"],
                        )

    counted = chosen.mapInArrow(count, "lang string, n int, gram long, times long")
    totals = counted.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram"))
    best = totals.withColumn("r", rank).filter(F.col("r") <= grams_per_language).select("lang", "gram").toArrow()
    number = {lang: i for i, lang in enumerate(languages)}
    owner = np.array([number[x] for x in best.column("lang").to_pylist()], dtype=np.int64)
    grams = best.column("gram").to_numpy().view(np.uint64)
    fill = np.zeros(len(languages))
    for i in range(len(languages)):
        word, bit = divmod(i, 64)
        for at in _slots(grams[owner == i]):
            slots[word, at] |= np.uint64(1 << bit)
        fill[i] = ((slots[word] >> np.uint64(bit)) & np.uint64(1)).mean()
    common = min(languages, key=lambda x: (-sizes[x], number[x]))
    return LanguageFilters(languages, slots, fill, common)


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, letters = LanguageFilters(**shared.value), _letters()
        wrong = filters.fill**3
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hits, total = np.zeros((len(texts), len(filters.languages))), np.zeros(len(texts))
            lettered = np.zeros(len(texts), dtype=bool)
            for rows, starts, codes, limit in _slices(texts, letters):
                lettered[rows] |= np.add.reduceat(codes != 0, starts) > 0
                for at, h in _grams(codes, limit):
                    doc = np.searchsorted(starts, at, side="right") - 1
                    total[rows] += np.bincount(doc, minlength=len(rows))
                    slots = _slots(h)
                    for first, word in zip(range(0, 64 * len(filters.slots), 64), filters.slots):
                        mask = word[slots[0]] & word[slots[1]] & word[slots[2]]
                        for i in range(first, min(first + 64, len(filters.languages))):
                            has = (mask >> np.uint64(i - first)) & np.uint64(1)
                            hits[rows, i] += np.bincount(doc[has != 0], minlength=len(rows))
            true = np.maximum(0, hits - total[:, None] * wrong) / (1 - np.minimum(wrong, 0.99))
            names, scores = [], []
            for i in range(len(texts)):
                best = int(true[i].argmax()) if lettered[i] and filters.languages else -1
                sum_ = float(true[i].sum()) if best >= 0 else 0.0
                names.append("und" if best < 0 else filters.languages[best] if sum_ > 0 else filters.common)
                scores.append(float(true[i, best]) / sum_ if sum_ > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(judge, schema)


def held_out(id_hash: Column) -> Column:
    return id_hash % 4 == 2
