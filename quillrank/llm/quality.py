"""Quality of texts by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from texts labelled good, one from texts labelled bad. Every
text is compressed whole with both, in blocks so that the dictionary, not the text's
own past, is what helps. The difference of the two sizes over their sum says which
text it resembles, the smaller size over the length how much it repeats itself; a
logistic curve over both, fitted to labelled texts that built no dictionary, makes a
probability of that.

Bounds: dictionaries come from at most ``TEXTS`` labelled documents of a class and
``BLOCKS`` of their different blocks, both drawn by hash. The curve is fitted to all
other labelled documents, counted in cells of the two measures (``CELLS`` a side).

Defined results: null and empty texts, and all texts where labels of one class are
missing, get the share of good documents among the labelled ones (0.5 without labels).
Documents labelled both good and bad teach nothing; labels without an id or value are
left out. Rows are scored one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillrank.llm.common import materialize

TEXTS = 6000
BLOCKS = 3000
#: Bytes of a block, and of a dictionary.
BLOCK = 4096
DICTIONARY = 256 << 10
LEVEL = 3
CELLS = 400
#: Fewer blocks or bytes than these can't be trained on; they are the dictionary as they are.
FEWEST_BLOCKS = 64
#: A score from which a document counts as good.
GOOD = 0.7


@dataclass
class Model:
    """Dictionaries of the classes, the curve's weights, and the share of good documents."""

    bad: bytes = b""
    good: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    prior: float = 0.5

    @property
    def usable(self) -> bool:
        return bool(self.bad and self.good)


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(blocks: list[bytes]) -> bytes:
    """A dictionary of what ``blocks`` share."""
    whole = b"".join(blocks)
    if len(blocks) >= FEWEST_BLOCKS and len(whole) >= 2 * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, blocks, k=500, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too much alike for a training
            pass
    return whole[:DICTIONARY]


class _Sizes:
    """Compressed sizes of texts by both dictionaries."""

    def __init__(self, model: Model):
        self.compressors = []
        for content in (model.bad, model.good):
            kind = zstandard.ZstdCompressionDict(content)
            kind.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def measures(self, text: bytes) -> tuple[float, float]:
        """Difference of the sizes by their sum, and the smaller size by the length."""
        blocks = blocks_of(text)
        bad, good = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        return (bad - good) / (bad + good), min(bad, good) / len(text)


def _terms(apart: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """What the curve weighs; both measures brought to about -1 to 1."""
    a, k = 5 * apart, np.minimum(3 * kept - 1, 2)
    return np.stack([np.ones_like(a), a, k, a * a, k * k, a * k], axis=-1)


def fit_curve(apart: np.ndarray, kept: np.ndarray, good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve for ``good`` of ``all_`` documents in each cell: Newton steps, ridge, no step that loses."""
    x = _terms(apart, kept)
    ridge = np.array([1e-6, *[0.05] * (x.shape[1] - 1)])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((all_ * np.logaddexp(0, z) - good * z).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (good - all_ * p) - ridge * w
        step = np.linalg.solve((x * (all_ * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        now, share = loss(w), 1.0
        while share > 1e-6 and loss(w + share * step) > now:
            share /= 2
        if share <= 1e-6 or np.abs(share * step).max() < 1e-9:
            break
        w = w + share * step
    return w


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without its text, with ``apart`` and ``kept`` (null for empty texts)."""
    rest = [c for c in docs.columns if c not in ("text", "apart", "kept")]
    some = docs.select(*rest, "text")
    schema = T.StructType([*some.schema.fields[:-1], T.StructField("apart", T.DoubleType()), T.StructField("kept", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(Model(**shared.value))
        for batch in batches:
            texts = batch.column(len(rest)).cast(pa.binary())
            found = [sizes.measures(t) if t else (None, None) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))], names=[*rest, "apart", "kept"]
            )

    return some.mapInArrow(run, schema)


def _sampled(texts: DataFrame, most: int) -> dict[int, list[bytes]]:
    """At most ``most`` different blocks of ``texts(quality, text)`` for each class, those of the least hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for quality, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for some in (text[i : i + (BLOCK << 8)] for i in range(0, len(text), BLOCK << 8)):
                    blocks = blocks_of(some)
                    yield pa.RecordBatch.from_arrays([pa.array([quality] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["quality", "block"])

    blocks = texts.select("quality", "text").mapInArrow(run, "quality int, block binary").withColumn("hash", F.xxhash64("block"))
    blocks = materialize(blocks, "blocks")
    place = F.row_number().over(Window.partitionBy("quality").orderBy("hash"))
    different = blocks.select("quality", "hash").distinct().withColumn("place", place).filter(F.col("place") <= most).select("quality", "hash")
    drawn = blocks.join(F.broadcast(different), ["quality", "hash"])  # at most ``most`` for each of two classes
    drawn = drawn.groupBy("quality", "hash").agg(F.first("block").alias("block")).orderBy("quality", "hash").collect()
    return {q: [bytes(r["block"]) for r in drawn if r["quality"] == q] for q in (0, 1)}


def known(labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` of the documents whose labels agree."""
    said = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    return said.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")


def fit(docs: DataFrame, labels: DataFrame, texts: int = TEXTS, blocks: int = BLOCKS) -> Model:
    """Learn from the documents of ``docs(doc_id, text)`` that ``labels(doc_id, quality)`` names."""
    # Ids alone decide what a document is for: half of them build dictionaries, at most ``texts`` of a class.
    known_ = materialize(known(labels).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("hash", F.xxhash64(F.lit(13), "doc_id")), "labels")
    counts = {r["quality"]: r["n"] for r in known_.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(prior=prior)
    # Half of a class at most; the bound of both is said first, so that no task sees more than it of a class.
    bounds = {q: min(texts, -(-counts[q] // 2)) for q in (0, 1)}
    place = F.row_number().over(Window.partitionBy("quality").orderBy("hash", "doc_id"))
    first = known_.withColumn("place", place).filter(F.col("place") <= max(bounds.values()))
    drawn = first.filter(F.col("place") <= F.when(F.col("quality") == 1, bounds[1]).otherwise(bounds[0])).select("doc_id", "quality")
    drawn = materialize(drawn, "drawn")
    found = _sampled(docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(drawn), "doc_id"), blocks)  # at most ``texts`` of two classes
    if not (found[0] and found[1]):
        return Model(prior=prior)
    model = Model(dictionary(found[0]), dictionary(found[1]), prior=prior)
    rest = known_.join(drawn.select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality")
    # Labelled texts are measured where they lie; only ids and measures meet the labels.
    sizes = measured(docs.select("doc_id", "text").filter("doc_id is not null and text <> ''"), model).join(rest, "doc_id")
    cell = [F.round(F.col(c) * CELLS).cast("int").alias(c) for c in ("apart", "kept")]
    cells = sizes.select("quality", *cell).groupBy("apart", "kept").agg(F.sum("quality").alias("good"), F.count("*").alias("n")).collect()
    if not cells:
        return Model(prior=prior)
    rows = np.array(sorted((r["apart"], r["kept"], r["good"], r["n"]) for r in cells), dtype=float)
    model.weights = fit_curve(rows[:, 0] / CELLS, rows[:, 1] / CELLS, rows[:, 2], rows[:, 3])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without its text, with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted", "apart", "kept")
    if not model.usable:
        rows = docs.drop("text").withColumn("score", F.lit(model.prior))
    else:
        a = F.col("apart") * 5
        k = F.least(F.col("kept") * 3 - 1, F.lit(2.0))
        z = sum((F.lit(float(w)) * t for w, t in zip(model.weights[1:], (a, k, a * a, k * k, a * k))), F.lit(float(model.weights[0])))
        rows = measured(docs, model).withColumn("score", F.coalesce(1 / (1 + F.exp(-z)), F.lit(model.prior))).drop("apart", "kept")
    return rows.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def held_out(id_hash: Column) -> Column:
    return id_hash % 4 == 2
