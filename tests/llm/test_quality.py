import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillrank.llm import catalog, quality
from quillrank.llm.common import id_crc32

from .common import ODD, SMALL, documents

LABELS = "doc_id long, quality int, toxic int, score double"


def labels(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.1) for r in rows], LABELS)


def made(n=300, seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "house", "river", "walks", "green", "slowly", "people", "under", "stone"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(30, 300))]
        rows.append((i, " ".join(text if i % 3 else [w.upper() + "!!" for w in text]), "en", "a"))
    return rows, [(i, int(bool(i % 3))) for i in range(n)]


def test_scores_of_held_out_documents(spark):
    rows, marks = made()
    docs = documents(spark, rows).select("doc_id", "text", quality.held_out(id_crc32()).alias("held_out"))
    model = quality.fit(docs.filter("not held_out"), labels(spark, marks))
    found = {r["doc_id"]: r for r in quality.score(docs, model).filter("held_out").collect()}
    assert len(found) > 40
    good, bad = ([r["score"] for i, r in found.items() if bool(i % 3) == q] for q in (True, False))
    assert min(good) > 0.7 > 0.3 > max(bad)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in found.values())


def test_scores_are_those_of_the_two_dictionaries(spark):
    """Scores of whole texts, worked out again from the model's dictionaries alone."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    held = quality.held_out(id_crc32())
    model = quality.fit(docs.filter(~held), spark.read.parquet(f"{SMALL}/labels.parquet"))
    kinds = [zstandard.ZstdCompressionDict(d) for d in (model.bad, model.good)]
    for r in quality.score(docs.withColumn("t", F.col("text")), model).collect():
        text = (r["t"] or "").encode()
        if not text:
            assert r["score"] == model.prior
            continue
        sizes = []
        for kind in kinds:
            c = zstandard.ZstdCompressor(level=3, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(text[s : s + 4096])) for s in range(0, len(text), 4096)))
        bad, good = sizes
        a, k = 5 * (bad - good) / (bad + good), min(2, 3 * min(sizes) / len(text) - 1)
        z = float(np.dot(model.weights, [1, a, k, a * a, k * k, a * k]))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_query_learns_from_what_is_not_held_out(spark):
    found = {r["doc_id"]: r for r in catalog.op13_compression_quality(spark, "/root/testdata/sf0.01").collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    tested = [(r["predicted"], marks[i]) for i, r in found.items() if r["held_out"] and i in marks]
    assert len(found) == 1000 and len(tested) > 50
    assert np.mean([p == q for p, q in tested]) >= 0.9
    again = {r["doc_id"]: r for r in catalog.op13_compression_quality(spark, "/root/testdata/sf0.01").collect()}
    assert again == found


def test_odd_labels_and_texts(spark):
    docs = documents(spark, ODD)
    none = quality.fit(docs, labels(spark, []))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.fit(docs, labels(spark, [(5, 1), (6, 1), (None, 0), (7, None), (8, 3)]))
    assert {(r["score"], r["predicted"]) for r in quality.score(docs, one).collect()} == {(1.0, 1)}
    # A document labelled both ways teaches nothing; one class is left without texts.
    both = quality.fit(docs, labels(spark, [(5, 1), (6, 1), (6, 0), (1, 0), (2, 0)]))
    assert not both.usable and both.prior == pytest.approx(1 / 3)
    two = quality.fit(docs, labels(spark, [(5, 1), (6, 0), (7, 0), (8, 1), (404, 1)]))
    scored = quality.score(docs, two)
    assert scored.count() == len(ODD) and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert len({r["score"] for r in scored.filter("doc_id = 5").collect()}) == 1
    assert quality.score(docs.limit(0), two).count() == 0
    assert quality.fit(docs.limit(0), labels(spark, [(5, 1), (6, 0)])).prior == 0.5


def test_bounds_of_the_sample(spark):
    rows, marks = made(200)
    model = quality.fit(documents(spark, rows), labels(spark, marks), texts=5, blocks=4)
    assert 0 < len(model.good) <= 4 * quality.BLOCK and model.usable
    found = quality._sampled(documents(spark, [(i, "copy " * 3000, "en", "a") for i in range(50)]).select(F.lit(1).alias("quality"), "text"), 10)
    assert found[0] == [] and b"".join(found[1]) in (("copy " * 3000).encode(),) or len(set(found[1])) == len(found[1]) <= 10


def test_curve_follows_the_share_of_good(spark):
    apart = np.repeat(np.linspace(-0.3, 0.3, 61), 5)
    kept = np.tile(np.linspace(0.1, 0.6, 5), 61)
    true = 1 / (1 + np.exp(-(1 + 20 * apart)))
    w = quality.fit_curve(apart, kept, 1000 * true, np.full(len(apart), 1000.0))
    assert np.abs(1 / (1 + np.exp(-quality._terms(apart, kept) @ w)) - true).max() < 0.02
    sure = quality.fit_curve(apart, kept, (apart > 0).astype(float), np.ones(len(apart)))  # separable: weights stay finite
    assert np.isfinite(sure).all()
