"""Nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into equal parts by recursive spectral
bisection, so that a vector and its neighbours mostly share a part. A small network
learns to tell the parts of a vector (soft labels: where its neighbours are). Every row
is indexed under its most probable part; a query is sent to several most probable parts
and the rows found there are ranked exactly. How many parts that takes is measured on
the sample: the fewest that reach the recall asked for. The sample is thinner than the
table and its neighbours are farther off, so the measure errs on the safe side.

The sample's size bounds all work on the driver; it holds every index size alike.
Parts of the table are cut into chunks, so no task sees more than one chunk of rows and
one of queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers,
rows without an id, and rows whose length differs from the most common one take no part.
Ties go to the smaller id. An id with several vectors is one query and one candidate,
as near as its nearest two vectors are; a query's own id is none. Queries whose parts
hold too few ids are sent to all parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrank.llm.common import materialize

SAMPLE = 8192
PARTS = 32
#: Sample rows that a part needs at least.
PART_ROWS = 128
NEIGHBOURS = 20
CHUNK = 4096
_SLACK = 1e-9


@dataclass
class Router:
    """Weights of the network, its parts, and how many to probe."""

    layers: list[np.ndarray]
    parts: int
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(_unit(x) @ w1 + b1, 0) @ w2 + b2


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product with each row of ``x``."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), dtype=np.int64)
    for s in range(0, len(x), 1024):
        near = x[s : s + 1024] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -np.inf
        out[s : s + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Parts of equal size (a power of two of them): spectral bisection, cut at the median."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(graph), dtype=np.int64)
    a, b = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    count = 1
    while count < parts:
        inside = part[a] == part[b]
        p, q = a[inside], b[inside]
        degree = np.bincount(p, minlength=len(graph)) + 1.0
        size = np.bincount(part, minlength=count)
        v = rng.standard_normal(len(graph))
        for _ in range(60):  # power iteration of the lazy walk, without its constant part
            v -= (np.bincount(part, v * degree, count) / np.bincount(part, degree, count))[part]
            v = 0.5 * v + 0.5 * (v + np.bincount(p, v[q], len(graph))) / degree
            v /= np.sqrt(np.bincount(part, v * v, count) / size + 1e-300)[part]
        order = np.lexsort((v, part))
        place = np.empty(len(graph), dtype=np.int64)
        starts = np.cumsum(size) - size
        place[order] = np.arange(len(graph)) - starts[part[order]]
        part = 2 * part + (2 * place >= size[part])
        count *= 2
    return part


def train(x: np.ndarray, soft: np.ndarray, hidden: int = 96, epochs: int = 40, seed: int = 0) -> list[np.ndarray]:
    """A network of one hidden layer for the soft labels, by Adam."""
    rng = np.random.default_rng(seed)
    unit = _unit(x)
    layers = [
        rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2.0), np.zeros(hidden),
        rng.standard_normal((hidden, soft.shape[1])) * np.sqrt(1 / hidden), np.zeros(soft.shape[1]),
    ]
    m, v, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(unit))
        for s in range(0, len(order), 256):
            at = order[s : s + 256]
            h = np.maximum(unit[at] @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - soft[at]) / len(at)
            back = (d @ layers[2].T) * (h > 0)
            slopes = [unit[at].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0)]
            t += 1
            for i, g in enumerate(slopes):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                layers[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit(sample: np.ndarray, k: int = 20, recall: float = 0.96) -> Router:
    """Learn parts from ``sample``, half of it: the other half tells how many to probe."""
    parts = 1
    while parts < PARTS and len(sample) >= 2 * PART_ROWS * parts * 2:
        parts *= 2
    own, rest = sample[::2], sample[1::2]
    dim = sample.shape[1] if sample.ndim == 2 else 1
    if parts == 1:
        return Router([np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1)
    graph = neighbour_graph(own, NEIGHBOURS)
    part = balanced_parts(graph, parts)
    soft = np.zeros((len(own), parts))
    np.add.at(soft, (np.repeat(np.arange(len(own)), graph.shape[1]), part[graph].ravel()), 1.0)
    soft[np.arange(len(own)), part] += graph.shape[1] / 4
    soft /= soft.sum(axis=1, keepdims=True)
    router = Router(train(own, soft), parts, parts)
    # Neighbours of held-out vectors among all of the sample, and where the network files them.
    home = router.logits(sample).argmax(axis=1)
    asked = rest[:1024]
    near = asked @ sample.T
    near[np.arange(len(asked)), 2 * np.arange(len(asked)) + 1] = -np.inf
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-router.logits(asked), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    reached = [(np.take_along_axis(place, home[best], axis=1) < n).mean() for n in range(1, parts + 1)]
    router.probes = 1 + next((i for i, r in enumerate(reached) if r >= recall), parts - 1)
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, vec``: usable vectors as doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = value.values
                if key is None or x is None or x.null_count or not len(x):
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    rows.append((key, len(x), x.tobytes()))
            keys, dims, data = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "dim", "vec"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, vec binary")


def _routed(rows: DataFrame, router: Router, probes: int | None) -> DataFrame:
    """Rows under their part, or queries under each of the ``probes`` parts most probable for them."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(router))
    width = probes or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Router(**shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-net.logits(_matrix(batch.column("vec"))), axis=1, kind="stable")[:, :width]
            row = pa.array(np.repeat(np.arange(len(order)), order.shape[1]))
            arrays = [batch.column(c).take(row) for c in ("vec_id", "vec")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(order.ravel().astype(np.int32))], names=["vec_id", "vec", "part"])

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec binary, part int")


def _best(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of a chunk for each query, with scores that do not depend on the chunk."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and rows.num_rows:
        q, x = _matrix(queries.column("vec")), _matrix(rows.column("vec"))
        asked, ids = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        for s in range(0, len(q), 256):
            near = q[s : s + 256] @ x.T
            near[asked[s : s + 256, None] == ids[None, :]] = -np.inf
            once = near if len(first) == len(ids) else np.maximum.reduceat(near, first, axis=1)  # an id counts once
            kth = np.partition(once, max(0, once.shape[1] - k), axis=1)[:, max(0, once.shape[1] - k)]
            # Near ties of the last place stay in until their scores are exact.
            slack = _SLACK * (1 + np.abs(kth))
            i, j = np.nonzero((near >= (kth - slack)[:, None]) & np.isfinite(near))
            for t in range(0, len(i), 1 << 15):
                a, b = i[t : t + (1 << 15)], j[t : t + (1 << 15)]
                out.append((asked[s + a], ids[b], (q[s + a] * x[b]).sum(axis=1)))
    if not out:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    query, vec, score = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    _, best = np.unique(np.stack([query, vec]), axis=1, return_index=True)  # the first is the best
    best.sort()
    query, vec, score = query[best], vec[best], score[best]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return pa.table({"query_id": pa.array(query[keep]), "vec_id": pa.array(vec[keep]), "score": pa.array(score[keep])})


def _nearest(index: DataFrame, asked: DataFrame, router: Router, k: int) -> DataFrame:
    """``query_id, vec_id, score``: for each query of ``asked(vec_id, vec, part)`` its best in the parts it is sent to, each id once."""
    counted = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    chunks = F.element_at(F.array(*[F.lit(max(1, -(-counted.get(p, 0) // CHUNK))) for p in range(router.parts)]), F.col("part") + 1)
    # Queries that share a part are dealt to groups as well; each group meets each chunk.
    many = asked.groupBy("part").agg(F.count("*").alias("n")).collect()
    waves = {r["part"]: max(1, -(-r["n"] // CHUNK)) for r in many}
    wave = F.element_at(F.array(*[F.lit(waves.get(p, 1)) for p in range(router.parts)]), F.col("part") + 1)
    spot = F.xxhash64("vec_id", "vec")
    asked = asked.withColumn("wave", F.pmod(spot, wave).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    held = index.withColumn("chunk", F.pmod(spot, chunks).cast("int")).withColumn("wave", F.explode(F.sequence(F.lit(0), wave - 1)))
    key = ["part", "chunk", "wave"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(
        lambda q, x: _best(q, x, k), "query_id long, vec_id long, score double"
    )
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.96) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every id of which ``is_query`` holds."""
    rows = materialize(usable(vectors).distinct(), "vectors")
    sizes = sorted((-r["n"], r["dim"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect())  # one row a length
    dim, total = (sizes[0][1], -sizes[0][0]) if sizes else (1, 0)
    rows = rows.filter(F.col("dim") == dim)
    draw = F.pmod(F.xxhash64(F.lit(11), "vec_id", "vec"), F.lit(1_000_003)) / 1_000_003
    sample = rows.filter(draw < SAMPLE / max(total, 1)).orderBy("vec_id", "vec").limit(2 * SAMPLE).select("vec").toArrow()
    router = fit(_matrix(sample.column("vec")) if sample.num_rows else np.zeros((0, dim)), k, recall)
    index = materialize(_routed(rows, router, None), "index")
    asked = rows.filter(is_query)
    found = materialize(_nearest(index, materialize(_routed(asked, router, router.probes), "queries"), router, k), "nearest")
    # Where the parts held fewer ids than asked for, all parts are searched.
    ids = rows.select("vec_id").distinct().count()
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, ids - 1)).select(F.col("query_id").alias("vec_id"))
    short = materialize(asked.join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        again = _nearest(index, materialize(_routed(short, router, router.parts), "queries"), router, k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").union(again)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
