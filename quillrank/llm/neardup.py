"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated (random signs, then a Walsh-Hadamard transform, which is exact
to the bit wherever it is done) and cut into blocks of eight coordinates. A pair with
cosine at least c lies within squared distance 2 - 2c, so in some block its squared
distance is at most the block's share of that. Each block is range-joined on its first
coordinate and then on all eight; the union of candidates is verified on the original
vectors in double precision. A pair that qualifies in several blocks counts in the
first of them alone, so links are counted without listing pairs: tasks return one count
and one link to a representative for each vector.

Crowded ranges are split into tiles that meet pairwise, so that no task holds more than
two tiles of rows however many vectors are alike.

Defined results: vectors without label or id, and vectors that are null, empty, zero or hold
null or non-finite numbers, link with nothing; so do vectors of different lengths. Rows
of one id are one result, linked through all its different vectors: each pair of a vector
of its own and one of another id counts. Rows without an id are returned one by one, with
a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import components, materialize

WIDTH = 8
TILE = 3000
_SLACK = 1e-9
#: Pairs verified at once.
STEP = 1 << 15


def _parts(dim: int, least: float) -> tuple[int, int, float, float]:
    """Padded length, number of blocks, squared budget of a block, and its reach."""
    padded = 1 << max(0, dim - 1).bit_length()
    blocks = max(1, padded // WIDTH)
    budget = (2 - 2 * least) / blocks * (1 + _SLACK) + 1e-12
    return padded, blocks, budget, float(np.sqrt(budget))


def rotate(unit: np.ndarray) -> np.ndarray:
    """Rows of ``unit`` rotated; only sums and differences, so equal rows stay equal anywhere."""
    rows, dim = unit.shape
    padded = 1 << max(0, dim - 1).bit_length()
    signs = np.where(np.random.default_rng(7).random(dim) < 0.5, -1.0, 1.0)
    out = np.zeros((rows, padded))
    out[:, :dim] = unit * signs
    h = 1
    while h < padded:
        x = out.reshape(rows, padded // (2 * h), 2, h)
        out = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, padded)
        h *= 2
    return out / np.sqrt(padded)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """One array for each usable vector, None for the others."""
    found = []
    for value in column:
        x = value.values
        x = None if x is None or x.null_count or not len(x) else x.to_numpy(zero_copy_only=False).astype(np.float64)
        found.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return found


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # so that no square over- or underflows
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / norm, x


def _spread(rows: DataFrame, least: float) -> DataFrame:
    """Every vector once for each block and each range it may meet others in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column(2))
            ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for dim in sorted({len(v) for v in vectors if v is not None}):
                at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
                padded, blocks, _, reach = _parts(dim, least)
                x = np.stack([vectors[i] for i in at])
                y = rotate(_unit(x)[0])
                data = [v.tobytes() for v in x]
                for b in range(blocks):
                    first = y[:, b * (padded // blocks)]
                    cell = np.floor(first / (2 * reach)).astype(np.int64)
                    near = np.flatnonzero(first >= (cell + 1) * 2 * reach - reach * (1 + 1e-6))
                    for guest, some in ((False, range(len(at))), (True, near.tolist())):
                        some = list(some)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([labels[at[i]] for i in some], pa.string()),
                                pa.array([dim] * len(some), pa.int32()),
                                pa.array([b] * len(some), pa.int32()),
                                pa.array(cell[some] + guest, pa.int64()),
                                pa.array([guest] * len(some), pa.bool_()),
                                pa.array(ids[[at[i] for i in some]], pa.int64()),
                                pa.array([data[i] for i in some], pa.binary()),
                            ],
                            names=["label", "dim", "block", "cell", "guest", "vec_id", "vec"],
                        )

    schema = "label string, dim int, block int, cell long, guest boolean, vec_id long, vec binary"
    return rows.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, schema)


def _tile(table: pa.Table, least: float) -> pa.Table:
    """Counts of links, and links to representatives, that a tile finds."""
    dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    ids = table.column("vec_id").to_numpy()
    part, guest = table.column("part").to_numpy(), table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
    x = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=np.float64).reshape(-1, dim)
    padded, blocks, budget, reach = _parts(dim, least)
    unit, scaled = _unit(x)
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    y = rotate(unit)
    width = padded // blocks
    own = y[:, block * width : (block + 1) * width]
    order = np.argsort(own[:, 0], kind="stable")
    left = order[part[order] == lo]
    right = left if lo == hi else order[part[order] == hi]
    keys, square = own[right, 0], (own * own).sum(axis=1)
    counts, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for s in range(0, len(left), 256):
        a = left[s : s + 256]
        from_, to = np.searchsorted(keys, own[a[0], 0] - reach - 1e-9), np.searchsorted(keys, own[a[-1], 0] + reach + 1e-9, side="right")
        b = right[from_:to]
        apart = square[a][:, None] + square[b][None, :] - 2 * own[a] @ own[b].T
        close = (apart <= budget + 1e-9) & ~(guest[a][:, None] & guest[b][None, :]) & (ids[a][:, None] != ids[b][None, :])
        if lo == hi:
            close &= np.arange(s, s + len(a))[:, None] < np.arange(from_, to)[None, :]
        i, j = np.nonzero(close)
        for t in range(0, len(i), STEP):
            p, q = a[i[t : t + STEP]], b[j[t : t + STEP]]
            gaps = ((y[p] - y[q]) ** 2).reshape(len(p), blocks, width).sum(axis=2) <= budget
            fits = gaps[:, block] & ~gaps[:, :block].any(axis=1)
            p, q = p[fits], q[fits]
            cosine = (scaled[p] * scaled[q]).sum(axis=1) / (norm[p] * norm[q])
            p, q = p[cosine >= least], q[cosine >= least]
            counts += np.bincount(p, minlength=len(ids)) + np.bincount(q, minlength=len(ids))
            while (loose := root[p] != root[q]).any():
                ends = root[p[loose]], root[q[loose]]
                for end in ends:
                    np.minimum.at(root, end, np.minimum(*ends))
                while (root[root] != root).any():
                    root = root[root]
    tied = np.flatnonzero(root != np.arange(len(ids)))
    seen = np.flatnonzero(counts)
    return pa.table(
        {
            "a": pa.array(np.concatenate([ids[seen], ids[tied]]), pa.int64()),
            "b": pa.array([None] * len(seen) + ids[root[tied]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([counts[seen], np.zeros(len(tied), dtype=np.int64)])),
        }
    )


def link(vectors: DataFrame, least: float = 0.93, tile: int = TILE) -> DataFrame:
    """``a, b, n``: for ``b`` null, ``n`` links of ``a``; else a link of ``a`` and ``b``'s component."""
    spread = materialize(_spread(vectors.filter("vec_id is not null and label is not null"), least), "blocks")
    key = ["label", "dim", "block", "cell"]
    sizes = spread.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    parts = spread.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts")).cast("int"))
    tiles = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    found = tiles.groupBy(*key, "lo", "hi").applyInArrow(lambda t: _tile(t, least), "a long, b long, n long")
    return materialize(found, "tiles")


def near_duplicates(vectors: DataFrame, least: float = 0.93, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of ``vectors(vec_id, label, embedding)``."""
    named = vectors.filter("vec_id is not null").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    # Rows repeated in full are one vector.
    named = materialize(named.distinct(), "vectors")
    found = link(named, least, tile)
    counts = found.filter("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b"))
    rows = named.select("vec_id").distinct().join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    rows = rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    nameless = vectors.filter("vec_id is null").select(
        F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")
    )
    return rows.union(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
