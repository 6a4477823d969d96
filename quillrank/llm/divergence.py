"""Audit of how sources of a language differ in their words, by chunk factorization.

Texts are cut at white space and the chunks counted per document; only the distinct
chunks of the whole corpus are tokenized into terms, each once, and their terms carry
the counts of every language and source the chunk was met in. A language keeps the
terms of at least ``LEAST`` of its documents. Every group (language and source) and
every language gives each kept term a smoothed share in billionths; a triangular
divergence of shares compares groups with each other and with their language. All
arithmetic is in integers.

Whether enough documents have a term is mostly settled by its chunks: documents of
different sources differ, and those of a source are at least as many as its commonest
chunk's and at most the sum over its chunks. Where that leaves it open, every chunk of
the term has fewer than ``LEAST`` documents, so their numbers are known and counted.

Shares of a language's groups meet in tiles: a bucket of terms, two blocks of sources.
No task holds more than a tile, whatever the vocabulary or the number of sources.

Defined results: null texts, languages and sources are empty strings; each row is a
document, also rows repeated in full and rows without an id; a group without terms has
shares of count 0; a language without kept terms has pairs of value 0; a language of
one source has no pairs. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrank.llm.common import materialize

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term needs.
LEAST = 10
#: Terms that are listed for each group.
TOP = 10
SCALE = 1_000_000_000
#: Bytes of texts whose chunks are counted at once, and entries of a bucket after which its pieces are combined.
PORTION = 8 << 20
COMBINED = 500_000
#: Terms (about) and sources of a tile.
BUCKET = 4096
BLOCK = 128
PIECE = pa.schema(
    {"chunk": pa.string(), "lang": pa.string(), "source": pa.string(), "n": pa.int64(), "docs": pa.int64(), "ids": pa.list_(pa.int64())}
)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_)), dtype=bool), sorted_[1:] != sorted_[:-1]]))


def _named(ids: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> pa.ListArray:
    """Lists of ``ids``, ``sizes`` to each; null where not ``known``."""
    keep = np.repeat(known, sizes)
    lists = pa.ListArray.from_arrays(pa.array(_offsets(np.where(known, sizes, 0))), pa.array(ids[keep]))
    return pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~known)) if len(known) else lists


def _code(*columns: pa.Array) -> tuple[np.ndarray, int]:
    """One number for each combination of ``columns``, and how many may occur."""
    code, many = np.zeros(len(columns[0]), dtype=np.int64), 1
    for column in columns:
        own = column.dictionary_encode()
        code = code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
        many *= len(own.dictionary)
    return code, many


def _counted(docs: pa.Table, least: int) -> pa.RecordBatch:
    """Chunks of whole documents: occurrences and documents in each language and source."""
    lang, source, row, text = (docs.column(c).combine_chunks() for c in ("lang", "source", "row", "text"))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    chunks = lists.flatten().dictionary_encode()
    names, code = chunks.dictionary, chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many = max(1, len(names))
    # Once for each document, then for each group of documents.
    both = np.repeat(np.arange(len(text)), np.diff(lists.offsets.to_numpy())) * many + code
    both.sort(kind="stable")
    first = _runs(both)
    times, doc, code = np.diff(np.append(first, len(both))), both[first] // many, both[first] % many
    real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code] if len(names) else np.zeros(0, dtype=bool)
    times, doc, code = times[real], doc[real], code[real]
    group, groups = _code(lang, source)
    key = code * max(1, groups) + group[doc]
    order = np.argsort(key, kind="stable")
    doc, code = doc[order], code[order]
    first = _runs(key[order])
    sizes = np.diff(np.append(first, len(order)))
    at = doc[first]
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(code[first])), lang.take(pa.array(at)), source.take(pa.array(at)),
            pa.array(np.add.reduceat(times[order], first) if len(first) else np.zeros(0, dtype=np.int64)), pa.array(sizes.astype(np.int64)),
            _named(row.to_numpy()[doc], sizes, sizes < least),
        ],
        schema=PIECE,
    )


def _combined(pieces: pa.Table, least: int) -> pa.Table:
    """Each chunk once for each language and source, in order of chunks."""
    chunk, lang, source, n, docs, ids = (pieces.column(c).combine_chunks() for c in PIECE.names)
    chunks = chunk.dictionary_encode()
    group, groups = _code(lang, source)
    key = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, groups) + group
    order = np.argsort(key, kind="stable")
    first = _runs(key[order])
    if not len(first):
        return pieces
    n, docs = (np.add.reduceat(x.to_numpy()[order], first) for x in (n, docs))
    own = np.repeat(key, pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
    named = np.argsort(own, kind="stable")
    sizes = np.diff(np.append(np.searchsorted(own[named], key[order][first]), len(named)))
    at = pa.array(order[first])
    known = _named(ids.flatten().to_numpy()[named], sizes, docs < least)
    return pa.Table.from_arrays([chunk.take(at), lang.take(at), source.take(at), pa.array(n), pa.array(docs), known], schema=PIECE)


def chunk_counts(docs: DataFrame, least: int, buckets: int) -> DataFrame:
    """``bucket, piece``: chunks of a task's documents as Arrow batches, dealt to ``buckets`` by a hash of the chunk.

    A batch holds ``chunk, lang, source, n, docs, ids``: ``n`` occurrences in ``docs``
    documents, which ``ids`` names where they are fewer than ``least``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(level=1)

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            found = _counted(pa.Table.from_batches(held), least)
            names = found.column(0).dictionary_encode()
            bucket = np.array([xxhash.xxh64_intdigest(x) % buckets for x in names.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
            bucket = bucket[names.indices.to_numpy(zero_copy_only=False)] if len(found) else bucket
            order = np.argsort(bucket, kind="stable")
            first = _runs(bucket[order])
            found = found.take(pa.array(order))
            ends = np.append(first, len(order))
            pieces = [packed.compress(found.slice(a, b - a).take(pa.array(np.arange(b - a))).serialize()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][first].astype(np.int32)), pa.array(pieces, pa.binary())], names=["bucket", "piece"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= PORTION:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    rows = docs.select("lang", "source", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "bucket int, piece binary")


def factorized(pieces: DataFrame, least: int) -> DataFrame:
    """``lang, source, term, n, docs, ids``: each distinct chunk is tokenized once, and its terms joined to where it was met.

    A bucket's pieces follow each other and are combined as they come, so a task holds
    the distinct chunks of one bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        unpacked = zstandard.ZstdDecompressor()

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = _combined(pa.Table.from_batches(held), least)
            chunks = table.column("chunk").combine_chunks().dictionary_encode()
            terms = [find(chunk) for chunk in chunks.dictionary.to_pylist()]  # lower-cased before
            sizes = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
            flat = pa.array([t for own in terms for t in own], pa.string())
            code = chunks.indices.to_numpy(zero_copy_only=False)
            uses = sizes[code]
            at = np.repeat(np.arange(len(code)), uses)
            starts = (np.cumsum(sizes) - sizes)[code]
            term = np.arange(len(at)) - np.repeat(np.cumsum(uses) - uses, uses) + np.repeat(starts, uses)
            whole = table.combine_chunks().to_batches()[0] if len(table) else pa.RecordBatch.from_pylist([], PIECE)
            whole = whole.take(pa.array(at))
            return pa.RecordBatch.from_arrays(
                [whole.column("lang"), whole.column("source"), flat.take(pa.array(term)), *(whole.column(c) for c in ("n", "docs", "ids"))],
                names=["lang", "source", "term", "n", "docs", "ids"],
            )

        held, size, now = [], 0, None
        for batch in batches:
            for bucket, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and bucket != now:
                    yield out(held)
                    held, size = [], 0
                now = bucket
                held.append(pa.ipc.read_record_batch(pa.py_buffer(unpacked.decompress(piece)), PIECE))
                size += len(held[-1])
                if size > 2 * COMBINED and len(held) > 1:
                    held = _combined(pa.Table.from_batches(held), least).combine_chunks().to_batches()
                    size = sum(map(len, held)) // 2  # what is distinct may grow beyond the bound
        if held:
            yield out(held)

    # Every bucket in one task, its pieces one after the other.
    dealt = pieces.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "lang string, source string, term string, n long, docs long, ids array<long>")


def kept_terms(spread: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """``lang, term`` of the terms in at least ``least`` documents of the language."""
    bounds = counts.groupBy("lang", "term").agg(F.sum("fewest").alias("fewest"), F.sum("most").alias("most"))
    bounds = materialize(bounds.filter(F.col("most") >= least), "bounds")
    open_ = bounds.filter(F.col("fewest") < least).select("lang", "term")
    named = spread.select("lang", "term", "ids").join(open_, ["lang", "term"], "left_semi")
    documents = named.select("lang", "term", F.explode("ids").alias("id")).distinct().groupBy("lang", "term").agg(F.count("*").alias("docs"))
    return bounds.filter(F.col("fewest") >= least).select("lang", "term").union(documents.filter(F.col("docs") >= least).select("lang", "term"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """Billionths of a term met ``n`` times among ``total`` occurrences of ``terms`` kept terms."""
    wide = "decimal(28,0)"
    scaled = (n + 2).cast(wide) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, F.nullif(total + 2 * terms, F.lit(0)).cast(wide))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Divergence of every source of one block from every source of the other over one bucket's terms."""
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "value")})
    if not groups.num_rows:
        return empty
    places = groups.column("place").to_numpy()
    order = np.argsort(places)
    places, zero = places[order], groups.column("p0").to_numpy()[order]
    block, lo, hi = (groups.column(c).to_numpy()[order] for c in ("block", "lo", "hi"))
    seen, at = np.unique(counts.column("term").to_numpy(zero_copy_only=False), return_inverse=True) if counts.num_rows else ([], [])
    shares = np.repeat(zero[:, None], len(seen), axis=1)
    if counts.num_rows:
        shares[np.searchsorted(places, counts.column("place").to_numpy()), at] = counts.column("p").to_numpy()
    unseen = int(groups.column("terms")[0].as_py()) - len(seen)
    a, b, values = [], [], []
    for i in np.flatnonzero(block == lo):
        others = np.flatnonzero((block == hi) & (places > places[i] if lo[i] == hi[i] else True))
        if not len(others):
            continue
        apart, both = shares[others] - shares[i], shares[others] + shares[i]
        value = (apart * apart // both).sum(axis=1)
        gap = zero[others] - zero[i]
        value += unseen * (gap * gap // np.maximum(1, zero[others] + zero[i]))
        a += [np.full(len(others), places[i]), places[others]]
        b += [places[others], np.full(len(others), places[i])]
        values += [value, value]
    if not a:
        return empty
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "value": np.concatenate(values).astype(np.int64)})


def _pairs(shares: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of each two sources of a language."""
    in_lang = Window.partitionBy("lang")
    place = (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long")
    numbered = groups.withColumn("place", place)
    sizes = numbered.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.first("kept") / BUCKET)).cast("long").alias("buckets"), F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")
    )
    numbered = materialize(numbered.join(sizes, "lang").withColumn("block", F.floor(F.col("place") / BLOCK)), "groups")
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets"))
    filled = kept.join(sizes, "lang").groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("terms"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    ends = (F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    key = ["lang", "bucket", "lo", "hi"]
    asked = numbered.select("lang", "place", "p0", "block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    asked = asked.join(filled, ["lang", "bucket"], "left").select("lang", "bucket", "place", F.coalesce("p0", F.lit(0)).cast("long").alias("p0"), "block", F.coalesce("terms", F.lit(0)).alias("terms"), other)
    # Columns of the two sides must not be the same ones.
    asked = asked.select("lang", "bucket", F.col("place").alias("place"), "p0", F.col("block").alias("block"), "terms", *ends)
    held = shares.join(numbered.select("lang", "source", "place", "block", "blocks", "buckets"), ["lang", "source"])
    held = held.select("lang", bucket.alias("bucket"), "term", "place", "p", "block", other).select("lang", "bucket", "term", "place", "p", *ends)

    def tile(at: tuple, counts: pa.Table, own: pa.Table) -> pa.Table:
        found = _tile(counts, own)
        return found.append_column("lang", pa.array([at[0].as_py()] * len(found), pa.string()))

    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(tile, "a long, b long, value long, lang string")
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = numbered.select("lang", "place", "source")
    first = summed.join(names.withColumnRenamed("place", "a"), ["lang", "a"])
    return first.join(names.select("lang", F.col("place").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(lang, source, text)``.

    Part ``pair`` ranks the other sources of the language by their divergence, part
    ``term`` the ``top`` terms that are commoner in the group than in its language.
    """
    none = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c), none).alias(c) for c in ("lang", "source", "text")])
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(factorized(chunk_counts(rows, least, buckets), least), "terms")
    counts = spread.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.max("docs").alias("fewest"), F.sum("docs").alias("most"))
    counts = materialize(counts, "counts")
    kept = materialize(kept_terms(spread, counts, least), "kept")
    own = materialize(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    groups = groups.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").na.fill(0, ["total", "kept"])
    groups = materialize(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("kept"))), "sources")
    shares = own.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "kept", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    pairs = _pairs(shares.select("lang", "source", "term", "p"), groups, kept)
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    common = own.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(langs, "lang")
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = shares.join(common, ["lang", "term"]).withColumn("q", q).filter("p > q")
    terms = above.select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    listed = terms.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*columns)
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns).union(listed)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
c AS MATERIALIZED (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= {LEAST}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
own AS MATERIALIZED (SELECT lang, source, term, sum(n) AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(own.n, 0) + 2)) // (g.total + 2 * g.v) AS p
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
q AS (
  SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q
  FROM p JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
listed AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM listed)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
