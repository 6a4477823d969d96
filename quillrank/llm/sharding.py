"""Sharding along a Hilbert curve over several metadata columns.

Language, source and size are quantised to five bits each, and the row's place on the
Hilbert curve through that cube orders the table: rows near each other agree in all
three, so a reader that filters on any of them skips most files. Runs of the order
become shards. The law is ``rows``: counts differ by at most one.

Strings are quantised by the share of rows with smaller values, sizes by their power of
two. Both keep order, so a file's smallest and largest value stay close.

Defined results: null texts count as empty ones; null strings come last; a null id comes
last among equals; rows repeated in full are interchangeable; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import materialize, running

BITS = 5
DIMENSIONS = ("lang", "source", "size")


def curve_steps(columns: list[str], bits: int, xor: str = "({} ^ {})") -> list[dict[str, str]]:
    """SQL assignments, step by step, that turn coordinates into ``curve``, the Hilbert index.

    Skilling's transform: inverse undo from the highest bit down, Gray code, and the bits
    of all coordinates in turn. ``xor`` says how a dialect writes the operation.
    """
    def flip(a: str, b: str) -> str:
        return xor.format(a, b)

    steps: list[dict[str, str]] = []
    first = columns[0]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for c in columns:
            if c == first:
                steps.append({first: f"CASE WHEN ({first} & {q}) <> 0 THEN {flip(first, str(q - 1))} ELSE {first} END"})
                continue
            swap = f"({flip(first, c)} & {q - 1})"
            steps.append({
                first: f"CASE WHEN ({c} & {q}) <> 0 THEN {flip(first, str(q - 1))} ELSE {flip(first, swap)} END",
                c: f"CASE WHEN ({c} & {q}) <> 0 THEN {c} ELSE {flip(c, swap)} END",
            })
    for before, c in zip(columns, columns[1:]):
        steps.append({c: flip(c, before)})
    last = columns[-1]
    turn = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = flip(turn, f"CASE WHEN ({last} & {q}) <> 0 THEN {q - 1} ELSE 0 END")
    steps.append({c: flip(c, f"({turn})") for c in columns})
    n = len(columns)
    terms = [
        f"CASE WHEN ({c} & {1 << b}) <> 0 THEN {1 << (b * n + n - 1 - i)} ELSE 0 END" for b in range(bits) for i, c in enumerate(columns)
    ]
    steps.append({"curve": " + ".join(terms)})
    return steps


def with_curve(df: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``curve`` over integer ``columns``; these columns are used up."""
    df = df.withColumn("curve", F.lit(0).cast("long"))
    for step in curve_steps(columns, bits):
        df = df.withColumns({name: F.expr(f"CAST({sql} AS BIGINT)") for name, sql in step.items()})
    return df.drop(*columns)


def quantised(df: DataFrame, column: str, name: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``name``: in which of 2^bits equal shares of the rows the value begins."""
    counts = materialize(df.groupBy(column).agg(F.count("*").alias("_n")), "values")
    total = counts.agg(F.sum("_n")).first()[0] or 1
    codes = running(counts, [F.col(column).asc_nulls_last()], F.col("_n"), "_before").select(
        F.col(column).alias("_value"), F.floor(F.col("_before") * (1 << bits) / F.lit(total)).alias(name)
    )
    return df.join(codes, df[column].eqNullSafe(codes["_value"])).drop("_value")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` without its text, with ``size, text_crc32, law, shard, slot, grown_shard``."""
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")
    rest = [c for c in docs.columns if c not in (*made, "text")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*rest, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(rows, "sizes")
    total = rows.count()
    coded = quantised(quantised(rows, "lang", "_lang"), "source", "_source")
    octave = F.least(F.length(F.bin("size")) - 1, F.lit((1 << BITS) - 1)).cast("long")
    coded = with_curve(coded.withColumn("_octave", octave), ["_lang", "_source", "_octave"])
    order = [F.col("curve"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    ranked = running(coded, order, F.lit(1), "_rank")
    whole, extra = divmod(total, shards)  # the first ``extra`` shards hold one row more
    rank = F.col("_rank")
    early = rank < extra * (whole + 1)
    late = rank - extra * (whole + 1)
    width = max(whole, 1)
    return ranked.select(
        *rest, "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(early, F.floor(rank / (whole + 1))).otherwise(extra + F.floor(late / width)).cast("int").alias("shard"),
        F.when(early, rank % (whole + 1)).otherwise(late % width).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def _sql() -> str:
    """The same shards for DuckDB, with crc32 worked out byte by byte."""
    step = "CASE WHEN (c & 1) <> 0 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: {step})"
    levels = 1 << BITS
    ctes, at = [], "c0"
    for n, assign in enumerate(curve_steps(["x", "y", "z"], BITS, "xor({}, {})"), 1):
        if "curve" in assign:
            ctes.append(f"c{n} AS (SELECT *, {assign['curve']} AS curve FROM {at})")
        else:
            ctes.append(f"c{n} AS (SELECT * REPLACE ({', '.join(f'CAST({sql} AS BIGINT) AS {c}' for c, sql in assign.items())}) FROM {at})")
        at = f"c{n}"
    return f"""
WITH crc AS (SELECT list_transform({table}, lambda c: c::BIGINT) AS t),
base AS (
  SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_transform(range(octet_length(encode(coalesce(text, '')))),
        lambda i: CAST('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i::BIGINT + 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc),
langs AS (SELECT lang, sum(count(*)) OVER (ORDER BY lang NULLS LAST) - count(*) AS b FROM base GROUP BY lang),
sources AS (SELECT source, sum(count(*)) OVER (ORDER BY source NULLS LAST) - count(*) AS b FROM base GROUP BY source),
c0 AS (
  SELECT base.*, CAST(floor(langs.b * {levels} / (SELECT count(*) FROM base)) AS BIGINT) AS x,
    CAST(floor(sources.b * {levels} / (SELECT count(*) FROM base)) AS BIGINT) AS y,
    CAST(least(length(bin(size)) - 1, {levels - 1}) AS BIGINT) AS z
  FROM base JOIN langs ON base.lang IS NOT DISTINCT FROM langs.lang JOIN sources ON base.source IS NOT DISTINCT FROM sources.source),
{', '.join(ctes)},
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS LAST, size, text_crc32) - 1 AS r, count(*) OVER () // 16 AS w, count(*) OVER () % 16 AS e FROM {at})
SELECT doc_id, lang, source, size, text_crc32, 'rows' AS law,
  CAST(CASE WHEN r < e * (w + 1) THEN r // (w + 1) ELSE e + (r - e * (w + 1)) // greatest(w, 1) END AS INTEGER) AS shard,
  CAST(CASE WHEN r < e * (w + 1) THEN r % (w + 1) ELSE (r - e * (w + 1)) % greatest(w, 1) END AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve
FROM ranked"""


SQL = _sql()
