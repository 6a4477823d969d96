"""Merkle manifest of a dataset: digests of rows, a tree per source, one root, and a proof for each row.

Rows of a source in the order of their ids are the leaves of its tree; runs of
``FAN`` neighbours give one parent, level by level, and the roots of the sources are
the leaves of the tree on top. On every level a window over the run gives each node
its siblings as columns at fixed offsets (lag and lead, empty beyond the run's ends);
the run's first child hashes the parent and carries it to the next level. A window
never holds more than a run, so a source with a third of all rows is no larger a
task than others: places within a source are found by range partitions with offsets.

Paths go back down: a node's path is its parent's, headed by its own siblings. The
leaves' siblings are worked out again rather than stored.

Defined results: a null is the digest's ``-``; an empty text is ``0:``. Rows without an
id come first, rows of one id follow by their leaf; rows repeated in full are leaves of
their own. Tampering needs an id: rows without one stay. A single leaf is its own
subroot, a single source's subroot is the root. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrank.llm.common import materialize

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """One sha256 over ``values``, each told apart by its length."""
    parts = [v.cast("string") for v in values]
    said = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in parts]
    return F.sha2(F.concat(*said), 256)


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, their place within ``group`` in ``order``, and ``n``, the group's size.

    Ranges of the sorted rows are written, so that boundaries are drawn once; a group
    spread over many ranges continues from the sizes of its earlier ones.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, F.col(group), *order, F.col("_row")).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_size"))
    starts = sizes.select(
        group, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"), F.sum("_size").over(Window.partitionBy(group)).alias("n")
    )
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order, "_row"))
    return ranged.withColumn("_place", inside).join(starts, [group, "_range"]).withColumn("pos", F.col("_start") + F.col("_place") - 1).drop("_row", "_range", "_place", "_start")


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes(tree, pos, n, h)`` with ``run``, ``slot``, and the digests ``left`` and ``right`` of each in its run."""
    placed = nodes.withColumn("run", F.floor(F.col("pos") / FAN)).withColumn("slot", (F.col("pos") % FAN).cast("int"))
    width = F.least(F.lit(FAN).cast("long"), F.col("n") - F.col("run") * FAN)
    window = Window.partitionBy("tree", "run").orderBy("slot")
    none = F.lit("")
    before = [F.when(F.col("slot") >= j, F.lag("h", j).over(window)).otherwise(none) for j in range(FAN - 1, 0, -1)]
    after = [F.when(F.col("slot") + j < width, F.lead("h", j).over(window)).otherwise(none) for j in range(1, FAN)]
    return placed.withColumns({"left": F.concat(*before), "right": F.concat(*after)})


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The written nodes ``tree, pos, n, h`` of every level, from ``leaves`` to the level where each tree has one."""
    found = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = _with_siblings(found[-1]).filter("slot = 0")
        parent = F.when(F.col("n") > 1, F.sha2(F.concat("h", "right"), 256)).otherwise(F.col("h"))
        above = first.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), parent.alias("h"))
        found.append(materialize(above, "level"))
        most = -(-most // FAN)
    return found


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with the ``path`` of ``above(tree, pos, path, ...)`` headed by their own siblings."""
    placed = _with_siblings(nodes)
    step = F.array(F.struct("left", "right"))
    path = F.when(F.col("n") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))
    parents = above.withColumnRenamed("pos", "run")
    return placed.join(parents, ["tree", "run"]).withColumn("path", path).drop("run", "slot", "left", "right")


def _climbed(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest level with the paths to the top; ``roots(tree, path, ...)`` has one row a tree."""
    at = roots.withColumn("pos", F.lit(0).cast("long"))
    for nodes in levels[-2:0:-1]:
        at = materialize(_down(nodes, at).drop("n", "h"), "paths")
    if len(levels) > 1:
        return _down(levels[0], at)
    return levels[0].join(at, ["tree", "pos"])


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """``doc_id, source, pos, leaf, subroot, root, proof_sha256, folded_root, verified, path`` of ``docs``.

    ``path`` holds the siblings on each level, left and right of the row's own node;
    ``folded_root`` follows it from the row as ``tampered`` changes it.
    """
    spark = docs.sparkSession
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"text": F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}
    # A null source sorts before all others, the empty one included.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select("doc_id", "source", tree.alias("tree"), digest(*columns.values()).alias("h"), digest(*changed.values()).alias("changed"))
    rows = materialize(numbered(rows, "tree", [F.col("doc_id"), F.col("h")]), "leaves")
    levels = _levels(rows.select("tree", "pos", "n", "h"))
    subroots = levels[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("own"), "h")
    subroots = materialize(numbered(subroots, "tree", [F.col("own")]), "subroots")
    top = _levels(subroots.select("tree", "pos", "n", "h"))
    path = spark.createDataFrame([], "p array<struct<left:string,right:string>>").schema["p"].dataType
    apex = top[-1].select("tree", F.col("h").alias("root"), F.array().cast(path).alias("path"))
    named = _climbed([subroots.select("tree", "pos", "n", "h", "own"), *top[1:]], apex)
    named = materialize(named.select(F.col("own").alias("tree"), F.col("h").alias("subroot"), "root", "path"), "named")
    proven = _climbed([rows, *levels[1:]], named)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate("path", F.col("changed"), lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
    proven = proven.select(
        "doc_id", "source", "pos", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"), "path"
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampers(hash_of_id: Column) -> Column:
    return F.col("doc_id").isNotNull() & (hash_of_id % 5 == 0)


def _sql(levels: int = 5, tops: int = 2) -> str:
    """The same manifest for DuckDB: trees of up to 16^``levels`` leaves and 16^``tops`` sources."""
    step = "CASE WHEN (c & 1) <> 0 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: {step})"

    def said(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(said(text if c == "text" else c) for c in FIELDS) + ")"

    def climb(name: str, height: int) -> str:
        out = []
        for k in range(height):
            below = f"{name}{k}"
            out.append(
                f"{below}r AS MATERIALIZED (SELECT tree, pos // {FAN} AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {below} GROUP BY ALL)"
            )
            out.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT tree, run AS pos, (n + {FAN - 1}) // {FAN} AS n, "
                f"CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {below}r)"
            )
        return ",\n".join(out)

    def fold(rows: str, name: str, height: int) -> str:
        out, at = [], rows
        for k in range(height):
            left, right = f"array_to_string(r.hs[1:(x.spot % {FAN})], '')", f"array_to_string(r.hs[(x.spot % {FAN}) + 2:], '')"
            out.append(
                f"{rows}{name}{k} AS (SELECT x.* REPLACE (x.spot // {FAN} AS spot, CASE WHEN r.n > 1 THEN x.proof || {left} || {right} ELSE x.proof END AS proof, "
                f"CASE WHEN r.n > 1 THEN sha256({left} || x.fold || {right}) ELSE x.fold END AS fold) "
                f"FROM {at} x JOIN {name}{k}r r ON x.{name}_tree = r.tree AND x.spot // {FAN} = r.run)"
            )
            at = f"{rows}{name}{k}"
        return ",\n".join(out)

    return f"""
WITH crc AS (SELECT list_transform({table}, lambda c: c::BIGINT) AS t),
base AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_transform(range(strlen(doc_id::VARCHAR)),
        lambda i: CAST('0x' || substr(hex(encode(doc_id::VARCHAR)), 2 * i::BIGINT + 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 5 = 0
    THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS changed
  FROM documents, crc),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM base),
a0 AS (SELECT tree, pos, n, leaf AS h FROM placed),
{climb('a', levels)},
b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, h, tree AS own FROM a{levels}),
{climb('b', tops)},
l AS (SELECT doc_id, leaf, tree AS a_tree, 0 AS b_tree, pos AS spot, '' AS proof, changed AS fold FROM placed),
{fold('l', 'a', levels)},
m AS (SELECT x.* REPLACE (b0.pos AS spot), b0.h AS subroot FROM la{levels - 1} x JOIN b0 ON b0.own = x.a_tree),
{fold('m', 'b', tops)}
SELECT doc_id, leaf, subroot, b{tops}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{tops}.h AS verified
FROM mb{tops - 1}, b{tops}"""


SQL = _sql()
