"""What the indices of phrases and of substrings share: sizes to file under, and a filter before the shuffle.

A term or needle is filed under a piece of itself. The longer the piece, the fewer the
places of the texts that have it, so pieces are as long as the terms themselves as long
as these come in few sizes; a text is cut once for each size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of pieces at most; a text is cut once for each.
SIZES = 8
#: Bits of the filter, a power of two: a broadcast table of one row for 64 of them, whatever number of pieces is sought.
BITS = 1 << 26


def sizes(wanted: DataFrame, size: str) -> tuple[list[int], bool]:
    """At most ``SIZES`` of the sizes in ``wanted``, the smallest included, and whether these are all."""
    found = sorted(tuple(r) for r in wanted.groupBy(size).agg(F.count("*")).collect())  # a row per size
    if len(found) <= SIZES:
        return [n for n, _ in found], True
    total, before, chosen = sum(c for _, c in found), 0, []
    for n, count in found:
        # The size at which each further share of the terms begins.
        if before * SIZES >= len(chosen) * total and len(chosen) < SIZES:
            chosen.append(n)
        before += count
    return chosen, False


def largest_size(size: Column, chosen: list[int]) -> Column:
    """The largest of ``chosen`` that is not above ``size``."""
    return F.array_max(F.filter(F.array(*map(F.lit, chosen)).cast("array<int>"), lambda n: n <= size))


def possible(rows: DataFrame, wanted: DataFrame, mark: str) -> DataFrame:
    """The rows whose ``mark``, a hash, may be in ``wanted``: all that are, and few others.

    Each mark wanted sets one bit of a table of fixed size, which goes to every task. Rows
    that no join could match end here, where they were made, and are not shuffled.
    """
    def place(shift: int) -> Column:
        return F.shiftrightunsigned(F.col(mark).bitwiseAND(F.lit(BITS - 1).cast("long")), shift)

    bit = F.col(mark).bitwiseAND(F.lit(63).cast("long")).cast("int")
    marked = wanted.select(place(6).alias("_place"), F.expr("1L").alias("_one"), bit.alias("_bit"))
    table = marked.groupBy("_place").agg(F.expr("bit_or(shiftleft(_one, _bit))").alias("_bits"))
    held = rows.withColumn("_place", place(6)).join(F.broadcast(table), "_place")
    return held.filter(F.getbit("_bits", bit) == 1).drop("_place", "_bits")
