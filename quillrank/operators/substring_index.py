"""Which of many needles each text contains, as a join on pieces of the needles.

``scoring`` tests a short list of names one by one. Here needles are rows: each is filed
under a piece of itself, an equality join with the texts' pieces of that size finds where
it may be. Needles of up to ``pieces.SIZES`` lengths are filed whole. Where there are more
lengths, a needle is filed under the rarest of its pieces of the next smaller size, and the
whole needle is looked for in the text itself.

Pieces of texts are dropped where they are cut, unless they may be pieces of a needle: each
text is shuffled once, and all else grows with what is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import fold
from quillrank.operators.pieces import largest_size, possible, sizes

#: Characters of a text that are cut at once: to find the n-th one, those before it are passed.
BLOCK = 256


def _grams(texts: DataFrame, chosen: list[int]) -> DataFrame:
    """``_text, gram, mark`` of all pieces of the ``chosen`` sizes of ``texts(_text, _folded)``."""
    longest = max(chosen, default=0)
    starts = F.explode(F.sequence(F.lit(1), F.length("_folded"), F.lit(BLOCK))).alias("start")
    blocks = texts.select("_text", "_folded", starts).select("_text", F.substring("_folded", F.col("start"), F.lit(BLOCK + longest - 1)).alias("block"))
    size = F.explode(F.array(*map(F.lit, chosen)).cast("array<int>")).alias("size")
    blocks = blocks.select("_text", "block", size).filter(F.length("block") >= F.col("size"))
    last = F.least(F.lit(BLOCK), F.length("block") - F.col("size") + 1)
    grams = blocks.select("_text", "block", "size", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    grams = grams.select("_text", F.substring("block", F.col("at"), F.col("size")).alias("gram"))
    return grams.withColumn("mark", F.xxhash64("gram"))


def substring_matches(df: DataFrame, key: str, text: str, needles: DataFrame) -> DataFrame:
    """``key, needle_no`` of the rows of ``df`` whose caseless text contains a needle of ``needles(needle_no, needle)``.

    One row for each row and needle. Empty needles and null texts match nothing; equal
    texts are looked at once.
    """
    own = needles.select("needle_no", fold(F.col("needle")).alias("needle")).filter("needle <> ''").withColumn("length", F.length("needle"))
    chosen, whole = sizes(own, "length")
    rows = df.select(F.col(key).alias("_key"), fold(F.col(text)).alias("_folded")).filter("_folded <> ''")
    rows = rows.withColumn("_text", F.sha2("_folded", 256))
    # Copies are cut once for each, but give their pieces once.
    # A shuffle of the texts: copies meet, and the work is spread however few files the texts came in.
    texts = rows.groupBy("_text").agg(F.first("_folded").alias("_folded"))
    starts = F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("at")
    cut = own.withColumn("size", largest_size(F.col("length"), chosen)).select("needle_no", "needle", "size", starts)
    pieces = cut.select("needle_no", "needle", F.substring("needle", F.col("at"), F.col("size")).alias("gram"))
    wanted = pieces.select(F.xxhash64("gram").alias("mark"))
    grams = possible(_grams(texts, chosen), wanted, "mark").select("_text", "gram").distinct()
    if whole:
        found = grams.join(pieces, "gram").filter(F.contains("gram", "needle"))
    else:
        places = grams.groupBy("gram").agg(F.count("*").alias("texts"))
        # A needle with a gram that no text has is in no text.
        rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest")
        filed = pieces.join(places, "gram", "left").groupBy("needle_no", "needle").agg(rarest).filter("rarest.texts > 0")
        filed = filed.select("needle_no", "needle", F.col("rarest.gram").alias("gram"))
        found = grams.join(filed, "gram").join(texts, "_text").filter(F.contains("_folded", "needle"))
    found = found.select("_text", "needle_no").distinct()
    return rows.select(F.col("_key").alias(key), "_text").join(found, "_text").select(key, "needle_no")
