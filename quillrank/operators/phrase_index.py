"""Phrase rules held in a table: matching as a join, for rule sets of any size.

``scoring`` writes every term into the plan, which suits some hundred terms. Here the
terms stay rows. Texts and terms are cut into runs of word characters and of others; a
term is filed under its words and what is between them, an equality join with the texts'
pieces of as many words finds where it may be, and its ends are then compared with the runs
around that place. The plan is the same for ten terms and for a million.

Terms of up to ``pieces.SIZES`` numbers of words are filed whole; where there are more, a
term is filed under the rarest of its pieces of the next smaller number, and the runs
around the place reach as far as the longest such term. Pieces of texts are dropped where
they are cut, unless they may be pieces of a term: each text is shuffled once, and all else
grows with what is found. Terms without any word character are filed whole and looked up
among the pieces, no longer than the longest such term, of the texts' other runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import WORD, fold
from quillrank.operators.pieces import largest_size, possible, sizes

_RUNS = f"[{WORD}]+|[^{WORD}]+"


def runs(text: Column) -> Column:
    """The folded text as runs of word characters and of others, in order."""
    return F.regexp_extract_all(fold(text), F.lit(_RUNS), F.lit(0))


def _is_word(run: Column) -> Column:
    return F.coalesce(run.rlike(f"^[{WORD}]"), F.lit(False))


def term_table(rules: DataFrame) -> DataFrame:
    """``rule_no, rule, weight, term_no, term, parts`` of ``rules(rule_no, name, weight, terms)``; empty terms have no parts."""
    rows = rules.select("rule_no", F.col("name").alias("rule"), "weight", F.posexplode("terms").alias("term_no", "term"))
    return rows.withColumn("parts", runs(F.col("term"))).filter(F.size("parts") > 0)


def _first_word(runs_: Column) -> Column:
    """Where the first run of word characters is; runs alternate."""
    return F.when(_is_word(F.get(runs_, F.lit(0))), 0).otherwise(1)


def _term_pieces(terms: DataFrame, chosen: list[int]) -> DataFrame:
    """``folded, parts, part, length, piece, mark``: pieces of the words of each different term, by where they begin in it."""
    own = terms.groupBy("folded").agg(F.first("parts").alias("parts"), F.first("words").alias("words"))
    own = own.withColumn("size", largest_size(F.col("words"), chosen)).withColumn("length", 2 * F.col("size") - 1)
    starts = F.explode(F.sequence(F.lit(0), F.col("words") - F.col("size"))).alias("word")
    rows = own.select("folded", "parts", "length", starts).withColumn("part", _first_word(F.col("parts")) + 2 * F.col("word"))
    piece = F.slice("parts", F.col("part") + 1, F.col("length"))
    return rows.select("folded", "parts", "part", "length", F.array_join(piece, "").alias("piece"), F.xxhash64(piece).alias("mark"))


def _text_pieces(texts: DataFrame, chosen: list[int]) -> DataFrame:
    """``_text, runs, at, length, mark`` of all pieces of the ``chosen`` numbers of words of ``texts(_text, runs)``."""
    rows = texts.select("_text", "runs", _first_word(F.col("runs")).alias("first"), F.posexplode("runs").alias("at", "_run"))
    length = F.explode(F.array(*(F.lit(2 * n - 1) for n in chosen)).cast("array<int>")).alias("length")
    rows = rows.filter(F.col("at") % 2 == F.col("first")).select("_text", "runs", "at", length)
    rows = rows.filter(F.col("at") + F.col("length") <= F.size("runs"))
    return rows.withColumn("mark", F.xxhash64(F.slice("runs", F.col("at") + 1, F.col("length"))))


def _worded(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``_text, folded`` of terms with words."""
    terms = terms.withColumn("words", F.size(F.filter("parts", _is_word))).filter("words > 0")
    chosen, whole = sizes(terms, "words")
    pieces = _term_pieces(terms, chosen)
    # How far terms reach out of their pieces; one run more tells whether the text goes on there.
    reach = pieces.agg(F.max("part").alias("before"), F.max(F.size("parts") - F.col("part") - F.col("length")).alias("after")).first()
    before, after = ((n + 1 if n else 0) for n in reach)
    start = F.greatest(F.col("at") - before, F.lit(0))
    around = F.slice("runs", start + 1, F.col("at") - start + F.col("length") + after)
    held = possible(_text_pieces(texts, chosen), pieces.select("mark"), "mark")
    piece = F.array_join(F.slice("runs", F.col("at") + 1, F.col("length")), "").alias("piece")
    # Equal places of a text count once.
    places = held.select("_text", piece, (F.col("at") - start).alias("at"), around.alias("around")).distinct()
    if whole:
        filed = pieces.select("folded", "parts", "part", "piece")
    else:
        number = places.groupBy("piece").agg(F.count("*").alias("places"))
        # A term with a piece that no text has is in no text.
        rarest = F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "part", "piece")).alias("rarest")
        filed = pieces.join(number, "piece", "left").groupBy("folded").agg(rarest, F.first("parts").alias("parts")).filter("rarest.places > 0")
        filed = filed.select("folded", "parts", F.col("rarest.part").alias("part"), F.col("rarest.piece").alias("piece"))
    fits = _phrase_at(F.col("around"), F.col("at") - F.col("part"), F.col("parts"))
    return places.join(filed, "piece").filter(fits).select("_text", "folded").distinct()


def _phrase_at(runs_: Column, start: Column, parts: Column) -> Column:
    """``parts`` stand in ``runs_`` from ``start`` on, with no word character before or after."""
    size, last = F.size(parts), F.size(parts) - 1
    head, tail = F.get(runs_, start), F.get(runs_, start + last)
    opens, closes = F.get(parts, F.lit(0)), F.get(parts, last)
    # A run of other characters may go on outside of the term, but not into a word.
    head_fits = (head == opens) & (_is_word(opens) | (start == 0)) | (
        ~_is_word(opens) & F.endswith(head, opens) & (F.length(head) > F.length(opens))
    )
    tail_fits = (tail == closes) & (_is_word(closes) | (start + size == F.size(runs_))) | (
        ~_is_word(closes) & F.startswith(tail, closes) & (F.length(tail) > F.length(closes))
    )
    inner = (size <= 2) | (F.slice(runs_, start + 2, F.greatest(size - 2, F.lit(0))) == F.slice(parts, 2, F.greatest(size - 2, F.lit(0))))
    return (start >= 0) & F.coalesce(head_fits & tail_fits & inner, F.lit(False))


def _wordless(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``_text, folded`` of terms without any word character."""
    own = terms.filter((F.size("parts") == 1) & ~_is_word(F.get("parts", F.lit(0)))).select(F.get("parts", F.lit(0)).alias("piece")).distinct()
    longest = own.agg(F.coalesce(F.max(F.length("piece")), F.lit(0))).first()[0]
    rows = texts.select("_text", F.size("runs").alias("runs_"), F.posexplode("runs").alias("at", "run")).filter(~_is_word(F.col("run")))
    starts = rows.select("*", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    longest_here = F.least(F.lit(longest), F.length("run") - F.col("start") + 1)
    pieces = starts.filter(F.lit(longest) > 0).select("*", F.explode(F.sequence(F.lit(1), longest_here)).alias("size"))
    free = ((F.col("start") > 1) | (F.col("at") == 0)) & ((F.col("start") + F.col("size") <= F.length("run")) | (F.col("at") + 1 == F.col("runs_")))
    pieces = pieces.filter(free).select("_text", F.substring("run", F.col("start"), F.col("size")).alias("piece")).withColumn("mark", F.xxhash64("piece"))
    held = possible(pieces, own.select(F.xxhash64("piece").alias("mark")), "mark").select("_text", "piece").distinct()
    return held.join(own, "piece").select("_text", F.col("piece").alias("folded"))


def phrase_hits(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """``key, rule, weight, term_no, term``: which terms of ``rules(rule_no, name, weight, terms)`` each row's text has.

    One row for each row of ``df``, rule and term found. Equal texts are looked at once, equal terms looked for once.
    """
    terms = term_table(rules).filter("rule_no is not null").withColumn("folded", F.array_join("parts", ""))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_read"), F.sha2(F.col(text), 256).alias("_text")).filter("_text is not null")
    # A shuffle of the texts: copies meet, and the work is spread however few files the texts came in.
    texts = rows.groupBy("_text").agg(F.first("_read").alias("_read")).select("_text", runs(F.col("_read")).alias("runs"))
    hits = _worded(texts, terms).union(_wordless(texts, terms))
    found = rows.select(F.col("_key").alias(key), "_text").join(hits, "_text").select(key, "folded")
    return found.join(terms.drop("parts", "rule_no"), "folded").select(key, "rule", "weight", "term_no", "term")
