"""Report rows and their Markdown lines.

Lines carry their sort position as ``part``: year, bucket, number and line inside
the entry. Only the top rows of each group ever become lines.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.config import DECISIONS
from quillrank.functions import urls
from quillrank.functions.rows import unnest
from quillrank.functions.text import short_number, text_or_null


def decision_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DECISIONS)), c).cast("int")


def speaker_suffix() -> Column:
    """`` - speaker, company`` without blanks."""
    who = F.concat_ws(", ", text_or_null(F.col("speaker")), text_or_null(F.col("company")))
    return F.when(who != "", F.concat(F.lit(" - "), who)).otherwise(F.lit(""))


def summary_counts(items: DataFrame) -> DataFrame:
    """Totals over all given rows, undated ones too."""
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("decision") == "watch").alias("watch"),
        F.count_if(F.col("decision") == "skim").alias("skim"),
        F.count_if(F.col("decision") == "skip").alias("skipped"),
    )


def rollup_counts(items: DataFrame) -> DataFrame:
    """Items and best score by every choice of year, decision and source, all in one pass over the items.

    ``grouping_id`` tells totals from rows of unknown year, decision or source: a bit is
    set for each of the three that is summed over.
    """
    return items.cube("year", "decision", "source").agg(
        F.count("*").alias("items"), F.max("score").alias("top_score"), F.grouping_id().alias("grouping_id")
    )


def distinct_sketches(items: DataFrame) -> DataFrame:
    """``source, sketch``: a mergeable sketch of the addresses of each source, of a few kB however many there are."""
    return items.filter("source is not null").groupBy("source").agg(F.hll_sketch_agg("url").alias("sketch"))


def merged_distinct(*runs: DataFrame) -> DataFrame:
    """``source, runs, distinct_items``: different addresses over all runs, from their sketches alone."""
    both = runs[0]
    for run in runs[1:]:
        both = both.unionByName(run)
    merged = both.groupBy("source").agg(F.count("*").alias("runs"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("source", "runs", F.hll_sketch_estimate("sketch").alias("distinct_items"))


def watchlist_top(
    items: DataFrame, start_year: int, end_year: int, top: int, year_column: str = "year"
) -> DataFrame:
    """The best ``top`` items of every year and bucket, numbered from 1.

    Years and buckets are few, so the rank limit is what keeps groups small: it
    is applied before the shuffle, and a task sends ``top`` rows per group at most.
    """
    year = F.col(year_column)
    rows = items.filter(year.between(start_year, end_year)).withColumn("report_year", year)
    order = Window.partitionBy("report_year", "decision").orderBy(
        F.col("score").desc_nulls_last(), F.col("title").asc_nulls_first(), F.col("url").asc()
    )
    return rows.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= top)


def weekly_top(items: DataFrame, top: int) -> DataFrame:
    """The best ``top`` items overall, numbered inside their bucket."""
    best = items.orderBy(
        F.col("score").desc_nulls_last(),
        F.col("year").asc_nulls_first(),
        F.col("decision").asc(),
        F.col("title").asc_nulls_first(),
        F.col("url").asc(),
    ).limit(top)
    order = Window.partitionBy("decision").orderBy(
        F.col("score").desc_nulls_last(), F.col("year").asc_nulls_first(), F.col("title").asc_nulls_first(), F.col("url").asc()
    )
    return best.withColumn("number", F.row_number().over(order))


def _part(*values: Column | int) -> Column:
    return F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("int") for v in values])


def _line(text: Column, *part: Column | int) -> Column:
    return F.struct(_part(*part).alias("part"), text.alias("line"))


def _lines(df: DataFrame, lines: list[Column]) -> DataFrame:
    rows = unnest(df, [], F.array(*lines), "x")
    return rows.select("x.part", "x.line").filter(F.col("line").isNotNull())


def _why(part: list) -> list[Column]:
    tags = text_or_null(F.array_join("tags", ", "))
    return [
        _line(F.concat(F.lit("   - Why: "), F.col("reason")), *part, 2),
        _line(F.concat(F.lit("   - Tags: "), tags), *part, 3),
    ]


def watchlist_lines(
    items: DataFrame,
    start_year: int,
    end_year: int,
    top: int,
    as_of: date,
    title: str,
    year_column: str = "year",
) -> DataFrame:
    """Markdown lines of the historical report; sort by ``part``."""
    counts = summary_counts(items)

    def total(label: str, name: str) -> Column:
        return F.concat(F.lit(f"- total {label}: "), F.col(name).cast("string"))

    head = [F.lit(f"# {title}"), F.lit(""), F.lit("## Summary"), F.lit("")]
    head += [total("crawled", "total"), total("watch", "watch"), total("skim", "skim"), total("skipped", "skipped")]
    head += [F.lit(f"- date generated: {as_of.isoformat()}")]
    header = _lines(counts, [_line(text, -1, 0, 0, i) for i, text in enumerate(head)])

    rows = watchlist_top(items, start_year, end_year, top, year_column).filter(F.col("decision").isin(*DECISIONS))
    bucket = decision_rank(F.col("decision"))
    rows = rows.withColumn("_bucket", bucket)
    opens_year = Window.partitionBy("report_year")
    rows = rows.withColumn("_first_bucket", F.min("_bucket").over(opens_year))
    year, number = F.col("report_year"), F.col("number")
    first = number == 1
    opening = first & (F.col("_bucket") == F.col("_first_bucket"))
    part = [year, F.col("_bucket"), number]
    entry = F.concat(
        number.cast("string"), F.lit(". "), F.col("title"), speaker_suffix(), F.lit(" - "), short_number(F.col("score"))
    )
    body = [
        _line(F.when(opening, F.lit("")), year, 0, 0, 0),
        _line(F.when(opening, F.concat(F.lit("## "), year.cast("string"))), year, 0, 0, 1),
        _line(F.when(first, F.lit("")), year, F.col("_bucket"), 0, 0),
        _line(F.when(first, F.concat(F.lit("### "), F.initcap("decision"))), year, F.col("_bucket"), 0, 1),
        _line(F.when(first, F.lit("")), year, F.col("_bucket"), 0, 2),
        _line(entry, *part, 0),
        _line(
            F.concat(F.lit("   - URL: "), urls.display_url(F.col("presentation_url"), F.col("url"))), *part, 1
        ),
        *_why(part),
    ]
    return header.unionByName(_lines(rows, body))


def weekly_lines(items: DataFrame, top: int, as_of: date, title: str) -> DataFrame:
    """Markdown lines of the compact report; sort by ``part``."""
    best = weekly_top(items, top).filter(F.col("decision").isin(*DECISIONS))
    bucket, number = decision_rank(F.col("decision")), F.col("number")
    entry = F.concat(
        number.cast("string"),
        F.lit(". ["),
        F.col("title"),
        F.lit("]("),
        urls.display_url(F.col("presentation_url"), F.col("url")),
        F.lit(") - "),
        short_number(F.col("score")),
    )
    first = number == 1
    body = [
        # A blank line opens each bucket, so none is left at the end.
        _line(F.when(first, F.lit("")), 0, bucket, 0, 0),
        _line(F.when(first, F.concat(F.lit("## "), F.initcap("decision"))), 0, bucket, 0, 1),
        _line(F.when(first, F.lit("")), 0, bucket, 0, 2),
        _line(entry, 0, bucket, number, 0),
        _line(F.concat(F.lit("   - Why: "), F.col("reason")), 0, bucket, number, 1),
    ]
    header = _lines(items.sparkSession.range(1), [_line(F.lit(f"# {title}: {as_of.isoformat()}"), -1, 0, 0, 0)])
    return header.unionByName(_lines(best, body))


def review_lines(items: DataFrame, title: str) -> DataFrame:
    """Heading and checklist lines of all given items, best first.

    The list can be long, so lines keep their item's sort columns and are
    ordered by a distributed sort, not by a running number.
    """
    score = short_number(F.col("score"))
    entry = F.concat(
        F.lit("- [ ] ["),
        F.col("title"),
        F.lit("]("),
        urls.display_url(F.col("presentation_url"), F.col("url")),
        F.lit(")"),
        speaker_suffix(),
        F.lit(" - "),
        score,
        F.lit(" ("),
        F.col("decision"),
        F.lit(")"),
    )
    tags = text_or_null(F.array_join("tags", ", "))
    lines = F.array(
        entry,
        F.concat(F.lit("  - Why: "), F.col("reason")),
        F.concat(F.lit("  - Tags: "), tags),
    )
    rows = items.select(F.lit(1).alias("part"), "score", "year", "title", "url", F.posexplode_outer(lines).alias("line_no", "line"))
    # The wording of the heading. Without items it ends with its last text.
    heading = F.array(F.lit(f"# {title}"), F.lit(""), F.lit("Review queue:"))
    none = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("score", "year", "title", "url")}
    one = items.sparkSession.range(1)
    head = one.select(F.lit(0).alias("part"), *none.values(), F.posexplode(heading).alias("line_no", "line"))
    blank = items.limit(1).select(F.lit(0).alias("part"), *none.values(), F.lit(3).alias("line_no"), F.lit("").alias("line"))
    return head.unionByName(blank).unionByName(rows.filter(F.col("line").isNotNull()))


def review_order() -> list[Column]:
    return [
        F.col("part").asc(),
        F.col("score").desc_nulls_last(),
        F.col("year").desc_nulls_last(),
        F.col("title").asc_nulls_first(),
        F.col("url").asc(),
        F.col("line_no").asc(),
    ]
