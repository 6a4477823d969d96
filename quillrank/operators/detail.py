"""Detail pages: embedded JSON first, markup second, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import Site
from quillrank.functions import events, jsonld, times
from quillrank.functions.text import decode_entities, text_or_null, visible_pieces, visible_text, without_hidden

_META = r"(?is)<meta\s[^>]*>"
_META_NAME = r"(?is)\sname\s*=\s*[\"']?description[\"'\s/>]"
_META_CONTENT = r"(?is)\scontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"


def heading(clean: Column) -> Column:
    """Text of the first ``h1`` of markup without hidden parts."""
    inner = F.regexp_extract(clean, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return F.when(clean.rlike(r"(?i)<h1[\s>]"), visible_text(inner))


def meta_description(html: Column) -> Column:
    tag = F.get(
        F.filter(
            F.regexp_extract_all(html, F.lit(_META), F.lit(0)),
            lambda t: F.regexp_like(t, F.lit(_META_NAME)),
        ),
        F.lit(0),
    )
    content = F.concat(F.regexp_extract(tag, _META_CONTENT, 1), F.regexp_extract(tag, _META_CONTENT, 2))
    return F.when(F.regexp_like(tag, F.lit(_META_CONTENT)), decode_entities(content))


def page_titles(pages: DataFrame) -> DataFrame:
    """Heading and description of each page, with the literal title for pages without one."""
    pages = pages.withColumn("_clean", without_hidden(F.col("html")))
    return pages.select(
        "page_id",
        F.coalesce(text_or_null(heading(F.col("_clean"))), F.lit("Untitled")).alias("title"),
        meta_description(F.col("html")).alias("description"),
    )


def detail_items(pages: DataFrame, site: Site) -> DataFrame:
    """One record per detail page."""
    html = F.col("html")
    carry = [c for c in pages.columns if c not in ("url", "html")]
    clean = F.col("_clean")
    df = pages.withColumn("_clean", without_hidden(html)).select(
        *carry,
        "url",
        jsonld.first_document(html).alias("doc"),
        heading(clean).alias("heading"),
        meta_description(html).alias("description"),
        visible_pieces(clean).alias("pieces"),
        html.rlike(r"(?i)<video[\s/>]").alias("has_video_tag"),
        (F.contains(html, F.lit("var slides")) | F.contains(html, F.lit("Download Slides"))).alias("has_slide_mark"),
    )
    df = df.withColumn("text", F.array_join("pieces", " "))
    doc = F.col("doc")
    published = times.iso_date(jsonld.string_field(doc, "$.datePublished"))
    media = text_or_null(F.try_variant_get(doc, "$.contentUrl", "string")).isNotNull()
    flags = {
        "has_video": media | F.col("has_video_tag") | F.contains("text", F.lit("View Presentation")),
        "has_slides": F.col("has_slide_mark") | F.contains("text", F.lit("Slides")),
        "has_transcript": F.exists("pieces", lambda p: F.lower(p) == "transcript"),
    }
    return df.select(
        *carry,
        "url",
        F.col("url").alias("presentation_url"),
        F.coalesce(jsonld.any_field(doc, "$.name"), text_or_null(F.col("heading")), F.lit("Untitled")).alias("title"),
        F.coalesce(text_or_null(jsonld.string_field(doc, "$.description")), F.col("description")).alias("summary"),
        published.alias("published_date"),
        F.year(published).alias("year"),
        jsonld.author_names(doc).alias("speaker"),
        F.lit(site.name).alias("source"),
        events.event_of_url(F.col("url"), site).alias("conference"),
        times.period_minutes(jsonld.string_field(doc, "$.duration")).alias("duration_minutes"),
        *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in flags.items()],
    )
