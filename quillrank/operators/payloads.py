"""Work-item payloads, labels and project field values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.config import Site
from quillrank.functions import urls
from quillrank.functions.rows import unnest
from quillrank.functions.text import fold, short_number, strip, text_or_null

# Project fields with their type and options.
FIELD_SPECS = [
    ("Status", "SINGLE_SELECT", ["Backlog", "Queued", "Watching", "Watched", "Skipped", "Rewatch"]),
    ("Year", "NUMBER", []),
    ("Decision", "SINGLE_SELECT", ["watch", "skim", "transcript", "background", "skip"]),
    ("Score", "NUMBER", []),
    ("Speaker", "TEXT", []),
    ("Conference", "TEXT", []),
    ("Presentation URL", "TEXT", []),
]
# Type name of a select field, label colours by prefix.
SELECT_TYPE = "ProjectV2SingleSelectField"
LABEL_COLORS = {"decision/": "0969da", "year/": "6f42c1", "topic/": "1f883d"}
OTHER_LABEL_COLOR = "57606a"


def label_slug(c: Column) -> Column:
    return F.replace(fold(strip(c)), F.lit(" "), F.lit("-"))


def label_set(site: Site) -> Column:
    """Sorted, distinct labels of an item."""
    fixed = F.array(F.lit("video"), F.lit(site.event_key), F.concat(F.lit("decision/"), F.col("decision")))
    year = F.when(
        F.col("year").isNotNull(), F.array(F.concat(F.lit("year/"), F.col("year").cast("string")))
    ).otherwise(F.array().cast("array<string>"))
    topics = F.transform("tags", lambda t: F.concat(F.lit("topic/"), label_slug(t)))
    return F.sort_array(F.array_distinct(F.concat(fixed, year, topics)))


def label_color(label: Column) -> Column:
    color = F.lit(OTHER_LABEL_COLOR)
    for prefix, value in LABEL_COLORS.items():
        color = F.when(label.startswith(prefix), F.lit(value)).otherwise(color)
    return color


def payloads(items: DataFrame, site: Site, *carry) -> DataFrame:
    """``url, title, body, labels``: what a work item says; the url is its idempotency key.

    ``carry`` names further columns to keep. Fixed values: the wording of title and body.
    """
    year = F.coalesce(F.col("year").cast("string"), F.lit("unknown-year"))
    event = F.coalesce(text_or_null(F.col("conference")), F.lit(site.event))

    def known(name: str) -> Column:
        return F.coalesce(text_or_null(F.col(name)), F.lit("Unknown"))

    minutes = F.coalesce(F.nullif(F.col("duration_minutes"), F.lit(0)).cast("string"), F.lit("Unknown"))
    tags = F.coalesce(text_or_null(F.array_join("tags", ", ")), F.lit("none"))
    lines = [
        F.concat(F.lit("- Presentation: "), urls.display_url(F.col("presentation_url"), F.col("url"))),
        F.concat(F.lit("- Speaker: "), known("speaker")),
        F.concat(F.lit("- Company: "), known("company")),
        F.concat(F.lit("- Year: "), year),
        F.concat(F.lit("- Conference: "), event),
        F.concat(F.lit("- Score: "), short_number(F.col("score"))),
        F.concat(F.lit("- Decision: "), F.col("decision")),
        F.concat(F.lit("- Duration: "), minutes, F.lit(" minutes")),
        F.lit(""),
        F.concat(F.lit("Why: "), F.col("reason")),
        F.lit(""),
        F.concat(F.lit("Tags: "), tags),
    ]
    return items.select(
        "url",
        F.concat(F.lit("["), year, F.lit("]["), event, F.lit("] "), F.col("title")).alias("title"),
        F.concat_ws("\n", *lines).alias("body"),
        label_set(site).alias("labels"),
        *carry,
    )


def labels_needed(items: DataFrame, existing: DataFrame, site: Site) -> DataFrame:
    """Labels the items use and the service does not have yet, with their colour."""
    used = unnest(items, [], label_set(site), "label").distinct()
    new = used.join(existing.select("label").distinct(), "label", "left_anti")
    return new.withColumn("color", label_color(F.col("label")))


def field_specs(spark) -> DataFrame:
    rows = [(i, *spec) for i, spec in enumerate(FIELD_SPECS)]
    return spark.createDataFrame(rows, "pos int, name string, data_type string, options array<string>")


def field_map(existing: DataFrame) -> DataFrame:
    """Fields by trimmed name; the first of equal names counts.

    ``existing``: pos, id, name, type, options array<struct<id,name>>.
    """
    return (
        existing.groupBy(strip(F.col("name")).alias("name"))
        .agg(F.min_by(F.struct("id", "type", "options"), F.col("pos")).alias("f"))
        .select("name", "f.id", "f.type", "f.options")
    )


def fields_missing(specs: DataFrame, existing: DataFrame) -> DataFrame:
    return specs.join(field_map(existing), "name", "left_anti").select("name", "data_type", "options", "pos")


def field_rows(items: DataFrame, existing: DataFrame, default_status: str) -> DataFrame:
    """One row per item and settable field: ``url, field_id, name, kind, value, option_id``.

    Missing values, unknown fields and unknown options are left out.
    """
    values = items.select(
        "url",
        F.lit(default_status).alias("Status"),
        F.col("year").cast("string").alias("Year"),
        F.col("decision").alias("Decision"),
        F.col("score").cast("string").alias("Score"),
        F.col("speaker").alias("Speaker"),
        F.col("conference").alias("Conference"),
        urls.display_url(F.col("presentation_url"), F.col("url")).alias("Presentation URL"),
    )
    names = [name for name, _, _ in FIELD_SPECS]
    long = values.unpivot("url", names, "name", "value").filter(F.col("value").isNotNull())
    # One row per known name at most, so this side never grows with the data.
    known = field_map(existing).filter(F.col("name").isin(*names))
    rows = long.join(F.broadcast(known), "name")
    select = F.coalesce(F.col("type") == SELECT_TYPE, F.lit(False))
    value = F.col("value")
    option = F.get(F.filter("options", lambda o: o["name"] == value), F.lit(0))["id"]
    kind = F.when(select, "select").when(F.col("name").isin("Year", "Score"), "number").otherwise("text")
    return rows.select(
        "url",
        F.col("id").alias("field_id"),
        "name",
        kind.alias("kind"),
        "value",
        F.when(select, text_or_null(option)).alias("option_id"),
    ).filter((F.col("kind") != "select") | F.col("option_id").isNotNull())
