"""Record, state and ledger schemas, and the upgrade of older snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One row per item, keyed by url.
ITEM = _struct(
    ("url", T.StringType()),
    ("title", T.StringType()),
    ("presentation_url", T.StringType()),
    ("summary", T.StringType()),
    ("published_date", T.DateType()),
    ("year", T.IntegerType()),
    ("conference_year", T.IntegerType()),
    ("speaker", T.StringType()),
    ("company", T.StringType()),
    ("duration_minutes", T.IntegerType()),
    ("source", T.StringType()),
    ("conference", T.StringType()),
    ("track", T.StringType()),
    ("view_count", T.LongType()),
    ("like_count", T.LongType()),
    ("topics", _TEXTS),
    ("has_video", T.BooleanType()),
    ("has_slides", T.BooleanType()),
    ("has_transcript", T.BooleanType()),
    ("score", T.DoubleType()),
    ("decision", T.StringType()),
    ("reason", T.StringType()),
    ("tags", _TEXTS),
    ("fetched_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)

# What publishing adds to an item; a crawl never touches these.
TRACKING = _struct(
    ("watch_status", T.StringType()),
    ("last_reported_at", T.TimestampType()),
    ("issue_number", T.LongType()),
    ("issue_url", T.StringType()),
    ("github_issue_number", T.LongType()),
    ("github_issue_url", T.StringType()),
    ("github_issue_node_id", T.StringType()),
    ("github_project_item_id", T.StringType()),
    ("last_synced_at", T.TimestampType()),
)

STATE = T.StructType(ITEM.fields + TRACKING.fields)

LEDGER = _struct(
    ("source_url", T.StringType()),
    ("year", T.IntegerType()),
    ("source_name", T.StringType()),
    ("status", T.StringType()),
    ("row_count", T.LongType()),
    ("error", T.StringType()),
    ("attempted_at", T.TimestampType()),
)


def _defaults() -> dict[str, Column]:
    none = F.array().cast(_TEXTS)
    return {
        "topics": none,
        "tags": none,
        "has_video": F.lit(False),
        "has_slides": F.lit(False),
        "has_transcript": F.lit(False),
        "score": F.lit(0.0),
        "decision": F.lit("skip"),
        "reason": F.lit(""),
        "watch_status": F.lit("new"),
    }


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring ``df`` to ``schema``: missing columns appear, defaults fill NULLs."""
    have, defaults = set(df.columns), _defaults()

    def column(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in have else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        return value.alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


def upgrade_state(df: DataFrame) -> DataFrame:
    """Bring an older snapshot to the current state schema.

    Besides adding columns, presentation links fall back to the url, and issue
    ids of the older column pair move to the newer one where that is still empty.
    """
    state = conform(df, STATE)
    moves = F.col("github_issue_number").isNull() & F.col("issue_number").isNotNull()
    return state.withColumns(
        {
            "presentation_url": F.coalesce("presentation_url", "url"),
            "github_issue_url": F.when(moves, F.col("issue_url")).otherwise(F.col("github_issue_url")),
            "github_issue_number": F.when(moves, F.col("issue_number")).otherwise(F.col("github_issue_number")),
        }
    )
