"""Item records over the shared test tables, once as DataFrame and once as SQL.

``documents`` with ``labels`` become items: neighbouring documents are slash
variants of one address, some are undated, and publishing state is spread over
them, so every operator has something to do. Texts are taken whole.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.config import Rule, Settings, Site
from quillrank.functions.text import collapse
from quillrank.operators.scoring import score_items
from quillrank.schema import STATE

SITE = Site()
AS_OF = date(2025, 6, 30)
RUN_TS = datetime(2025, 7, 1)
RULES = (
    Rule("licensing", 5, ("License", "licensed", "Apache", "rights reserved", "GNU General Public"), ("legal", "Open Source")),
    Rule("function_words", 2, ("with", "this", "from", "the", "avec")),
    Rule("german", -3, ("und", "der", "für", "eine"), ("German", "legal")),
    Rule("credentials", 4.25, ("token", "password", "secret-key", "api_key"), ("secrets",)),
    Rule("accents", 0.5, ("être", "más", "à la", "nicht"), ("accents",)),
    Rule("phrases", 1.5, ("of the", "in the", "que la", "de la", "www.", "C++"), ()),
)
SETTINGS = Settings(site=SITE, rules=RULES, companies=("Netflix", "Google"), thresholds={"watch": 16, "skim": 11, "transcript": 8, "background": 4})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def when_mod(divisor: int, value: Column, otherwise: Column | None = None, equals: int = 0) -> Column:
    return F.when(F.col("doc_id") % divisor == equals, value).otherwise(otherwise)


def item_view(spark: SparkSession, folder: str) -> DataFrame:
    """Unscored items with publishing state, keyed by ``doc_id`` for ordering."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    text = i.cast("string")
    half = F.floor(i / 2).cast("string")
    first_line = collapse(F.substring_index("text", "\n", 1))
    day = F.date_add(F.lit(date(2016, 1, 1)), (i * 37 % 3650).cast("int"))
    docs = docs.withColumn("published_date", F.when(i % 11 != 0, day)).withColumn(
        "url", F.concat(F.lit("https://items.example.org/presentations/d"), half, when_mod(2, F.lit("/"), F.lit("")))
    )
    year = F.year("published_date")
    columns = {
        "url": F.col("url"),
        "title": F.coalesce(F.nullif(first_line, F.lit("")), F.concat(F.lit("Item "), text)),
        "presentation_url": when_mod(9, F.lit(None), F.col("url")).cast("string"),
        "summary": F.when(i % 13 != 0, collapse(F.col("text"))),
        "published_date": F.col("published_date"),
        "year": year,
        "conference_year": F.when(i % 5 != 0, year - (i % 3)).cast("int"),
        "speaker": F.when(i % 4 == 1, F.lit("")).when(i % 4 != 0, F.concat(F.lit("Speaker "), (i % 50).cast("string"))),
        "company": F.when(i % 9 == 0, F.lit("Netflix Inc"))
        .when(i % 9 == 1, F.lit("GOOGLE Cloud"))
        .when(i % 9 == 2, F.lit("Acme"))
        .when(i % 9 == 3, F.lit("")),
        "duration_minutes": F.floor(F.col("n_chars") / 60).cast("int"),
        "source": F.col("source"),
        "conference": F.when(i % 6 == 0, F.lit("Summit London 2019")).when(i % 6 == 1, F.lit("")),
        "track": F.when(i % 5 == 0, F.lit("DevOps")).when(i % 5 == 1, F.lit("Culture & Methods")),
        "view_count": F.col("n_chars"),
        "like_count": F.when(i % 10 != 3, i % 97),
        "topics": F.array("lang"),
        "has_video": F.coalesce(F.col("quality") == 1, F.lit(False)),
        "has_slides": F.coalesce(F.col("toxic") == 1, F.lit(False)),
        "has_transcript": F.col("n_chars") > 2000,
        "score": F.lit(0.0),
        "decision": F.lit("skip"),
        "reason": F.lit(""),
        "tags": when_mod(8, F.array(F.lit("kept"), F.lit("legal")), F.array()).cast("array<string>"),
        "fetched_at": F.lit(datetime(2024, 1, 1)).cast("timestamp"),
        "updated_at": F.lit(datetime(2024, 1, 2)).cast("timestamp"),
        "watch_status": when_mod(3, F.lit("watching"), F.lit("new")),
        "last_reported_at": F.lit(None).cast("timestamp"),
        "issue_number": when_mod(7, i, F.lit(None)).cast("bigint"),
        "issue_url": when_mod(7, F.concat(F.lit("https://tracker.example.org/"), text), F.lit(None)).cast("string"),
        "github_issue_number": when_mod(14, i, F.lit(None)).cast("bigint"),
        "github_issue_url": F.when((i % 14 == 0) & (i % 5 != 0), F.concat(F.lit("https://tracker.example.org/"), text)),
        "github_issue_node_id": when_mod(14, F.concat(F.lit("N"), text), F.lit(None)).cast("string"),
        "github_project_item_id": when_mod(42, F.concat(F.lit("P"), text), F.lit(None)).cast("string"),
        "last_synced_at": F.lit(None).cast("timestamp"),
    }
    return docs.select("doc_id", "lang", *[columns[name].alias(name) for name in STATE.names])


def scored_view(spark: SparkSession, folder: str) -> DataFrame:
    """The item view with scores."""
    return score_items(item_view(spark, folder), SETTINGS)


SPACE_SQL = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
EDGE_SQL = r"[^\p{L}\p{N}_]"


def collapse_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACE_SQL}', ' ', 'g'))"


def fold_sql(expr: str) -> str:
    return f"replace(lower({expr}), 'ß', 'ss')"


ITEMS_SQL = f"""
doc AS (
  SELECT d.*, l.quality, l.toxic,
         CASE WHEN d.doc_id % 11 <> 0 THEN DATE '2016-01-01' + CAST(d.doc_id * 37 % 3650 AS INTEGER) END AS published_date,
         'https://items.example.org/presentations/d' || (d.doc_id // 2) || CASE WHEN d.doc_id % 2 = 0 THEN '/' ELSE '' END AS url
  FROM documents d LEFT JOIN labels l USING (doc_id)
),
items AS (
  SELECT doc_id, lang, url,
    coalesce(nullif({collapse_sql("split_part(text, chr(10), 1)")}, ''), 'Item ' || doc_id) AS title,
    CASE WHEN doc_id % 9 <> 0 THEN url END AS presentation_url,
    CASE WHEN doc_id % 13 <> 0 THEN {collapse_sql("text")} END AS summary,
    published_date,
    CAST(year(published_date) AS INTEGER) AS year,
    CAST(CASE WHEN doc_id % 5 <> 0 THEN year(published_date) - doc_id % 3 END AS INTEGER) AS conference_year,
    CASE WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 <> 0 THEN 'Speaker ' || (doc_id % 50) END AS speaker,
    CASE doc_id % 9 WHEN 0 THEN 'Netflix Inc' WHEN 1 THEN 'GOOGLE Cloud' WHEN 2 THEN 'Acme' WHEN 3 THEN '' END AS company,
    CAST(n_chars // 60 AS INTEGER) AS duration_minutes,
    source,
    CASE doc_id % 6 WHEN 0 THEN 'Summit London 2019' WHEN 1 THEN '' END AS conference,
    CASE doc_id % 5 WHEN 0 THEN 'DevOps' WHEN 1 THEN 'Culture & Methods' END AS track,
    n_chars AS view_count,
    CASE WHEN doc_id % 10 <> 3 THEN doc_id % 97 END AS like_count,
    [lang] AS topics,
    coalesce(quality = 1, false) AS has_video,
    coalesce(toxic = 1, false) AS has_slides,
    n_chars > 2000 AS has_transcript,
    CASE WHEN doc_id % 8 = 0 THEN ['kept', 'legal'] ELSE [] END AS old_tags,
    CASE WHEN doc_id % 3 = 0 THEN 'watching' ELSE 'new' END AS watch_status,
    CASE WHEN doc_id % 7 = 0 THEN doc_id END AS issue_number,
    CASE WHEN doc_id % 7 = 0 THEN 'https://tracker.example.org/' || doc_id END AS issue_url,
    CASE WHEN doc_id % 14 = 0 THEN doc_id END AS github_issue_number,
    CASE WHEN doc_id % 14 = 0 AND doc_id % 5 <> 0 THEN 'https://tracker.example.org/' || doc_id END AS github_issue_url,
    CASE WHEN doc_id % 14 = 0 THEN 'N' || doc_id END AS github_issue_node_id,
    CASE WHEN doc_id % 42 = 0 THEN 'P' || doc_id END AS github_project_item_id
  FROM doc
)"""


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def term_sql(text: str, term: str) -> str:
    folded = term.lower().replace("ß", "ss")
    pattern = rf"(^|{EDGE_SQL})\Q{folded}\E($|{EDGE_SQL})"
    return f"(contains({text}, {quote(folded)}) AND regexp_matches({text}, {quote(pattern)}))"


def hits_sql(text: str, rule: Rule) -> str:
    cases = ", ".join(f"CASE WHEN {term_sql(text, t)} THEN {quote(t)} END" for t in rule.terms)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def scored_sql(settings: Settings = SETTINGS, source: str = "items", name: str = "scored") -> str:
    """CTEs that score ``source``; arrays stay lists."""
    w, site = {**settings.weights}, settings.site

    def low(*parts: str) -> str:
        return fold_sql(" || ' ' || ".join(f"coalesce({p}, '')" for p in parts))

    def any_of(text: str, needles) -> str:
        return "(" + " OR ".join(f"contains({text}, {quote(n.lower())})" for n in needles) + ")" if needles else "false"

    topics = "array_to_string(topics, ' ')"
    text = low("title", "summary", "speaker", "company", "source", "conference", "track", topics)
    metas = [
        (any_of(low("source", "conference", "url"), [site.event_key]), w["event_source"], f"{site.event} source", [site.event_key]),
        (any_of(low("track", topics), settings.relevant_tracks), w["relevant_track"], "relevant track/topic metadata", ["relevant-track"]),
        ("has_transcript", w["has_transcript"], "has transcript", []),
        ("has_video", w["has_video"], "has video", []),
        ("has_slides", w["has_slides"], "has slides", []),
        ("coalesce(duration_minutes BETWEEN 25 AND 70, false)", w["practical_duration"], "practical duration", []),
        (
            f"(coalesce(company, '') <> '' AND {any_of(low('company'), settings.companies)})",
            w["company_fit"], "preferred company", ["company-fit"],
        ),
    ]
    p = settings.popularity
    bonus = (
        f"least({p['max_bonus']}, coalesce(like_count // {p['like_step']}, 0) + coalesce(view_count // {p['view_step']}, 0))"
        if p["enabled"] else "0"
    )
    hit_columns = ", ".join(f"{hits_sql('txt', r)} AS h{i}" for i, r in enumerate(settings.rules))
    meta_columns = ", ".join(f"{cond} AS m{i}" for i, (cond, *_ ) in enumerate(metas))
    total = "CAST(0 AS DOUBLE)"
    for i, (_, weight, _, _) in enumerate(metas):
        total += f" + CASE WHEN m{i} THEN {float(weight)}::DOUBLE ELSE 0::DOUBLE END"
    total = f"({total} + bonus::DOUBLE)"
    for i, r in enumerate(settings.rules):
        total += f" + CASE WHEN len(h{i}) > 0 THEN {float(r.weight)}::DOUBLE ELSE 0::DOUBLE END"
    reasons = [f"CASE WHEN m{i} THEN {quote(reason)} END" for i, (_, _, reason, _) in enumerate(metas)]
    reasons.append("CASE WHEN bonus <> 0 THEN 'popularity +' || bonus END")
    reasons += [
        f"CASE WHEN len(h{i}) > 0 THEN {quote(r.name + ': ')} || array_to_string(h{i}[1:3], ', ') END"
        for i, r in enumerate(settings.rules)
    ]

    def taglist(tags) -> str:
        return "[" + ", ".join(map(quote, tags)) + "]"

    tags = ["old_tags"]
    tags += [f"CASE WHEN m{i} THEN {taglist(t)} ELSE [] END" for i, (_, _, _, t) in enumerate(metas) if t]
    tags += [f"CASE WHEN len(h{i}) > 0 THEN {taglist(r.effective_tags)} ELSE [] END" for i, r in enumerate(settings.rules)]
    all_tags = tags[0]
    for t in tags[1:]:
        all_tags = f"list_concat({all_tags}, {t})"
    th = settings.thresholds
    cases = " ".join(f"WHEN score >= {th[d]} THEN '{d}'" for d in ("watch", "skim", "transcript", "background"))
    return f"""
{name}_text AS MATERIALIZED (SELECT *, {text} AS txt, CAST({bonus} AS BIGINT) AS bonus FROM {source}),
{name}_hits AS MATERIALIZED (SELECT *, {hit_columns}, {meta_columns} FROM {name}_text),
{name}_sum AS (
  SELECT *, {total} AS score,
    coalesce(nullif(concat_ws('; ', {', '.join(reasons)}), ''), 'No strong configured signals matched') AS reason,
    list_sort(list_distinct({all_tags})) AS tags
  FROM {name}_hits
),
{name} AS MATERIALIZED (SELECT *, CASE {cases} ELSE 'skip' END AS decision FROM {name}_sum)"""


SCORED_SQL = f"{ITEMS_SQL},{scored_sql()}"
