"""Scoring, selection, reports, payloads, sinks and settings."""

from datetime import date

from pyspark.sql import functions as F

from quillrank.config import Rule, Settings, Site, load_settings, settings_from_mapping, shipped_settings
from quillrank.operators import payloads, reports, scoring, selection
from quillrank.schema import STATE, conform
from quillrank.sources import sinks
from tests.conftest import values

SITE = Site()


def state(spark, rows, columns):
    return conform(spark.createDataFrame(rows, columns), STATE)


def test_settings_merge_over_defaults(tmp_path):
    assert load_settings(tmp_path / "none.toml").rules == ()
    path = tmp_path / "s.toml"
    path.write_text('[thresholds]\nwatch = 20\n[metadata_weights]\nsummit_source = 9\n[[signals]]\nname = "r"\nweight = 2\nterms = ["x"]\n')
    got = load_settings(path)
    assert got.thresholds == {"watch": 20, "skim": 10, "transcript": 6, "background": 3}
    assert got.weights["event_source"] == 9 and got.weights["has_video"] == 2
    assert got.rules == (Rule("r", 2.0, ("x",)),) and got.rules[0].effective_tags == ("r",)
    shipped = shipped_settings(Site(event="DevDay"))
    assert len(shipped.rules) == 12 and sum(len(r.terms) for r in shipped.rules) == 108
    assert shipped.rules[0].terms[1] == "DevDay London" and shipped.rules[0].name == "devday"
    assert settings_from_mapping({}).batch_limit == 25


def test_scoring_boundaries_and_wording(spark):
    rules = (Rule("many", 3, ("one", "two", "Three", "four")), Rule("minus", -2, ("bad",), ("Zed", "a")))
    settings = Settings(rules=rules, companies=("Acme",), thresholds={"watch": 12, "skim": 6, "transcript": 3, "background": 1})
    items = state(
        spark,
        [("https://x/1", "four three two one", None, 25, None, None, ["old"], 9, 999),
         ("https://x/2", "nothing", "ACME corp", 71, True, "Summit X", [], 10, 2000),
         ("https://x/3", "bad idea", "", 70, None, None, [], None, None),
         ("https://x/4", "threes onetwo", None, None, None, None, [], 500, None)],
        "url string, title string, company string, duration_minutes int, has_transcript boolean, conference string, tags array<string>, like_count long, view_count long",
    )
    got = {r.url[-1]: r for r in scoring.score_items(items, settings).collect()}
    assert (got["1"].score, got["1"].decision) == (4.0, "transcript")
    assert got["1"].reason == "practical duration; many: one, two, Three" and got["1"].tags == ["many", "old"]
    assert (got["2"].score, got["2"].decision) == (15.0, "watch")
    assert got["2"].reason == "Summit source; has transcript; preferred company; popularity +3"
    assert got["2"].tags == ["company-fit", "summit"]
    assert (got["3"].score, got["3"].reason, got["3"].tags) == (-1.0, "practical duration; minus: bad", ["Zed", "a"])
    assert (got["4"].score, got["4"].reason) == (4.0, "popularity +4")


def test_filters_pass_the_scores_but_not_into_them(spark, tmp_path):
    path = str(tmp_path / "items")
    state(spark, [("u", "t", 2020)], "url string, title string, year int").write.parquet(path)
    scored = scoring.score_items(spark.read.parquet(path), shipped_settings())
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    run = scored.filter("year = 2020 and decision = 'watch'")._jdf.queryExecution()
    plan, logical = run.executedPlan().toString(), run.optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "EqualTo(year,2020)" in plan and "Exchange" not in plan
    assert logical.count("array_intersect") == 1


ROWS = [
    # url, title, presentation_url, published, year, score, decision, issue, gh issue, gh url, project
    ("https://h/p/a", "A", None, date(2024, 3, 1), 2024, 10.0, "watch", None, None, None, None),
    ("https://h/p/a/", "A2", None, date(2024, 3, 1), 2024, 12.0, "skip", None, None, None, None),
    ("https://h/p/b", "B", None, date(2023, 3, 1), 2023, 10.0, "skim", None, None, None, None),
    ("https://h/p/c", "C", None, None, None, 11.0, "watch", None, None, None, None),
    ("https://h/p/d", "D", None, date(2022, 3, 1), 2022, 15.0, "watch", None, None, None, None),
    ("https://h/p/d/", "D", None, date(2022, 3, 1), 2022, 15.0, "skip", 7, None, None, None),
    ("https://h/p/e", "E", "", date(2021, 3, 1), 2021, 9.0, "watch", 8, 8, "g8", None),
    ("https://h/p/f", "F", None, date(2020, 3, 1), 2020, 9.0, "watch", 9, 9, "g9", "item"),
    ("https://h/p/g", "G", None, date(2020, 3, 1), 2020, 10.0, "watch", None, None, None, None),
]
COLUMNS = "url string, title string, presentation_url string, published_date date, year int, score double, decision string, issue_number long, github_issue_number long, github_issue_url string, github_project_item_id string"


def titles(df):
    return [r.title for r in df.collect()]


def test_selection(spark):
    items = state(spark, ROWS, COLUMNS)
    both = ["watch", "skim"]
    assert titles(selection.list_items(items, decisions=both)) == ["C", "G", "F", "E", "D", "B", "A"]
    assert titles(selection.list_items(items, start_year=2023, decisions=[])) == ["B", "A2", "A"]
    assert titles(selection.unreported(items, both, 3)) == ["D", "C", "A"]
    # D is out: a slash variant has an issue. A comes from the eligible variant.
    assert titles(selection.sync_candidates(items, 9, decisions=both)) == ["C", "A", "B", "G"]
    assert titles(selection.sync_candidates(items, 2, latest=True, decisions=both)) == ["A", "B"]
    assert titles(selection.sync_candidates(items, 9)) == ["A2", "C", "B", "G"]
    recent = selection.open_items(items, both, as_of=date(2024, 3, 31), recent_days=30)
    assert titles(recent) == ["A"]
    assert titles(selection.repair_candidates(items, 5, both)) == ["E"]
    batch = selection.backfill_batch(items, 3, both, 2016, 2030)
    assert [(r.kind, r.title) for r in batch.collect()] == [("repair", "E"), ("create", "A"), ("create", "B")]
    assert titles(selection.backfill_batch(items, 1, both)) == ["E"]
    assert selection.latest_year(items).first()[0] == 2024


def test_a_hot_address_is_cut_before_the_shuffle(spark):
    items = state(spark, ROWS, COLUMNS)
    plan = selection.open_items(items, ["watch"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sources(spark):
    sources = selection.historical_sources(selection.year_span(spark, 2019, 2020), SITE)
    first = [r.source_url for r in selection.pending_sources(sources, spark.createDataFrame([], "source_url string, status string"), 6).collect()]
    assert first[0] == "https://items.example.org/summit-san-francisco-2020/" and first[5].endswith("san-francisco-2019/")
    ledger = spark.createDataFrame([(first[0], "success"), (first[1], "failed")], "source_url string, status string")
    assert selection.pending_sources(sources, ledger, 1).first().source_url == first[2]
    assert selection.pending_sources(sources, ledger, 1, retry_failed=True).first().source_url == first[1]


def test_watchlist_text(spark, tmp_path):
    items = state(spark, ROWS, COLUMNS).withColumn("tags", F.when(F.col("title") == "D", F.array(F.lit("x"), F.lit("y"))).otherwise(F.col("tags")))
    lines = reports.watchlist_lines(items.withColumn("speaker", F.lit("S")), 2022, 2024, 1, date(2025, 1, 1), "T")
    sinks.write_report(lines, str(tmp_path / "r"))
    files = [p for p in (tmp_path / "r").iterdir() if p.name.endswith(".txt")]
    assert len(files) == 1
    text = files[0].read_text().split("\n")
    assert text[:9] == ["# T", "", "## Summary", "", "- total crawled: 9", "- total watch: 6", "- total skim: 1", "- total skipped: 2", "- date generated: 2025-01-01"]
    assert text[9:20] == ["", "## 2022", "", "### Watch", "", "1. D - S - 15", "   - URL: https://h/p/d", "   - Why: ", "   - Tags: x, y", "", "### Skip"]


def test_weekly_and_review(spark):
    items = state(spark, ROWS, COLUMNS)
    weekly = reports.weekly_lines(selection.weekly_eligible(items), 3, date(2025, 1, 1), "W")
    assert [r.line for r in weekly.orderBy("part").collect()] == [
        "# W: 2025-01-01", "", "## Watch", "", "1. [D](https://h/p/d) - 15", "   - Why: ", "2. [C](https://h/p/c) - 11", "   - Why: ", "3. [G](https://h/p/g) - 10", "   - Why: ",
    ]
    assert [r.line for r in reports.weekly_lines(items.filter("false"), 3, date(2025, 1, 1), "W").collect()] == ["# W: 2025-01-01"]
    none = reports.review_lines(items.filter("false"), "R").orderBy(*reports.review_order())
    assert [r.line for r in none.collect()] == ["# R", "", "Review queue:"]
    review = reports.review_lines(selection.unreported(items, ["skim"]), "R")
    assert [r.line for r in review.orderBy(*reports.review_order()).collect()] == ["# R", "", "Review queue:", "", "- [ ] [B](https://h/p/b) - 10 (skim)", "  - Why: "]


def test_payload(spark):
    item = state(spark, [("https://h/p/a/", "T", None, 0, 18.5, "watch", "r", ["Big Data", "ß x"], "")], "url string, title string, year int, duration_minutes int, score double, decision string, reason string, tags array<string>, conference string")
    got = payloads.payloads(item, SITE).first()
    assert got.title == "[unknown-year][Summit] T"
    assert got.body.split("\n") == [
        "- Presentation: https://h/p/a/", "- Speaker: Unknown", "- Company: Unknown", "- Year: unknown-year", "- Conference: Summit", "- Score: 18.5",
        "- Decision: watch", "- Duration: Unknown minutes", "", "Why: r", "", "Tags: Big Data, ß x",
    ]
    assert got.labels == ["decision/watch", "summit", "topic/big-data", "topic/ss-x", "video"]
    existing = spark.createDataFrame([("video",), ("summit",)], "label string")
    assert sorted(values(payloads.labels_needed(item, existing, SITE), "label", "color")) == [
        ("decision/watch", "0969da"), ("topic/big-data", "1f883d"), ("topic/ss-x", "1f883d"),
    ]


def test_fields(spark):
    existing = spark.createDataFrame(
        [(0, "f0", "Status ", payloads.SELECT_TYPE, [("o1", "Backlog")]), (1, "f1", "Status", "x", None), (2, "f2", "Score", "ProjectV2Field", None), (3, "f3", "Decision", payloads.SELECT_TYPE, [("o2", "skim")])],
        "pos int, id string, name string, type string, options array<struct<id:string,name:string>>",
    )
    items = state(spark, [("u", "t", 2020, 18.0, "watch")], "url string, title string, year int, score double, decision string")
    got = sorted(values(payloads.field_rows(items, existing, "Backlog"), "field_id", "kind", "value", "option_id"), key=str)
    assert got == [("f0", "select", "Backlog", "o1"), ("f2", "number", "18.0", None)]
    missing = payloads.fields_missing(payloads.field_specs(spark), existing)
    assert {r.name for r in missing.collect()} == {"Year", "Speaker", "Conference", "Presentation URL"}


def test_sinks(spark, tmp_path):
    items = state(spark, ROWS, COLUMNS)
    sinks.export_csv(items, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.count() == 9 and len(back.columns) == 25 and back.filter("tags = '[]'").count() == 9
    sinks.export_csv(items.filter("false"), str(tmp_path / "none"))
    assert [p.read_text().strip() for p in (tmp_path / "none").iterdir() if p.name.endswith(".csv")] == ["url,title"]
    sinks.write_preview(sinks.preview_rows(items, SITE), str(tmp_path / "preview"))
    assert values(spark.read.json(str(tmp_path / "preview/summary")), "mode", "count") == [("dry-run", 9)]
    sinks.write_outbox(items, SITE, str(tmp_path / "out"), "r1")
    sinks.write_outbox(items, SITE, str(tmp_path / "out"), "r1")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    batch = items.limit(2).withColumn("kind", F.lit("repair")).withColumns(
        {"github_issue_number": F.lit(7).cast("bigint"), "github_issue_url": F.lit("i7"), "github_issue_node_id": F.lit("n7")}
    ).unionByName(items.limit(1).withColumn("kind", F.lit("create")))
    sinks.write_outbox(batch, SITE, str(tmp_path / "both"), "r1")
    said = sorted(values(spark.read.parquet(str(tmp_path / "both")), "kind", "issue_number", "issue_url", "node_id", F.isnull("body")))
    assert said == [("create", None, None, None, False)] + [("repair", 7, "i7", "n7", True)] * 2
    sinks.write_backfill_preview(batch, SITE, str(tmp_path / "backfill"), 2016, 2030)
    assert values(spark.read.json(str(tmp_path / "backfill/summary")), "mode", "start_year", "end_year", "count") == [("dry-run", 2016, 2030, 3)]
    assert spark.read.json(str(tmp_path / "backfill/repairs")).columns == ["issue_number", "issue_url", "title", "url"]
    assert spark.read.json(str(tmp_path / "backfill/issues")).count() == 1
    sources = spark.createDataFrame([("s", 2020)], "source_url string, year int")
    sinks.write_source_preview(sources, str(tmp_path / "sources"))
    assert values(spark.read.json(str(tmp_path / "sources/sources")), "source_url", "year") == [("s", 2020)]
    sinks.write_long_report(reports.review_lines(items, "R"), reports.review_order(), str(tmp_path / "long"))
    assert spark.read.text(str(tmp_path / "long")).count() == 22
