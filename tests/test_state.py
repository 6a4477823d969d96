import json
import threading
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.config import Site, shipped_settings
from quillrank.operators import merge, transitions
from quillrank.plans import crawl, history
from quillrank.plans import reports as jobs
from quillrank.schema import ITEM, LEDGER, STATE, conform, upgrade_state
from quillrank.sources.state import SnapshotStore, text_rows, typed_rows
from quillrank.streaming.ingest import ingest_pages, merge_pending, page_stream, queue_work
from tests.conftest import values

SITE = Site()
NOW = datetime(2024, 5, 1)
KEYS = ["a", "a/", "b", "c/", "c?x=1"]


def writes(spark, rows):
    base = spark.createDataFrame(rows, "seq int, url string, title string, speaker string, conference_year int, fetched_at timestamp")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in ITEM.fields if f.name not in base.columns}
    return base.withColumns(missing).select("seq", *ITEM.names)


def replay(state, rows):
    """The upsert rules, one write at a time."""
    for _, url, title, speaker, edition, fetched in sorted(rows):
        key = url.split("?")[0].rstrip("/") + "/"
        old = state.get(key)
        state[key] = (
            title, speaker, edition if edition is not None else (old and old[2]), old[3] if old else fetched,
        )
    return state


row = st.tuples(
    st.sampled_from(KEYS).map("https://items.example.org/presentations/{}".format),
    st.sampled_from(["t1", "t2", "t3"]),
    st.sampled_from([None, "s1", "s2"]),
    st.sampled_from([None, 2019, 2020]),
    st.sampled_from([datetime(2024, 1, d) for d in (1, 2, 3)]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=12), st.lists(row, min_size=1, max_size=12))
def test_upsert_equals_row_by_row_replay(spark, first, second):
    first = [(i, *r) for i, r in enumerate(first)]
    second = [(i, *r) for i, r in enumerate(second)]
    state = spark.createDataFrame([], STATE)
    for batch in (first, second):
        state = merge.upsert(state, writes(spark, batch), SITE, ["seq"])
    got = {r[0]: tuple(r[1:]) for r in values(state, "url", "title", "speaker", "conference_year", "fetched_at")}
    assert got == replay(replay({}, first), second)


def test_upsert_keeps_publishing_columns_and_overwrites_with_null(spark):
    url = "https://items.example.org/presentations/a/"
    state = merge.upsert(spark.createDataFrame([], STATE), writes(spark, [(0, url, "t", "s", 2019, NOW)]), SITE, ["seq"])
    event = spark.createDataFrame([(url, 7, "i7", "n7", NOW, 0)], "url string, issue_number long, issue_url string, node_id string, at timestamp, seq int")
    state = transitions.record_issues(state, event)
    state = merge.upsert(state, writes(spark, [(0, url[:-1], "t2", None, None, datetime(2025, 1, 1))]), SITE, ["seq"])
    assert values(state, "title", "speaker", "conference_year", "fetched_at", "issue_number", "github_issue_node_id", "watch_status") == [
        ("t2", None, 2019, NOW, 7, "n7", "queued")
    ]


def test_year_filter_keeps_undated(spark):
    rows = spark.createDataFrame([("a", 2018), ("b", None), ("c", 2021)], "url string, year int")
    assert [r[0] for r in values(merge.inside_years(rows, 2019, 2022), "url")] == ["b", "c"]
    assert merge.inside_years(rows, None, None).count() == 3


def test_overlay_treats_empty_and_zero_as_missing(spark):
    columns = "url string, title string, summary string, published_date date, year int, speaker string, duration_minutes int, conference string, has_video boolean, has_slides boolean, has_transcript boolean"
    listing = spark.createDataFrame([("u", "L", "ls", date(2020, 1, 1), 2020, "lsp", 30, "lc", True, False, False), ("v", "V", None, None, None, None, None, None, False, False, False)], columns)
    detail = spark.createDataFrame([("u", "Untitled", "", None, None, "dsp", 0, "dc", False, True, None)], columns)
    assert sorted(tuple(r) for r in merge.overlay_detail(listing, detail).collect()) == [
        ("u", "L", "ls", date(2020, 1, 1), 2020, "dsp", 30, "dc", True, True, False),
        ("v", "V", None, None, None, None, None, None, False, False, False),
    ]


def test_mark_reported_is_exact_and_moves_only_new(spark):
    state = conform(spark.createDataFrame([("a", "t", "new"), ("a/", "t", "new"), ("b", "t", "watched")], "url string, title string, watch_status string"), STATE)
    events = spark.createDataFrame([("a", 1, "i1", NOW, 0), ("a", 2, "i2", NOW, 1), ("b", 3, "i3", NOW, 0), ("z", 4, "i4", NOW, 0)], "url string, issue_number long, issue_url string, at timestamp, seq int")
    got = sorted(values(transitions.mark_reported(state, events), "url", "issue_number", "issue_url", "watch_status"))
    assert got == [("a", 2, "i2", "queued"), ("a/", None, None, "new"), ("b", 3, "i3", "watched")]


def test_ledger_keeps_first_year_and_name(spark):
    old = spark.createDataFrame([("s", 2016, "n", "failed", 0, "e", NOW), ("k", 2015, "k", "success", 3, None, NOW)], LEDGER)
    new = spark.createDataFrame([("s", 2020, "x", "success", 5, None, NOW, 1), ("new", 2021, "y", "failed", 0, "bad", NOW, 0)], "source_url string, year int, source_name string, status string, row_count long, error string, attempted_at timestamp, seq int")
    got = sorted(values(transitions.upsert_ledger(old, new), "source_url", "year", "source_name", "status", "row_count", "error"))
    assert got == [("k", 2015, "k", "success", 3, None), ("new", 2021, "y", "failed", 0, "bad"), ("s", 2016, "n", "success", 5, None)]


def test_upgrade_backfills_once(spark):
    old = spark.createDataFrame([("a", "t", 5, "i5", None, None), ("b", "t", 6, "i6", 9, "g9")], "url string, title string, issue_number long, issue_url string, github_issue_number long, github_issue_url string")
    once = upgrade_state(old)
    assert once.schema.names == STATE.names
    wanted = [("a", "a", 5, "i5", "new", []), ("b", "b", 9, "g9", "new", [])]
    columns = ("url", "presentation_url", "github_issue_number", "github_issue_url", "watch_status", "tags")
    assert sorted(values(once, *columns)) == wanted
    assert sorted(values(upgrade_state(once), *columns)) == wanted


def test_text_rows_come_back_typed(spark):
    rows = writes(spark, [(0, "https://items.example.org/presentations/a/", "t", None, 2019, NOW)]).drop("seq")
    rows = conform(rows, STATE).withColumns({"topics": F.array(F.lit("x"), F.lit("é\"")), "has_video": F.lit(True), "published_date": F.lit(date(2024, 2, 3))})
    back = typed_rows(text_rows(rows))
    assert back.schema.simpleString() == rows.schema.simpleString()
    columns = [c for c in STATE.names if c != "presentation_url"]
    assert values(back, *columns) == values(rows, *columns)


def test_store_versions_are_idempotent_and_bucketed(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "items"))
    assert store.version() == 0 and store.read().count() == 0
    batch = writes(spark, [(i, f"https://items.example.org/presentations/{i}/", "t", None, None, NOW) for i in range(50)])
    change = lambda state: merge.upsert(state, batch, SITE, ["seq"])
    assert store.update(change, "run-1") == 1
    assert store.update(change, "run-1") == 1
    assert store.update(change, "run-2") == 2
    assert store.read(1).count() == 50 and store.read().count() == 50
    # A merge moves the batch to the snapshot's buckets; the snapshot side stays where it is.
    plan = change(store.read())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # Another session may use other bucket numbers: old versions keep theirs.
    for version in (1, 2):
        spark.sql(f"DROP TABLE {store._table(version, f'run-{version}')}")
    again = SnapshotStore(spark, str(tmp_path / "items"), buckets=3)
    assert again.version() == 2
    assert again.update(change, "run-3") == 3
    assert again.read().count() == 50 and again.read(2).count() == 50
    assert again.update(change, "run-4") == 4 and again.read().count() == 50


def page(title, extra=""):
    return f'<li><a href="/presentations/{title}">Talk {title}</a> on Jan 02, 2020 {extra}</li>'


def test_stream_equals_batch_and_fills_the_outbox(spark, tmp_path):
    settings_ = shipped_settings()
    batches = [
        [(1, "https://items.example.org/l", page("a") + page("b", "30:00 Kubernetes migration incident Kafka streaming"))],
        [(2, "https://items.example.org/l", page("a", "40:00")), (3, "https://items.example.org/m", page("c"))],
    ]
    source = str(tmp_path / "pages")
    schema = "page_id long, url string, html string"
    store = SnapshotStore(spark, str(tmp_path / "items"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = page_stream(spark, source)
        ingest_pages(stream, store, str(tmp_path / "offsets"), settings_, NOW, str(tmp_path / "outbox"))
    assert store.version() == 2
    everything = spark.createDataFrame([r for rows in batches for r in rows], schema)
    batch = merge.upsert(spark.createDataFrame([], STATE), crawl.crawl_items(everything, settings_, NOW), SITE, (), collapsed=True)
    columns = [c for c in STATE.names if c not in ("topics", "tags")]
    assert sorted(values(store.read(), *columns), key=str) == sorted(values(batch, *columns), key=str)
    outbox = spark.read.parquet(str(tmp_path / "outbox"))
    assert values(outbox, "kind", "url") == [("create", "https://items.example.org/presentations/b/")]
    version = crawl.rescore(store, settings_, datetime(2024, 6, 1), "rescore")
    assert version == 3 and store.read().filter("updated_at = timestamp'2024-06-01 00:00:00'").count() == 3


def test_another_checkpoint_loses_nothing_and_a_replay_repeats_nothing(spark, tmp_path):
    settings_, schema = shipped_settings(), "page_id long, url string, html string"
    store = SnapshotStore(spark, str(tmp_path / "items"))
    for name in ("a", "b"):
        rows = [(1, "https://items.example.org/l", page(name))]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        ingest_pages(page_stream(spark, str(tmp_path / name)), store, str(tmp_path / f"offsets-{name}"), settings_, NOW)
    assert store.version() == 2
    assert sorted(values(store.read(), "title")) == [("Talk a",), ("Talk b",)]
    # No new files: nothing is appended and nothing merged.
    assert ingest_pages(page_stream(spark, str(tmp_path / "b")), store, str(tmp_path / "offsets-b"), settings_, NOW) == 2
    # What was merged is not kept; nothing is left to merge.
    assert not [f for f in (tmp_path / "items/pending").rglob("*.parquet")]
    stream = json.loads((tmp_path / "offsets-b/metadata").read_text())["id"]
    assert merge_pending(store, settings_, stream) == 2


def test_several_batches_make_one_version(spark, tmp_path):
    settings_, schema = shipped_settings(), "page_id long, url string, html string"
    for i in range(3):
        rows = [(i, "https://items.example.org/l", page("same", f"{i}0:00 Kubernetes migration incident Kafka streaming") + page(f"p{i}"))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    store, outbox = SnapshotStore(spark, str(tmp_path / "items")), str(tmp_path / "outbox")
    stream = page_stream(spark, str(tmp_path / "pages"), files_per_batch=1)
    assert ingest_pages(stream, store, str(tmp_path / "offsets"), settings_, NOW, outbox) == 1
    assert len(list((tmp_path / "offsets/commits").glob("[0-9]*"))) == 3
    assert not [f for f in (tmp_path / "items/pending").rglob("*.parquet")]
    assert store.read().count() == 4
    for run in ("x", "y", "x"):
        queue_work(store, settings_, outbox, run)
    urls = [r[0] for r in values(spark.read.parquet(outbox), "url")]
    assert len(urls) == len(set(urls)) == 1


def test_first_version_has_a_file_a_bucket(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "items"), buckets=5)
    batch = writes(spark, [(i, f"https://items.example.org/presentations/{i}/", "t", None, None, NOW) for i in range(200)])
    change = lambda state: merge.upsert(state, batch.repartition(7), SITE, ["seq"])
    for version in (1, 2):
        assert store.update(change, f"run-{version}") == version
        files = list((tmp_path / "items").glob(f"v={version}-*/part-*.parquet"))
        assert len(files) == 5


def test_two_writers_of_a_version_and_old_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "items"), keep=2)
    batch = writes(spark, [(0, "https://items.example.org/presentations/1/", "t", None, None, NOW)])
    change = lambda state: merge.upsert(state, batch, SITE, ["seq"])
    assert store.update(change, "one") == 1

    def overtaken(state):
        other = SnapshotStore(spark, store.path)
        assert other.update(change, "other") == 2
        return change(state)

    with pytest.raises(RuntimeError, match="another run made version 2"):
        store.update(overtaken, "late")
    assert store.version() == 2 and store.read().count() == 1
    # The loser left nothing, and comes through when it tries again.
    assert len(list((tmp_path / "items").glob("v=2-*"))) == 1
    assert store.update(change, "late") == 3 and store.read().count() == 1
    clean = SnapshotStore(spark, str(tmp_path / "clean"), keep=2)
    for i in range(4):
        clean.update(change, f"run-{i}")
    assert sorted(p.name[:3] for p in (tmp_path / "clean").glob("v=*")) == ["v=3", "v=4"] and clean.read(3).count() == 1


def test_a_race_leaves_one_winner_and_a_readable_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "items"))
    batch = writes(spark, [(i, f"https://items.example.org/presentations/{i}/", "t", None, None, NOW) for i in range(20)])
    store.update(lambda state: merge.upsert(state, batch, SITE, ["seq"]), "seed")
    ready, outcomes = threading.Barrier(4), {}

    def write(name):
        own = SnapshotStore(spark, store.path)
        claim = own._claim

        def together(version, run_id):  # all have written their files and seen that the number is free
            ready.wait(120)
            return claim(version, run_id)

        own._claim = together
        try:
            outcomes[name] = own.update(lambda state: state.withColumn("title", F.lit(name)), name)
        except RuntimeError as error:
            outcomes[name] = str(error)

    threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [n for n, got in outcomes.items() if got == 2]
    assert len(winners) == 1 and all("another run made version 2" in got for n, got in outcomes.items() if n not in winners)
    assert values(store.read().select("title").distinct(), "title") == [(winners[0],)] and store.read().count() == 20
    assert len(list((tmp_path / "items").glob("v=2-*"))) == 1 and store.version() == 2


def test_a_lost_job_leaves_the_last_good_version(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "items"))
    batch = writes(spark, [(0, "https://items.example.org/presentations/1/", "t", None, None, NOW)])
    change = lambda state: merge.upsert(state, batch, SITE, ["seq"])
    store.update(change, "one")
    monkeypatch.setattr(store, "_claim", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.update(change, "two")
    monkeypatch.undo()
    (tmp_path / "items/versions/7.json").write_text("")  # a writer that died while it claimed
    assert store.version() == 1 and store.read().count() == 1
    assert store.update(change, "two") == 2 and store.read().count() == 1


def test_changes_between_versions_need_no_shuffle(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "items"), buckets=8)
    rows = [(i, f"https://items.example.org/presentations/{i}/", "t", None, None, NOW) for i in range(6)]
    first = writes(spark, rows[:4])
    store.update(lambda state: merge.upsert(state, first, SITE, ["seq"]), "one")
    second = writes(spark, [(1, rows[1][1], "other", None, None, NOW), *rows[4:]])
    store.update(lambda state: merge.upsert(state.filter(~F.col("url").contains("/3/")), second, SITE, ["seq"]), "two")
    found = store.changes(1, columns=["title", "speaker", "tags"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    kinds = {r["url"][-2]: (r["kind"], r["changed"]) for r in found.collect()}
    assert kinds == {"0": ("same", []), "1": ("changed", ["title"]), "2": ("same", []), "3": ("gone", []), "4": ("new", []), "5": ("new", [])}
    one = next(r for r in found.collect() if r["kind"] == "changed")
    assert (one["was"]["title"], one["now"]["title"]) == ("t", "other")
    assert {r["kind"] for r in store.changes(2, 2).collect()} == {"same"}
    assert {r["kind"] for r in store.changes(0, 1).collect()} == {"new"}
    with pytest.raises(ValueError, match="no version 9"):
        store.changes(1, 9)


def test_report_jobs_take_the_latest_year(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "items"))
    rows = writes(spark, [(0, "https://items.example.org/presentations/1/", "One", None, 2020, NOW)]).drop("seq")
    store.commit(rows.withColumns({"year": F.lit(2021), "decision": F.lit("watch"), "score": F.lit(20.0), "reason": F.lit("r")}), "seed")
    settings_ = shipped_settings()
    assert jobs.report_years(store, settings_) == (settings_.start_year, 2021)
    for name, edition in (("all", None), ("edition", 2020), ("none", 2019)):
        jobs.watchlist_report(store, settings_, str(tmp_path / name), 5, date(2025, 1, 1), "T", edition=edition)
    read = {n: next((tmp_path / n).glob("part-*")).read_text().splitlines() for n in ("all", "edition", "none")}
    assert read["all"][0] == f"# T: {settings_.start_year}-2021" and "## 2021" in read["all"]
    assert read["edition"][0] == "# T: 2020-2020" and "## 2020" in read["edition"] and "- total crawled: 0" in read["none"]
    jobs.review_report(store, str(tmp_path / "review"), "Batch")
    assert spark.read.text(str(tmp_path / "review")).count() == 6


def test_history_runs_sources_and_records_outcomes(spark, tmp_path):
    sources = spark.createDataFrame([(2020, 0, "n20", "s20"), (2019, 0, "n19", "s19"), (2019, 1, "nx", "sx"), (2018, 0, "n18", "s18")], "year int, ordinal int, source_name string, source_url string")
    pages = spark.createDataFrame(
        [("s20", 0, "https://items.example.org/l", page("a") + page("b"), None), ("s19", 0, "https://items.example.org/l", page("a"), None),
         ("sx", 0, "https://items.example.org/l", page("z"), None), ("sx", 1, "https://items.example.org/l", None, "404")],
        "source_url string, page_no int, url string, html string, error string",
    )
    items, ledger = SnapshotStore(spark, str(tmp_path / "items")), SnapshotStore(spark, str(tmp_path / "ledger"), LEDGER, "source_url")
    walks = history.read_pages(pages, shipped_settings())._jdf.queryExecution().executedPlan().toString()
    assert walks.count("ArrowEvalPython") == 1
    for run in ("r1", "r1"):
        history.run_sources(items, ledger, sources, pages, shipped_settings(), NOW, run)
    assert sorted(values(items.read(), "url", "conference_year")) == [
        ("https://items.example.org/presentations/a/", 2019), ("https://items.example.org/presentations/b/", 2020),
    ]
    assert sorted(values(ledger.read(), "source_url", "status", "row_count", "error")) == [
        ("s18", "failed", 0, "page not available"), ("s19", "success", 1, None), ("s20", "success", 2, None), ("sx", "failed", 0, "404"),
    ]
