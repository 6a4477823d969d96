import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillrank.sources import sinks
from quillrank.streaming import changes
from quillrank.streaming.changes import answered, changed_writes, windowed_counts, work_off, worked_off

START = datetime(2025, 1, 1)
HOUR = timedelta(hours=1)


class Feed:
    """Rows that arrive one file after the other."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.files = spark, str(path), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/{self.files:03d}")
        self.files += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/*")


def test_changes_survive_restarts_late_and_repeated_writes(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "url string, at timestamp, seq long, title string")

    def said():
        stream = changed_writes(feed.stream(), ["title"], timedelta(days=2), 12 * HOUR)
        work_off(stream, str(tmp_path / "out"), str(tmp_path / "offsets"), "update")
        rows = spark.read.parquet(str(tmp_path / "out")).select("url", "kind", "title", "seq").collect()
        return sorted(tuple(r) for r in rows)

    feed.add([("a", START + 5 * HOUR, 1, "one"), ("b", START, 1, None), (None, START, 1, "x"), ("c", None, 1, "x")])
    assert said() == [("a", "new", "one", 1), ("b", "new", None, 1)]
    # A new run with the same checkpoint: a late write, one that comes twice, one that says the same, one that is new.
    feed.add([("a", START + 4 * HOUR, 9, "late"), ("a", START + 5 * HOUR, 1, "one"), ("a", START + 6 * HOUR, 2, "one"), ("b", START + HOUR, 2, "")])
    feed.add([("a", START + 7 * HOUR, 4, "two"), ("a", START + 7 * HOUR, 3, "between"), ("b", START + HOUR, 2, "")])
    after = [("a", "changed", "between", 3), ("a", "changed", "two", 4), ("a", "new", "one", 1), ("b", "changed", "", 2), ("b", "new", None, 1)]
    assert said() == sorted(after, key=lambda r: (r[0], r[1], r[2] or "")) or set(said()) == set(after)
    # Two days without a write: forgotten, once the stream is past that.
    feed.add([("z", START + timedelta(days=5), 1, "z")])
    feed.add([("z", START + timedelta(days=5, hours=1), 2, "z")])
    feed.add([("a", START + timedelta(days=5, hours=2), 5, "two")])
    assert [r for r in said() if r[3] == 5] == [("a", "new", "two", 5)]


def test_many_addresses_share_few_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "GROUPS", 3)
    feed = Feed(spark, tmp_path / "in", "url string, at timestamp, seq long, title string")

    def run():
        work_off(changed_writes(feed.stream(), ["title"], timedelta(days=2), 12 * HOUR), str(tmp_path / "out"), str(tmp_path / "offsets"), "update")
        return {(r["url"], r["kind"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    feed.add([(f"u{i}", START + i * HOUR, i, "one") for i in range(40)])
    assert run() == (seen := {(f"u{i}", "new", i) for i in range(40)})
    feed.add([(f"u{i}", START + timedelta(days=2, hours=10 + i), 100 + i, "one" if i % 2 else "two") for i in range(10, 20)])
    assert run() - seen == (more := {(f"u{i}", "changed", 100 + i) for i in range(10, 20, 2)})
    # Past the time of some addresses of a group: these are new again, others of the group are not.
    feed.add([("z", START + timedelta(days=4, hours=12), 1, "z")])
    feed.add([("z", START + timedelta(days=4, hours=12), 2, "z")])
    feed.add([(f"u{i}", START + timedelta(days=4, hours=13), 300 + i, "two") for i in (5, 10, 11, 19)])
    assert run() - seen - more == {("z", "new", 1), ("u5", "new", 305), ("u11", "changed", 311), ("u19", "changed", 319)}
    states = spark.read.format("statestore").load(str(tmp_path / "offsets"))
    assert states.count() <= 3


OUTBOX = "kind string, _key string, url string, run string, queued_at timestamp"
ANSWERS = "kind string, _key string, run string, ok boolean, answered_at timestamp"


def test_answers_within_their_time(spark, tmp_path):
    asked, answers = Feed(spark, tmp_path / "asked", OUTBOX), Feed(spark, tmp_path / "answers", ANSWERS)
    asked.add([("create", k, k, "r1", START) for k in "abcde"])
    asked.add([("create", "f", "f", "r2", START + timedelta(days=3))])
    answers.add([("create", "a", "r1", True, START + HOUR), ("create", "b", "r1", False, START + HOUR), ("create", "e", "r1", False, START + HOUR),
                 ("create", "e", "r1", True, START + 2 * HOUR), ("repair", "c", "r1", True, START + HOUR)])
    answers.add([("create", "d", "r1", True, START + timedelta(days=2)), ("create", "x", "r2", True, START + timedelta(days=3))])
    out = str(tmp_path / "settled")
    assert worked_off(spark, out, sinks.SETTLED).count() == 0
    work_off(answered(asked.stream(), answers.stream(), timedelta(days=1), HOUR), out, str(tmp_path / "offsets"))
    found = sorted((r["_key"], r["status"]) for r in worked_off(spark, out, sinks.SETTLED).collect())
    assert found == [("a", "done"), ("b", "failed"), ("c", "unanswered"), ("d", "unanswered"), ("e", "done"), ("e", "failed")]


def test_outbox_gives_back_what_failed_and_forgets_finished_runs(spark, tmp_path):
    path = str(tmp_path / "outbox")
    schema = sinks._OUTBOX
    for run, keys in (("r1", "ab"), ("r2", "cd")):
        rows = [("create", k, k, None, None, None, None, None, None, START) for k in keys]
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/run={run}")
    item = lambda run, k, status: ("create", k, k, run, START, status, None)
    settled = spark.createDataFrame([item("r1", "a", "done"), item("r1", "a", "failed"), item("r1", "b", "unanswered"), item("r2", "c", "failed")], sinks.SETTLED)
    status = {r["_key"]: r["status"] for r in sinks.outbox_status(spark, path, settled).collect()}
    assert status == {"a": "acknowledged", "b": "returned", "c": "returned", "d": "waiting"}
    assert {r["_key"] for r in sinks.queued(spark, path, "r3", settled).collect()} == {"a", "d"}
    assert {r["_key"] for r in sinks.queued(spark, path, "r3").collect()} == set("abcd")
    assert sinks.prune_outbox(spark, path, settled) == ["r1"]
    assert {r["_key"] for r in sinks.outbox_status(spark, path, settled).collect()} == {"c", "d"}


@pytest.mark.parametrize("batches", [1, 3])
def test_closed_windows_and_late_rows(spark, tmp_path, batches):
    feed = Feed(spark, tmp_path / "in", "at timestamp, arrived timestamp, type string")
    on_time = [(START + i * HOUR, START + i * HOUR + timedelta(minutes=30), "t") for i in range(72)]
    late = [(START + 2 * HOUR, START + 30 * HOUR, "t"), (None, START, "t"), (START, None, "t")]
    rows = sorted(on_time + late, key=lambda r: r[1] or START)
    for i in range(batches):
        feed.add(rows[i * len(rows) // batches : (i + 1) * len(rows) // batches])
    work_off(windowed_counts(feed.stream(), "type", 24 * HOUR, 2 * HOUR), str(tmp_path / "out"), str(tmp_path / "offsets"))
    found = spark.read.parquet(str(tmp_path / "out"))
    days = sorted((r["from"].day, r["late"], r["rows"]) for r in found.collect())
    assert days == [(1, False, 24), (2, False, 24), (2, True, 1)]  # the third day is open still


def test_a_replayed_batch_replaces_its_own_folder(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "x long")
    feed.add([(1,)])
    for _ in range(2):
        work_off(feed.stream(), str(tmp_path / "out"), str(tmp_path / "offsets"))
    commits = tmp_path / "offsets/commits"
    for file in commits.glob("*0*"):
        file.rename(tmp_path / f"lost-{file.name}")
    work_off(feed.stream(), str(tmp_path / "out"), str(tmp_path / "offsets"), each=lambda rows: rows.withColumn("x", F.col("x") + 1))
    assert [r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    assert json.loads((tmp_path / "offsets/metadata").read_text())["id"]


def test_pages_are_saved_by_their_tasks(spark, tmp_path):
    """A file each, without a folder for every page; rows of one id are one file."""
    from quillrank.sources.pages import read_saved_pages, save_pages, saved_page_id

    texts = ["<p>a</p>", "two\nlines \u017c\U0001f600\r", "", None]
    rows = [(i - 3, texts[i % 4]) for i in range(200)] + [(500, "one"), (500, "two"), (None, "nameless")]
    saved = tmp_path / "saved"
    save_pages(spark.createDataFrame(rows, "page_id long, html string").repartition(5), str(saved), 4)
    assert len(list(saved.iterdir())) <= 4 and len(list(saved.rglob("*.html"))) == 202
    assert not [f for f in saved.rglob("*") if f.name.startswith(".")]
    read = read_saved_pages(spark, str(saved), "https://items.example.org/").select(saved_page_id().alias("page"), "html")
    found = {r["page"]: r["html"] for r in read.collect()}
    assert found.pop(500) in ("one\ntwo\n", "two\none\n") and found.pop(None) == "nameless\n"
    assert found == {i: (t or "") + "\n" for i, t in rows if i is not None and i != 500}
    save_pages(spark.createDataFrame([], "page_id long, html string"), str(tmp_path / "none"))
    assert read_saved_pages(spark, str(tmp_path / "none"), "https://items.example.org/").count() == 0


def test_saved_pages_are_listed_by_few_tasks(spark, tmp_path):
    from quillrank.session import tune
    from quillrank.sources.pages import read_saved_pages

    tune(spark)
    spark.range(150).selectExpr("id AS page_id", "'x' AS html").coalesce(1).write.partitionBy("page_id").text(str(tmp_path / "saved"))
    spark.sparkContext.setJobGroup("listed", "listed")
    pages = read_saved_pages(spark, str(tmp_path / "saved"), "https://items.example.org/")
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listed") for s in tracker.getJobInfo(j).stageIds]
    assert max((tracker.getStageInfo(s).numTasks for s in stages), default=0) <= 64
    assert pages.count() == 150
