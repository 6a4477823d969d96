import random

from pyspark.sql import functions as F

from quillrank.operators import paging, pieces, reports, substring_index
from quillrank.operators.selection import list_order


def test_substrings_against_brute_force(spark):
    rng = random.Random(3)
    needles = [(i, "".join(rng.choice("abAß ") for _ in range(rng.randrange(0, 6)))) for i in range(60)] + [(60, None), (61, "ab"), (62, "ab")]
    texts = [(i, "".join(rng.choice("abß c") for _ in range(rng.randrange(0, 14)))) for i in range(300)] + [(300, None), (1, "ab"), (1, "ab")]
    df, table = spark.createDataFrame(texts, "key long, name string"), spark.createDataFrame(needles, "needle_no long, needle string")
    fold = lambda s: s.lower().replace("ß", "ss")
    want = sorted((k, n) for k, t in texts if t for n, s in needles if s and fold(s) in fold(t))
    found = substring_index.substring_matches(df, "key", "name", table)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Contains" in plan
    assert substring_index.substring_matches(df, "key", "name", table.limit(0)).count() == 0


def test_numbers_as_needles_meet_only_texts_that_have_them(spark):
    # All trigrams of such needles are in many texts; whole needles are not.
    number = F.lpad(F.col("id").cast("string"), 9, "0")
    needles = spark.range(3000).select(F.col("id").alias("needle_no"), number.alias("needle"))
    texts = spark.range(0, 9000, 3).select(F.col("id").alias("key"), F.concat(F.lit("Sold to #"), number, F.lit(" today")).alias("name"))
    assert sorted(tuple(r) for r in substring_index.substring_matches(texts, "key", "name", needles).collect()) == [(i, i) for i in range(0, 3000, 3)]
    chosen, whole = pieces.sizes(needles.withColumn("length", F.length("needle")), "length")
    assert (chosen, whole) == ([9], True)
    cut = substring_index._grams(texts.select(F.col("key").alias("_text"), F.lower("name").alias("_folded")), chosen)
    left = pieces.possible(cut, needles.select(F.xxhash64("needle").alias("mark")), "mark")
    assert cut.count() == 3000 * 16 and 1000 <= left.count() <= 1100


def test_needles_of_many_lengths_in_long_texts(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abcÄ😀") for _ in range(rng.choice([3, 40, 700])))) for i in range(40)]
    made = [(t[a : a + n]) for _, t in texts for n in (1, 2, 5, 9, 17, 30, 31, 33, 64, 120, 300, 600) for a in [rng.randrange(0, len(t))]]
    needles = [(i, s if i % 3 else s[::-1]) for i, s in enumerate(made)]
    want = sorted((k, n) for k, t in texts for n, s in needles if s and s.lower() in t.lower())
    df, table = spark.createDataFrame(texts, "key long, name string"), spark.createDataFrame(needles, "needle_no long, needle string")
    assert len({len(s) for _, s in needles}) > pieces.SIZES
    assert sorted(tuple(r) for r in substring_index.substring_matches(df, "key", "name", table).collect()) == want


def listing(spark, n):
    rows = spark.range(n).select(
        F.when(F.col("id") % 11 != 0, (F.col("id") % 5 + 2015).cast("int")).alias("year"), F.lit("watch").alias("decision"),
        (F.col("id") % 7).cast("double").alias("score"), F.lit("t").alias("title"), F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("url"),
    )
    return rows.repartition(7)


def test_numbers_follow_the_whole_order(spark):
    items = listing(spark, 2000)
    found = paging.numbered(items, list_order())
    want = [r["url"] for r in items.orderBy(*list_order()).collect()]
    assert [r["url"] for r in found.orderBy("number").collect()] == want
    assert sorted(r["number"] for r in found.collect()) == list(range(1, 2001))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
    got = [r["url"] for r in paging.page(found, 990, 25).collect()]
    assert got == want[990:1015] and paging.page(found, 2000, 25).count() == 0
    assert paging.numbered(items.limit(0), list_order()).count() == 0


def test_sketches_of_runs_merge(spark):
    runs = [spark.range(a, b).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").cast("string").alias("url")) for a, b in ((0, 60_000), (30_000, 90_000))]
    runs.append(spark.createDataFrame([("s9", "one"), ("s9", "one"), (None, "x")], "source string, url string"))
    found = {r["source"]: r for r in reports.merged_distinct(*(reports.distinct_sketches(r) for r in runs)).collect()}
    assert {k: r["runs"] for k, r in found.items()} == {"s0": 2, "s1": 2, "s2": 2, "s9": 1} and found["s9"]["distinct_items"] == 1
    # Sketches of 2^12 registers: a standard error of 1.63 %.
    assert all(abs(found[f"s{i}"]["distinct_items"] - 30_000) < 3 * 0.0163 * 30_000 for i in range(3))
    sizes = reports.distinct_sketches(runs[0]).select(F.length("sketch").alias("n")).collect()
    assert max(r["n"] for r in sizes) < 5000


def test_rollup_tells_totals_from_unknown(spark):
    rows = [(2020, "watch", "a", 3.0), (2020, "skip", None, 1.0), (None, "watch", "a", None)]
    items = spark.createDataFrame(rows, "year int, decision string, source string, score double")
    found = {(r["year"], r["decision"], r["source"], r["grouping_id"]): (r["items"], r["top_score"]) for r in reports.rollup_counts(items).collect()}
    assert found[None, None, None, 7] == (3, 3.0) and found[None, None, None, 6] == (1, 1.0)
    assert found[None, "watch", "a", 0] == (1, None) and found[None, "watch", "a", 4] == (2, 3.0)
    plan = reports.rollup_counts(items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("LogicalRDD") == 1
