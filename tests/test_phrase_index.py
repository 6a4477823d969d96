import random
import re

from pyspark.sql import functions as F

from quillrank.config import Rule, rules_frame
from quillrank.functions.text import fold_text
from quillrank.operators import phrase_index, pieces, scoring

ODD = ("C++", ".net", "++", "--", "a.b", "of the", "x", "à la", "straße", "C#/.net", "(x)", "end.", " lead", "und so weiter", "a  b", "_id", "!")


def brute(texts, rules):
    """Terms as whole phrases, by pattern."""
    found = set()
    for key, text in texts:
        for rule in rules:
            for no, term in enumerate(rule.terms):
                pattern = rf"(?<!\w){re.escape(fold_text(term))}(?!\w)"
                if text is not None and term and re.search(pattern, fold_text(text)):
                    found.add((key, rule.name, no, term))
    return found


def table_hits(spark, texts, rules):
    df = spark.createDataFrame(texts, "key long, body string")
    rows = phrase_index.phrase_hits(df, "key", "body", rules_frame(spark, rules)).collect()
    assert len(rows) == len({(r["key"], r["rule"], r["term_no"]) for r in rows})
    return {(r["key"], r["rule"], r["term_no"], r["term"]) for r in rows}


def test_odd_terms_and_edges(spark):
    rules = [Rule("odd", 1, ODD), Rule("empty", 1, ("",)), Rule("none", 1, ()), Rule("again", 2, ("C++", "of the", "of the"))]
    pieces = [*ODD, "word", "C+", "+", ".", "c++x", "9c++", "of", "the", "a.bc", "--- x", "(x", "STRASSE", "net", "\n", "!?!", "weiter"]
    rng = random.Random(5)
    texts = [(i, rng.choice(["", " ", "("]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 7)))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "C++"), (1003, "++"), (1004, "of the")]
    assert table_hits(spark, texts, rules) == brute(texts, rules)


def test_equal_to_rules_in_the_plan(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rules = [Rule(f"r{i}", i, tuple(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(3))) for i in range(8)]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", ";"]) for _ in range(12))) for i in range(200)]
    df = spark.createDataFrame(texts, "key long, body string")
    planned = {(r["key"], r["rule"], r["term"]) for r in scoring.phrase_hits(df, "key", "body", rules).collect()}
    assert {(k, r, t) for k, r, _, t in table_hits(spark, texts, rules)} == planned


def test_equal_texts_and_repeated_keys(spark):
    rules = [Rule("a", 1, ("one two",))]
    texts = [(1, "one two"), (1, "one two"), (2, "one two"), (3, "two one")]
    df = spark.createDataFrame(texts, "key long, body string")
    found = phrase_index.phrase_hits(df, "key", "body", rules_frame(spark, rules)).collect()
    assert sorted(r["key"] for r in found) == [1, 1, 2]


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([(i, f"w{i} w{i + 1} x") for i in range(300)], "key long, body string")

    def plan_and_rows(n):
        rules = spark.range(n).select(
            F.col("id").cast("int").alias("rule_no"), F.concat(F.lit("r"), "id").alias("name"), F.lit(1.0).alias("weight"),
            F.array(F.concat(F.lit("w"), "id", F.lit(" w"), F.col("id") + 1)).alias("terms"),
        )
        hits = phrase_index.phrase_hits(df, "key", "body", rules)
        return hits._jdf.queryExecution().optimizedPlan().treeString().count("\n"), hits.count()

    (few, one), (many, all_) = plan_and_rows(10), plan_and_rows(20_000)
    assert few == many and (one, all_) == (10, 300)
    plan = phrase_index.phrase_hits(df, "key", "body", rules_frame(spark, [Rule("a", 1, ("w1 w2",))]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_terms_of_many_lengths(spark):
    rng = random.Random(7)
    words = ["a", "b", "c++", "(d)", "e"]
    texts = [(i, rng.choice(["", "- "]) + " ".join(rng.choice(words) for _ in range(40)) + rng.choice(["", " !"])) for i in range(60)]
    cut = lambda t, n: " ".join(t.split(" ")[5 : 5 + n])
    rules = [Rule(f"r{n}", 1, tuple(cut(t, n) for _, t in texts[:6]) + (cut(texts[0][1], n)[:-1], f"{cut(texts[1][1], n)} !")) for n in range(1, 20)]
    assert table_hits(spark, texts, rules) == brute(texts, rules)


def test_phrases_of_frequent_words_meet_only_texts_that_have_them(spark):
    # Every word is in every text, hardly any phrase is.
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.sample(words, 30))) for i in range(300)]
    rules = [Rule("r", 1, tuple(" ".join(rng.sample(words, 3)) for _ in range(400)))]
    want = brute(texts, rules)
    assert table_hits(spark, texts, rules) == want
    df = spark.createDataFrame(texts, "_text long, body string").select("_text", phrase_index.runs(F.col("body")).alias("runs"))
    terms = phrase_index.term_table(rules_frame(spark, rules)).select("parts", F.array_join("parts", "").alias("folded"), F.lit(3).alias("words"))
    cut = phrase_index._text_pieces(df, [3])
    left = pieces.possible(cut, phrase_index._term_pieces(terms, [3]).select("mark"), "mark")
    assert cut.count() == 300 * 28 and left.count() <= len({(k, t) for k, _, _, t in want}) + 10
