"""Queries over rules and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.catalog.views import (
    EDGE_SQL,
    ITEMS_SQL,
    RULES,
    SCORED_SQL,
    SETTINGS,
    fold_sql,
    item_view,
    quote,
    scored_sql,
    scored_view,
    table,
    term_sql,
)
from quillrank.config import Settings, rules_frame, shipped_settings
from quillrank.operators import phrase_index, scoring, substring_index
from quillrank.session import shared_folder

SHIPPED = shipped_settings()
# The same items after one rule was dropped and one added: old tags must stay.
NEXT_SETTINGS = Settings(
    site=SETTINGS.site, rules=RULES[1:3] + RULES[4:], companies=("Acme",), popularity={**SETTINGS.popularity, "enabled": False}
)


def _flat(df):
    return df.select("doc_id", "url", "score", "decision", "reason", F.array_join("tags", "|").alias("tags"))


_FLAT_SQL = "SELECT doc_id, url, score, decision, reason, array_to_string(tags, '|') AS tags FROM"


def score_items(spark, folder):
    return _flat(scored_view(spark, folder))


def score_shipped_rules(spark, folder):
    return _flat(scoring.score_items(item_view(spark, folder), SHIPPED))


def rescore_items(spark, folder):
    first = scored_view(spark, folder)
    return _flat(scoring.score_items(first, NEXT_SETTINGS))


def decision_totals(spark, folder):
    scored = scored_view(spark, folder)
    return scored.groupBy("decision").agg(F.count("*").alias("items"), F.max("score").alias("top_score"))


def phrase_hits(spark, folder):
    """How many documents each phrase is in, audited against the rule table."""
    hits = scoring.phrase_hits(table(spark, folder, "documents"), "doc_id", "text", RULES)
    counts = hits.groupBy("rule", "term").agg(F.count("*").alias("documents"))
    rules = rules_frame(spark, RULES).select(
        F.col("name").alias("rule"), F.col("weight"), F.array_join("tags", "|").alias("tags")
    )
    return counts.join(rules, "rule").select("rule", "weight", "tags", "term", "documents")


def phrase_hits_table(spark, folder):
    """``phrase_hits`` with the rules in a table: terms are joined, none is in the plan."""
    path = shared_folder(spark, "rules")
    rules_frame(spark, RULES).write.parquet(path)
    rules = spark.read.parquet(path)
    hits = phrase_index.phrase_hits(table(spark, folder, "documents"), "doc_id", "text", rules)
    counts = hits.groupBy("rule", "term").agg(F.count("*").alias("documents"))
    named = rules.select(F.col("name").alias("rule"), "weight", F.array_join("tags", "|").alias("tags"))
    return counts.join(named, "rule").select("rule", "weight", "tags", "term", "documents")


def benchmark_phrases(spark, folder):
    """A rule for each benchmark item, its terms three words each: thousands of them, looked up in all documents."""
    items = table(spark, folder, "benchmark").withColumn("words", F.split("text", " "))
    terms = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.array_join(F.slice("words", i, 3), " "))
    rules = items.select(
        F.col("item_id").alias("rule_no"), F.col("item_id").cast("string").alias("name"), F.lit(1.0).alias("weight"), terms.alias("terms")
    )
    hits = phrase_index.phrase_hits(table(spark, folder, "documents"), "doc_id", "text", rules)
    return hits.groupBy("rule").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("term_no").alias("terms"))


def company_matches(spark, folder):
    """Thousands of customers' names as preferred companies, looked for in what the orders say."""
    wanted = table(spark, folder, "customer").filter("c_mktsegment <> 'BUILDING'")
    needles = wanted.select(F.col("c_custkey").alias("needle_no"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.substring("c_name", 10, 9)).alias("needle"))
    sold = F.concat(F.lit("Sold to CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" with "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    orders = table(spark, folder, "orders").select("o_orderkey", sold.alias("company"))
    found = substring_index.substring_matches(orders, "o_orderkey", "company", needles)
    return found.groupBy("needle_no").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last_order"))


def rule_totals(spark, folder):
    return scoring.rule_totals(table(spark, folder, "documents"), "doc_id", "text", RULES)


def _phrase_sql() -> str:
    parts = [
        f"SELECT {quote(r.name)} AS rule, {float(r.weight)}::DOUBLE AS weight, "
        f"{quote('|'.join(r.effective_tags))} AS tags, {quote(t)} AS term, count(*) AS documents "
        f"FROM d WHERE {term_sql('t', t)} HAVING count(*) > 0"
        for r in RULES
        for t in r.terms
    ]
    return f"WITH d AS MATERIALIZED (SELECT {fold_sql('text')} AS t FROM documents) " + " UNION ALL ".join(parts)


def _rule_totals_sql() -> str:
    from quillrank.catalog.views import hits_sql

    hits = ", ".join(f"{hits_sql('t', r)} AS h{i}" for i, r in enumerate(RULES))
    total = "CAST(0 AS DOUBLE)" + "".join(
        f" + CASE WHEN len(h{i}) > 0 THEN {float(r.weight)}::DOUBLE ELSE 0::DOUBLE END" for i, r in enumerate(RULES)
    )
    reasons = ", ".join(
        f"CASE WHEN len(h{i}) > 0 THEN {quote(r.name + ': ')} || array_to_string(h{i}[1:3], ', ') END"
        for i, r in enumerate(RULES)
    )
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {fold_sql('text')} AS t FROM documents),
h AS MATERIALIZED (SELECT doc_id, {hits} FROM d)
SELECT doc_id, {total} AS total, concat_ws('; ', {reasons}) AS reason FROM h"""


_BENCHMARK_SQL = f"""
WITH w AS (SELECT item_id, string_split(text, ' ') AS words FROM benchmark),
t AS (
  SELECT item_id, i AS term_no, {fold_sql("array_to_string(words[i:i + 2], ' ')")} AS term
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i)),
d AS MATERIALIZED (SELECT doc_id, {fold_sql('text')} AS t FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT term, regexp_extract(term, '[\\p{{L}}\\p{{N}}_]+') AS word FROM t),
dw AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM d),
hit AS MATERIALIZED (
  SELECT g.term, d.doc_id FROM grams g JOIN dw USING (word) JOIN d USING (doc_id)
  WHERE contains(d.t, g.term) AND regexp_matches(d.t, '(^|{EDGE_SQL})' || regexp_escape(g.term) || '($|{EDGE_SQL})'))
SELECT CAST(item_id AS VARCHAR) AS rule, count(*) AS hits, count(DISTINCT doc_id) AS documents, count(DISTINCT term_no) AS terms
FROM t JOIN hit USING (term) GROUP BY item_id"""

QUERIES = {
    "score_items": (score_items, f"WITH {SCORED_SQL} {_FLAT_SQL} scored"),
    "score_shipped_rules": (
        score_shipped_rules,
        f"WITH {ITEMS_SQL},{scored_sql(SHIPPED)} {_FLAT_SQL} scored",
    ),
    "rescore_items": (
        rescore_items,
        f"""WITH {SCORED_SQL},
again_in AS (SELECT i.*, s.tags AS old_tags FROM (SELECT * EXCLUDE (old_tags) FROM items) i JOIN scored s USING (doc_id)),
{scored_sql(NEXT_SETTINGS, "again_in", "again").lstrip()} {_FLAT_SQL} again""",
    ),
    "decision_totals": (
        decision_totals,
        f"WITH {SCORED_SQL} SELECT decision, count(*) AS items, max(score) AS top_score FROM scored GROUP BY decision",
    ),
    "phrase_hits": (phrase_hits, _phrase_sql()),
    "rule_totals": (rule_totals, _rule_totals_sql()),
    "phrase_hits_table": (phrase_hits_table, _phrase_sql()),
    "company_matches": (
        company_matches,
        """WITH n AS (
  SELECT c_custkey AS needle_no, lower(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE substr(c_name, 10, 9) END) AS needle FROM customer WHERE c_mktsegment <> 'BUILDING'),
o AS (SELECT o_orderkey, lower('Sold to CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0') || ' with ' || lpad(o_orderkey::VARCHAR, 10, '0')) AS company FROM orders)
SELECT needle_no, count(*) AS orders, max(o_orderkey) AS last_order FROM n JOIN o ON contains(company, needle) GROUP BY needle_no""",
    ),
    "benchmark_phrases": (benchmark_phrases, _BENCHMARK_SQL),
}
