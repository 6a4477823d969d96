import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillrank.llm import divergence

from .common import ODD, documents, rows_of

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute_audit(rows, least=10, top=10):
    """The contract, straight from the texts."""
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [(lang or "", source or "", Counter(re.findall(divergence.TERM, (text or "").translate(lower)))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update({t: n for t, n in terms.items() if t in kept})

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in p:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, listed, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                listed = sorted(listed, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(listed, 1)]
    return sorted(out, key=repr)


def sample(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéßж" for b in ("x", "yy", "Zz", "ü", "")] + ["same"]
    marks = ["{}", "{},", "({})", "{}-{}", "'{}'", "{}.", "12", "--", "{}3{}"]
    rows = []
    for i in range(n):
        source = rng.choice(["s0"] * 8 + [f"s{j}" for j in range(12)] + [None, ""])
        own = words if rng.random() < 0.5 else words[: 5 + len(source or "")]
        text = " ".join(rng.choice(marks).replace("{}", rng.choice(own)) for _ in range(rng.randrange(0, 60)))
        rows.append((i if i % 7 else None, text + rng.choice(["", "\x1c", "\n\tsame", " foo"]), rng.choice(["en", "en", "de", None]), source))
    rows += [(900 + i, f"rare{'-' * i} {'only' if i < 9 else 'never'}", "en", "s1") for i in range(12)]
    rows += [(950, "a lone text", "fr", "s0"), (951, None, "fr", "s2"), (952, "12 34", "it", "s0")]
    return rows


def test_audit_against_brute_force(spark, monkeypatch):
    rows = sample()
    assert rows_of(divergence.audit(documents(spark, rows).repartition(5)), *COLUMNS) == brute_audit(rows)
    # Small bounds: tasks hand on often, terms and sources fall in many tiles.
    monkeypatch.setattr(divergence, "BUCKET", 7)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "PORTION", 200)
    monkeypatch.setattr(divergence, "COMBINED", 5)
    found = divergence.audit(documents(spark, rows).repartition(3))
    assert rows_of(found, *COLUMNS) == brute_audit(rows)
    assert found.columns == list(COLUMNS)


def test_documents_of_a_term_count_once_however_it_is_written(spark):
    # Nine documents have the term in two spellings each; the tenth decides.
    rows = [(i, f"word{'.' * i} (word) Word", "en", f"s{i % 2}") for i in range(9)]
    few = divergence.audit(documents(spark, rows)).filter("part = 'term'")
    assert few.count() == 0
    rows.append((9, "other text, word", "en", "s0"))
    pieces = divergence.chunk_counts(documents(spark, rows), 10, 3)
    spread = divergence.factorized(pieces, 10)
    counts = spread.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.max("docs").alias("fewest"), F.sum("docs").alias("most"))
    assert rows_of(divergence.kept_terms(spread, counts, 10)) == [("en", "word")]
    assert rows_of(divergence.audit(documents(spark, rows)), *COLUMNS) == brute_audit(rows)


def test_each_distinct_chunk_is_tokenized_once(spark):
    rows = [(i, "The the, cat\tthe\u00a0cat  x1y ", "en", f"s{i % 3}") for i in range(30)]
    pieces = divergence.chunk_counts(documents(spark, rows).repartition(4), 10, 5)
    assert 1 <= pieces.select("bucket").distinct().count() <= 5
    spread = divergence.factorized(pieces, 10)
    # Rows of a chunk's terms: one for each group, whatever the number of tasks and documents.
    found = Counter((r["source"], r["term"], r["n"], r["docs"], r["ids"]) for r in spread.collect())
    terms = ("the", "the", "cat", "the\u00a0cat", "x", "y")
    assert found == Counter((f"s{i}", t, 10, 10, None) for i in range(3) for t in terms)


def test_audit_edge_cases(spark):
    assert rows_of(divergence.audit(documents(spark, ODD)), *COLUMNS) == brute_audit(ODD)
    many = ODD * 10
    assert rows_of(divergence.audit(documents(spark, many)), *COLUMNS) == brute_audit(many)
    nothing = divergence.audit(documents(spark, ODD).limit(0))
    assert nothing.count() == 0 and nothing.columns == list(COLUMNS)
