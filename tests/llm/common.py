"""Small tables for the tests of the operators."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, row string, fp string"


def documents(spark, rows):
    """Documents from (doc_id, text, lang, source), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, 0.5, "x", "y", "z") for r in rows], SCHEMA)


ODD = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n", "de", "b"),
    (None, "the cat sat on the mat", "en", None),
    (5, "the cat sat on the mat", "en", "a"),
    (5, "the cat sat on the mat", "en", "a"),
    (6, "word " * 30000, "en", "c"),
    (7, "x", None, "c"),
    (8, "\u0000 ퟿ \U0001f600 zażółć", "pl", "d"),
]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def brute_groups(texts, least=0.8):
    """The smallest id reachable from each of ``(id, text)`` by five-word shingles of similarity ``least``."""
    words = {i: (t or "").encode().lower().split() for i, t in texts}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}
