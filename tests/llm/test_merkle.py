import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quillrank.llm import merkle
from quillrank.llm.common import id_crc32

from .common import ODD, documents, rows_of

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    doc_id, _, lang, source = row
    return sha(*map(said, (doc_id, source, lang, 7, text)))


def tree(nodes):
    """Root, and for each node the siblings left and right of it on every level."""
    paths, at, members = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(at) > 1:
        above, of = [], []
        for s in range(0, len(at), 16):
            run = at[s : s + 16]
            for j, own in enumerate(members[s : s + 16]):
                for i in own:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha(*run))
            of.append([i for own in members[s : s + 16] for i in own])
        at, members = above, of
    return at[0], paths


def brute_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees.append((own, *tree([leaf_of(r, r[1]) for r in own])))
    root, tops = tree([t[1] for t in trees])
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            h = leaf_of(r, r[1].translate(lower) if tampered else r[1])
            for left, right in path + top:
                h = sha(left, h, right)
            out.append((r[0], leaf_of(r, r[1]), subroot, root, sha(*(a + b for a, b in path + top)), h, h == root))
    return sorted(out, key=repr)


def run(spark, rows):
    return rows_of(merkle.manifest(documents(spark, rows).repartition(5), merkle.tampers(id_crc32())), *COLUMNS)


def test_manifest_against_brute_force(spark):
    rng = random.Random(4)
    # Trees of one to three levels: full runs, last runs of one, one leaf, and a source with most rows.
    sizes = {"hot": 16 * 16 * 2 + 1, "full": 256, "seventeen": 17, "sixteen": 16, "one": 1, "": 2, None: 33, "Zed": 5, "é": 18, "\U0001f600": 3}
    sizes |= {f"s{i}": 1 + i % 3 for i in range(20)}
    rows = [(rng.randrange(10**9), rng.choice(["Some Text", "quiet text", "", None, "Été A"]), "en", s) for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    found = run(spark, rows)
    assert found == brute_manifest(rows)
    assert {r[-1] for r in found} == {True, False}


def test_single_source_and_single_row(spark):
    one = [(10, "Text", "en", "a")]
    assert run(spark, one) == brute_manifest(one)
    assert run(spark, one)[0][1] == run(spark, one)[0][2] == run(spark, one)[0][3]
    few = [(i, f"Text {i}", None, None) for i in range(40)]
    assert run(spark, few) == brute_manifest(few)


def test_repeated_rows_null_ids_and_odd_texts(spark):
    rows = ODD * 5 + [(None, "Text Without Id", None, "a")] * 20 + [(3, "Other", "de", "b"), (3, "another", "de", "b")]
    assert run(spark, rows) == brute_manifest(rows)
    assert merkle.manifest(documents(spark, ODD).limit(0), merkle.tampers(id_crc32())).count() == 0


def test_paths_prove_rows_and_any_change_shows(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(120)]
    whole = merkle.manifest(documents(spark, rows), F.lit(False)).collect()
    assert all(r["verified"] for r in whole) and len({r["root"] for r in whole}) == 1
    for r in whole[:20]:
        h = r["leaf"]
        for step in r["path"]:
            h = sha(step["left"], h, step["right"])
        assert h == r["root"] and sha(*(s["left"] + s["right"] for s in r["path"])) == r["proof_sha256"]
    changed = merkle.manifest(documents(spark, rows), F.lit(True)).collect()
    assert not any(r["verified"] for r in changed)


def test_windows_hold_one_run(spark):
    rows = [(i, "t", "en", "hot") for i in range(1000)]
    found = merkle.numbered(documents(spark, rows).select("doc_id", "source"), "source", [F.col("doc_id")])
    assert rows_of(found, "doc_id", "pos", "n") == sorted(((i, i, 1000) for i in range(1000)), key=repr)
    plan = merkle._with_siblings(found.select(F.col("source").alias("tree"), "pos", "n", F.lit("h").alias("h")))
    assert "windowspecdefinition(tree" in (text := plan._jdf.queryExecution().optimizedPlan().toString()) and ", run" in text
