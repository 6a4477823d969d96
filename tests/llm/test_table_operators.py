import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillrank.llm import ann, catalog, mixing, neardup, packing, sharding

from .common import ODD, SMALL, brute_groups, documents, rows_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# Embedding near-duplicates

VECTORS = "vec_id long, label string, embedding array<double>, part int, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], VECTORS)


def brute_links(rows, least):
    good = [(i, label, np.array(v)) for i, label, v in rows if i is not None and label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = defaultdict(set)
    for i, a, x in good:
        for j, b, y in good:
            if i != j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].add(j)
    return links


def brute_root(links, i):
    seen, todo = {i}, [i]
    while todo:
        new = links[todo.pop()] - seen
        seen |= new
        todo += new
    return min(seen)


@pytest.mark.parametrize("dim,tile", [(5, 10_000), (20, 40), (64, 10_000), (64, 40)])
def test_links_of_vectors_against_brute_force(spark, dim, tile):
    rng = np.random.default_rng(dim)
    rows = []
    for g in range(25):
        centre = rng.standard_normal(dim)
        for _ in range(8):
            rows.append((len(rows) * 3, f"l{g % 3}", (centre + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.25, 0.4])).tolist()))
    rows += [(1000 + i, "l0", (np.array(rows[0][2]) * (i + 1)).tolist()) for i in range(30)]
    links = brute_links(rows, 0.93)
    found = {r["vec_id"]: r for r in neardup.near_duplicates(vectors(spark, rows), tile=tile).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == {i: len(links[i]) for i, _, _ in rows}
    assert all(r["component_id"] == brute_root(links, i) and r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_vector_edge_cases(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, "a", one), (2, "a", one), (3, None, one), (4, "b", one), (None, "a", one), (5, "a", None), (6, "a", []),
        (7, "a", [0.0, 0.0, 0.0]), (8, "a", [1.0, None, 0.0]), (9, "a", [float("nan"), 1.0, 0.0]), (10, "a", [1.0, 0.0]),
        (11, "a", [float("inf"), 0.0, 0.0]), (2, "a", one), (12, "a", [1e-200, 0.0, 0.0]), (13, "a", [1e200, 0.0, 0.0]),
        (14, "a", [1e308, 1e308, 0.0]), (15, "a", [5e-324, 5e-324, 0.0]),
    ]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(vectors(spark, rows)).collect()}
    alike = {i: (3, 1, i == 1) for i in (1, 2, 12, 13)} | {14: (1, 14, True), 15: (1, 14, False)}
    assert found == {i: alike.get(i, (0, i, i is not None)) if i is not None else (0, None, False) for i in (None, *range(1, 16))}
    assert neardup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_links_of_ids_on_several_rows(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (2, None, [0.0, 1.0])]
    assert rows_of(neardup.near_duplicates(vectors(spark, rows)), "vec_id", "n_links", "component_id", "kept") == [(1, 1, 1, True), (2, 1, 1, False)]
    # Two different vectors of an id link it with two others; alike vectors of one id are no link.
    rows = [(1, "a", [1.0, 0.0]), (5, "a", [1.0, 0.0]), (5, "a", [0.0, 1.0]), (9, "a", [0.0, 1.0]), (7, "a", [1.0, 1.0]), (7, "a", [1.0, 1.1])]
    rows += [(5, "a", [1.0, 0.0]), (5, "b", [1.0, 0.0]), (8, "b", [1.0, 0.0])]
    found = rows_of(neardup.near_duplicates(vectors(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert found == [(1, 1, 1, True), (5, 3, 1, False), (7, 0, 7, True), (8, 1, 1, False), (9, 1, 1, False)]
    many = [(3, "a", [1.0, i / 1000]) for i in range(300)] + [(4, "a", [1.0, 0.0])]
    assert rows_of(neardup.near_duplicates(vectors(spark, many), tile=50), "vec_id", "n_links") == [(3, 300), (4, 300)]


def test_links_of_vectors_whose_squares_overflow(spark):
    rows = [(1, "a", [1e200, 0.0]), (2, "a", [1e200, 1.0]), (3, "a", [0.0, -1e200])]
    assert rows_of(neardup.near_duplicates(vectors(spark, rows)), "vec_id", "n_links", "component_id") == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


# Nearest neighbours


def brute_nearest(rows, query, k):
    good = {i: np.array(v) for i, v in rows}
    scored = sorted((-float((good[query] * v).sum()), i) for i, v in good.items() if i != query)
    return [i for _, i in scored[:k]]


def test_search_reaches_its_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, "a", v, 0, "c") for i, v in rows], VECTORS)
    found = defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
        found[r["query_id"]].append(r["vec_id"])
    assert len(found) == 150 and {len(v) for v in found.values()} == {20}
    hits = [len(set(v) & set(brute_nearest(rows, q, 20))) / 20 for q, v in found.items()]
    assert np.mean(hits) >= 0.9


def test_search_with_few_rows_ties_and_bad_vectors(spark):
    rows = [(i, "a", [1.0, float(i % 2)]) for i in range(0, 40)]
    rows += [(100, "a", None), (120, "a", []), (140, "a", [0.0, 0.0]), (160, "a", [None, 1.0]), (None, "a", [1.0, 1.0]), (180, "a", [1.0]), (200, None, [1.0, 2.0])]
    found = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0)
    by = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        by[r["query_id"]].append(r["vec_id"])
    usable = [(i, v) for i, _, v in rows if i is not None and i < 40 or i == 200]
    assert dict(by) == {q: brute_nearest(usable, q, 20) for q in (0, 20, 200)}
    few = ann.search(vectors(spark, rows[:5]), F.col("vec_id") % 20 == 0)
    assert rows_of(few, "query_id", "rank", "vec_id") == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]
    assert ann.search(vectors(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_of_ids_on_several_rows(spark):
    # A query that stands twice, and neighbours that stand twice, count once.
    rows = [(i, "a", [1.0, float(i)]) for i in range(1, 31)] + [(40, "a", [1.0, 1.0])] * 2 + [(i, "a", [1.0, float(i)]) for i in range(20, 31)]
    found = ann.search(vectors(spark, rows), F.col("vec_id") == 40)
    assert rows_of(found, "rank", "vec_id", "score") == sorted(((i + 1, 30 - i, 31.0 - i) for i in range(20)), key=repr)
    # Two different vectors of a query or of a neighbour: the nearest two count.
    rows = [(20, "a", [1.0, 0.0]), (20, "a", [0.0, 1.0]), (1, "a", [3.0, 0.0]), (2, "a", [0.0, 5.0]), (3, "a", [1.0, 1.0]), (3, "a", [0.0, 4.0])]
    found = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0)
    assert rows_of(found, "rank", "vec_id", "score") == [(1, 2, 5.0), (2, 3, 4.0), (3, 1, 3.0)]


def test_an_id_on_many_rows_does_not_starve_its_query(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    rows = [(20, "a", (x[0] + 0.01 * rng.standard_normal(16)).tolist()) for _ in range(1500)] + [(1000 + i, "a", v.tolist()) for i, v in enumerate(x)]
    counts = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("m"))
    assert {(r["n"], r["m"]) for r in counts.collect()} == {(20, 20)} and counts.count() == 76


def test_parts_are_balanced_and_copies_do_not_starve_a_query(spark):
    rng = np.random.default_rng(4)
    graph = ann.neighbour_graph(rng.standard_normal((1000, 8)), 10)
    assert set(np.bincount(ann.balanced_parts(graph, 8))) == {125}
    x = np.concatenate([np.tile(rng.standard_normal(16), (700, 1)), rng.standard_normal((700, 16))])
    table = spark.createDataFrame([(i, "a", v.tolist(), 0, "c") for i, v in enumerate(x)], VECTORS)
    counts = ann.search(table, F.col("vec_id") % 20 == 0).groupBy("query_id").count()
    assert counts.count() == 70 and rows_of(counts.select("count").distinct()) == [(20,)]


# Mixing


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % 3]) for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def check_mix(mixed, texts):
    """texts: (source, text) of each document."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in texts]
    per = Counter()
    for (s, _), n in zip(texts, size):
        per[s] += n
    wanted = brute_targets(per)
    taken, most = Counter(), Counter()
    for r in mixed:
        assert r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["copies"] in (int(r["target"] / max(1, r["source_size"])), -int(-r["target"] // max(1, r["source_size"])))
        taken[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert sorted(r["size"] for r in mixed) == sorted(size)
    assert all(abs(taken[s] - wanted[s]) <= most[s] / 2 + 1e-6 for s in per)


def test_mix_of_all_documents_is_near_target_and_repeats(spark, small):
    rows = catalog.op3_pivotal_mixing(spark, SMALL).collect()
    sources = {r["doc_id"]: small[r["doc_id"]]["source"] for r in rows}
    check_mix([{**r.asDict(), "source": sources[r["doc_id"]]} for r in rows], [(r["source"], r["text"]) for r in small.values()])
    spread = mixing.sized(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)).select("doc_id", "source", "size")
    again = mixing.mix(spread, mixing.targets(spread))
    assert rows_of(again, "doc_id", "copies") == sorted(((r["doc_id"], r["copies"]) for r in rows), key=repr)


def test_mix_over_several_levels_keeps_expectations(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), "en", "hot" if i % 3 else f"s{i % 11}") for i in range(600)]
    docs = documents(spark, rows)
    sizes = mixing.sized(docs).select("doc_id", "source", "size")
    check_mix(mixing.mix(sizes, mixing.targets(sizes)).collect(), [(s, t) for _, t, _, s in rows])


def test_mix_edge_cases(spark):
    docs = documents(spark, ODD)
    sizes = mixing.sized(docs).select("doc_id", "source", "size")
    check_mix(mixing.mix(sizes, mixing.targets(sizes)).collect(), [(s, t) for _, t, _, s in ODD])
    empty = documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])
    sizes = mixing.sized(empty).select("doc_id", "source", "size")
    assert rows_of(mixing.mix(sizes, mixing.targets(sizes)), "target", "copies") == [(0.0, 0)] * 2
    sizes = sizes.limit(0)
    assert mixing.mix(sizes, mixing.targets(sizes)).count() == 0


# Sharding


def test_shards_hold_equal_counts_without_gaps(spark, small):
    rows = catalog.op7_hilbert_sharding(spark, SMALL).collect()
    shards = defaultdict(list)
    for r in rows:
        text = (small[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_curve_visits_every_cell_next_to_the_last(spark):
    cells = spark.range(512).selectExpr("id % 8 AS x", "id div 8 % 8 AS y", "id div 64 AS z", "id % 8 AS a", "id div 8 % 8 AS b", "id div 64 AS c")
    order = sharding.with_curve(cells, ["x", "y", "z"], 3).orderBy("curve").collect()
    assert [r["curve"] for r in order] == list(range(512))
    assert all(sum(abs(p[k] - q[k]) for k in "abc") == 1 for p, q in zip(order, order[1:]))


def test_shard_edge_cases(spark):
    found = sharding.shard(documents(spark, ODD))
    assert rows_of(found, "shard", "slot") == [(i, 0) for i in range(9)]
    assert rows_of(found.filter("doc_id = 1"), "size", "text_crc32") == [(1, 0)]
    assert sharding.shard(documents(spark, ODD).limit(0)).count() == 0


def test_mix_of_equal_rows(spark):
    """Rows alike in all that is looked at spread over the buckets, and none is lost."""
    rows = [(None, "one two", "en", "a")] * 9000 + [(7, "x " * 30, "en", "b")] * 3000 + [(i, "y", "en", "c") for i in range(100)] + [(None, None, "en", "a")] * 50
    sizes = mixing.sized(documents(spark, rows).repartition(6)).select("doc_id", "source", "size")
    mixed = mixing.mix(sizes, mixing.targets(sizes)).cache()
    check_mix(mixed.withColumn("taken", F.col("size") * F.col("copies")).collect(), [(r[3], r[1]) for r in rows])
    again = mixing.mix(sizes.repartition(2), mixing.targets(sizes))
    assert Counter(mixed.drop("row").collect()) == Counter(again.drop("row").collect())


# Packing


def check_runs(counts, capacity):
    runs, sequences = packing.plan(counts, capacity)
    bins = defaultdict(list)
    by = defaultdict(list)
    for r in sorted(runs):
        by[r[0]].append(r)
    for length, own in by.items():
        for (_, first, per, sequence, offset), after in zip(own, [*own[1:], (0, counts[length])]):
            for rank in range(first, after[1]):
                bins[sequence + (rank - first) // per].append((offset + (rank - first) % per * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values()) and len(bins) == sequences
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def optimum(lengths, capacity, bound):
    """Fewest bins by search, for a handful of lengths."""
    lengths = sorted(lengths, reverse=True)

    def fits(i, rooms):
        if i == len(lengths):
            return True
        tried = set()
        for b, room in enumerate(rooms):
            if lengths[i] <= room and room not in tried:
                tried.add(room)
                if fits(i + 1, [*rooms[:b], room - lengths[i], *rooms[b + 1 :]]):
                    return True
        return False

    best = bound
    while best > 1 and fits(0, [capacity] * (best - 1)):
        best -= 1
    return best


def test_plans_are_valid_and_dominance_loses_nothing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 12))]
        used = check_runs(dict(Counter(lengths)), capacity)
        reduced = packing._Plan(dict(Counter(lengths)), capacity)
        reduced.reduce()
        rest = [x for x, n in reduced.left.items() for _ in range(n)]
        best = optimum(lengths, capacity, used)
        assert reduced.sequences + (optimum(rest, capacity, len(rest)) if rest else 0) == best
    check_runs({x: rng.randint(1, 50) for x in range(1, 400)}, 2048)


def test_packed_documents_hold_the_tokenizers_ids(spark, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = catalog.op8_dominance_packing(spark, SMALL).collect()
    ids = {i: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for i, r in small.items()}
    sequences, seen = defaultdict(list), Counter()
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and sum(pieces[-1]) <= 2048
    assert len(sequences) <= 1.02 * sum(seen.values()) / 2048 + 1


def test_words_alone_give_the_tokenizers_ids():
    ids = packing._Ids(TOKENIZER)
    texts = [
        "a’s 'S ÀÉ Σας ΟΔΟΣ <|endoftext|>x <|ENDOFTEXT|> it's we'll\n'S x!'s", "x́ ́a \x1c\x85b　c",
        "İI ıŞ ﬁ ½ ¹²³ ª foo_bar a1b2 £€ \U0001f600 가가", "x" * 5000, "ßẞǅ ŉ  y­z",
    ]
    for text in texts:
        got = np.frombuffer(b"".join(map(ids.__getitem__, text.encode().split())), dtype="<u4").tolist()
        assert got == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_edge_cases(spark):
    rows = packing.pack_documents(documents(spark, ODD), TOKENIZER, keep_ids=True).collect()
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == 30001 and all(len(r["ids"]) == r["length"] for r in rows)
    assert Counter(r["doc_id"] for r in rows)[5] == 2
    assert packing.pack_documents(documents(spark, ODD).limit(0), TOKENIZER).count() == 0


def test_pieces_alike_in_id_and_length_keep_their_place(spark):
    rows = [(None, f"w{i} " * 40, "en", "a") for i in range(300)] + [(5, f"v{i} " * 40, "en", "a") for i in range(300)]
    one, two = ({(r["doc_id"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in packing.pack_documents(documents(spark, rows).repartition(n), TOKENIZER).collect()} for n in (2, 7))
    assert one == two and len(one) == 600


# Pipeline


def test_pipeline_stages_keep_what_they_should(spark, small):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "near-duplicates", "personal data", "mixing", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = corpus_pipeline.keep_known_languages(spark, docs, SMALL)
    assert rows_of(known) == rows_of(docs.select(*corpus_pipeline.COLUMNS))
    least = brute_groups((i, r["text"]) for i, r in small.items())
    kept = corpus_pipeline.drop_near_duplicates(spark, known, SMALL)
    assert {r["doc_id"] for r in kept.collect()} == set(least.values()) and kept.count() == len(set(least.values()))
    clean = corpus_pipeline.redact_personal_data(spark, kept, SMALL)
    assert clean.count() == kept.count() and rows_of(clean.filter(F.col("text").rlike(r"@mail[0-9]\.example"))) == []
    mixed = corpus_pipeline.mix_sources(spark, clean, SMALL)
    check = Counter(r["source"] for r in clean.collect())
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert max(taken.values()) <= 3 and {r["source"] for r in mixed.collect()} <= set(check) and mixed.columns == list(corpus_pipeline.COLUMNS)
    packed = corpus_pipeline.pack_sequences(spark, mixed, SMALL).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == taken


def test_pipeline_edge_cases(spark):
    docs = documents(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SMALL).collect()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == {1: 1, 2: 1, 3: 1, None: 1, 5: 2, 6: 1, 7: 1, 8: 1}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert rows_of(kept, "doc_id") == [(1,), (5,), (6,), (7,), (8,)]
    known = corpus_pipeline.keep_known_languages(spark, docs, SMALL)
    assert {r["doc_id"] for r in known.collect()} >= {None, 5, 6, 8} and known.filter("doc_id <= 3").count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_pipeline_drops_near_copies_of_similarity_four_fifths(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 400
    for i in range(12):  # 0 to 3 of 60 words changed, far apart: similarity 1, 51/61, 46/66 and 41/71
        words = [f"w{j}" for j in rng.integers(0, 5000, 60)]
        for k in range(4):
            changed = [f"new{i}" if j in (10, 30, 50)[:k] else w for j, w in enumerate(words)]
            rows.append((4 * i + k, " ".join(changed), "en", "a"))
    base = [f"v{j}" for j in range(60)]  # a group of copies, linked through each other
    for k in range(n):
        changed = [f"x{k}" if j == k % 60 else w for j, w in enumerate(base)]
        rows.append((1000 + k, " ".join(changed), "en", "a"))
    least = brute_groups((i, t) for i, t, _, _ in rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_pipeline_near_copies_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    least = brute_groups((r["doc_id"], r["text"]) for r in docs.collect())
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_pipeline_keeps_both_documents_of_an_id(spark):
    rows = [(9, "one clean text about the sea and its ships", "en", "a"), (9, "another clean text on mountains and their snow", "en", "a")]
    rows += [(i, f"text number {i} has words of its own t{i} u{i} v{i}", "en", "a") for i in (9, 9, 10)]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), SMALL)
    assert rows_of(kept, "doc_id", "text") == sorted({r[:2] for r in rows}, key=repr)
