import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillrank.llm import catalog, langid, maxent, pii, simhash, suffixes
from quillrank.llm.common import components, id_crc32, running

from .common import ODD, SMALL, documents, rows_of


@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# Helpers


def test_components_follow_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2)]
    found = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}}
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []


def test_running_sums_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, None, 1, 2] * 40], "v long")
    found = running(df, [F.col("v").asc_nulls_last()], F.lit(1), "rank")
    assert sorted(r["rank"] for r in found.collect()) == list(range(200))
    assert [r["v"] for r in found.orderBy("rank").collect()] == [1] * 80 + [2] * 40 + [3] * 40 + [None] * 40
    assert running(df.limit(0), [F.col("v")], F.lit(1)).count() == 0


# Language ID


def test_languages_of_held_out_documents(spark, small):
    found = {r["doc_id"]: r for r in catalog.op9_bitmask_langid(spark, SMALL).collect()}
    assert found.keys() == small.keys()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [i for i, r in found.items() if r["held_out"]]
    assert np.mean([found[i]["lang_pred"] == small[i]["lang"] for i in held]) > 0.95


def plain_grams(text):
    """3- and 4-grams of letters of one text; only their ends may be a word's edge."""
    codes = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    return [tuple(codes[i : i + n]) for n in (3, 4) for i in range(len(codes) - n + 1) if all(codes[i + 1 : i + n - 1])]


def test_languages_against_plain_sets(spark, small):
    """Predictions from sets of each language's n-grams in place of the filters."""
    learned = [r for i, r in small.items() if zlib.crc32(str(i).encode()) % 4 != 2 and r["text"] and r["lang"]]
    counts = {}
    for text, lang in {(r["text"], r["lang"]) for r in learned}:
        counts.setdefault(lang, Counter()).update(plain_grams(text))

    def order(item):
        h = len(item[0])
        for c in item[0]:
            h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 % 2**64
        h ^= h >> 32
        return -item[1], h - 2**64 if h >> 63 else h

    known = {lang: {g for n in (3, 4) for g, _ in sorted(((g, c) for g, c in counted.items() if len(g) == n), key=order)[:4000]} for lang, counted in counts.items()}
    found = {r["doc_id"]: r for r in catalog.op9_bitmask_langid(spark, SMALL).collect()}
    for i, r in small.items():
        grams = plain_grams(r["text"] or "")
        hits = {lang: sum(g in own for g in grams) for lang, own in known.items()}
        if not any(c.isalpha() for c in r["text"] or ""):
            assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0
        elif sum(hits.values()):
            best = max(sorted(hits), key=hits.get)
            assert found[i]["lang_pred"] == best
            assert found[i]["score"] == pytest.approx(hits[best] / sum(hits.values()), abs=0.02)


def test_language_edge_cases(spark):
    docs = documents(spark, ODD)
    model = langid.fit(docs)
    found = langid.predict(docs, model)
    assert found.columns.count("score") == 1
    judged = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in found.collect()}
    assert judged[1, None] == judged[2, ""] == judged[3, " \t\n"] == ("und", 0.0)
    assert judged[5, ODD[4][1]] == judged[None, ODD[3][1]] and judged[5, ODD[4][1]][0] == "en"
    assert judged[8, ODD[8][1]][0] == "pl"
    unknown = documents(spark, [(1, "日本語の文", None, None)])
    assert rows_of(langid.predict(unknown, model), "lang_pred", "score") == [("en", 0.0)]
    assert rows_of(langid.predict(docs, langid.fit(docs.limit(0))), "lang_pred") == [("und",)] * len(ODD)
    assert langid.predict(docs.limit(0), model).count() == 0


def test_more_languages_than_bits_of_a_word(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join([alphabet[i % 26] * 3 + alphabet[i // 26] * 3] * 5), f"l{i:03d}", "a") for i in range(100)]
    docs = documents(spark, rows)
    assert rows_of(langid.predict(docs, langid.fit(docs)).filter("lang <> lang_pred")) == []


def test_long_text_in_slices_counts_every_gram_once():
    letters = langid._letters()
    text = "ab cde fghi " * 60000
    whole = langid._codes(text, letters)
    sliced = Counter()
    for _, _, codes, limit in langid._slices([text], letters):
        for n, (at, _) in zip(langid.ORDERS, langid._grams(codes, limit)):
            sliced[n] += len(at)
    assert sliced == {n: len(at) for n, (at, _) in zip(langid.ORDERS, langid._grams(whole, len(whole)))}


def test_languages_of_few_texts_with_many_copies(spark):
    pool = [("".join(chr(97 + (i * 7 + j * j) % 26) for j in range(30)), f"l{i}") for i in range(6)]
    rows = [(1, text, lang, "a") for text, lang in pool for _ in range(400)]
    rows += [(2, text[::-1], lang, "a") for text, lang in pool]
    model = langid.fit(documents(spark, rows), texts_per_language=20)
    assert (model.fill > 0).all()
    found = langid.predict(documents(spark, [(i, text, None, "a") for i, (text, _) in enumerate(pool)]), model).collect()
    assert all(r["score"] > 0 and r["lang_pred"] == f"l{r['doc_id']}" for r in found)


# SimHash


def brute_fingerprint(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == label:
            break
        label = new
    return [min(ids[j] for j in range(len(fps)) if label[j] == label[i]) for i in range(len(fps))]


def test_fingerprints_and_groups(spark, small):
    found = {r["doc_id"]: r for r in catalog.op5_deletion_variant_simhash(spark, SMALL).collect()}
    ids = sorted(small)
    fps = [brute_fingerprint(small[i]["text"]) for i in ids]
    assert [found[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    assert [found[i]["component_id"] for i in ids] == brute_components(fps, ids)


def test_every_pair_within_two_bits_once(spark):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for _ in range(4):
            g = f
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"))
    pairs = Counter(tuple(sorted(r)) for r in found.collect())
    mask = (1 << 64) - 1
    wanted = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= 2}
    assert set(pairs) == wanted and set(pairs.values()) == {1}


def test_variants_are_not_sent_through_the_driver(spark, tmp_path):
    """A table whose file is small enough to broadcast, its variants are not."""
    rng = random.Random(4)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(500)]
    spark.createDataFrame([(x,) for x in prints + [p ^ 5 for p in prints[:7]]], "fp long").write.parquet(str(tmp_path / "prints"))
    pairs = simhash.linked_pairs(spark.read.parquet(str(tmp_path / "prints")))
    assert pairs.count() == 7
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_edge_cases(spark):
    found = simhash.near_duplicates(documents(spark, ODD))
    by = {(r["doc_id"], r["source"]): (r["fp"], r["component_id"]) for r in found.collect()}
    assert found.count() == len(ODD)
    assert by[1, "a"] == by[2, None] == by[3, "b"] == (0, 1)
    assert by[None, None] == by[5, "a"] and by[5, "a"][1] == 5
    assert simhash.near_duplicates(documents(spark, ODD).limit(0)).count() == 0


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


TRICKY = [
    "a@b.c_d@e.f x@y z@@q.r .@a.b @c.d a.b@c.d.e@f.g.h é@a.de",
    "1.2.3.4.5 300.1.1.1 1.2.3.256 0001.2.3.4 999999.1.1.1.1.1 1..2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 1111 1111",
    "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 ++49 30 1234567) +49.30.1234567.",
    "4111 1111 1111 1111 +1 4111111111111111 10.0.0.1@example.com",
    "1" * 5000 + "." + "2" * 5000 + " " + "a" * 5000,
]


def test_base_spans_match_the_patterns():
    for text in TRICKY:
        assert ",".join(f"{k}:{s}:{e}" for s, k, e in pii.base_spans(text)) == brute_base(text)


def test_personal_data_of_all_documents(spark, small):
    for r in catalog.op1_weak_supervision_pii(spark, SMALL).collect():
        base = brute_base(small[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [base.count(f"{k}:") for k in pii.KINDS]


def test_labelers_agree_on_announced_numbers(spark):
    rows = [(i, f"please call 555-{100 + i:03d}-{4000 + i} or write to joe{i} (at) example (dot) com now", "en", "a") for i in range(60)]
    rows += [(100 + i, f"order no 555-{100 + i:03d}-{4000 + i}.7 and part 1234-{1000 + i}-9999-123 of v{i}", "en", "a") for i in range(60)]
    docs = documents(spark, rows)
    model = pii.fit(docs)
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs, model).collect()}
    assert all(found[i].startswith("phone:12:") and ",email:" in found[i] for i in range(60))
    assert all("phone" not in found[100 + i] for i in range(60))
    assert (model.reliability[pii.KINDS.index("phone"), 1, 3, 2] > model.reliability[pii.KINDS.index("phone"), 0, 3, 2])
    clean = pii.redact(docs, model).filter("doc_id = 0").first()
    assert clean["text"] == "please call [PHONE] or write to [EMAIL] now" and clean["size"] == "x"


def test_personal_data_edge_cases(spark):
    docs = documents(spark, ODD)
    model = pii.fit(docs)
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows_of(pii.find(docs, model), "n_email", "base_sha256", "spans") == [(0, nothing, "")] * len(ODD)
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0
    assert rows_of(pii.redact(docs, model)) == rows_of(docs)


# Language model


def test_base_scores_and_held_out_gain(spark, small):
    found = {r["doc_id"]: r for r in catalog.op6_class_maxent(spark, SMALL).collect()}
    tokens = {i: [*(r["text"] or "").encode().lower().split(), b"\xff"] for i, r in small.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in small}
    counts = Counter(t for i, words in tokens.items() if not held[i] for t in words)
    total, distinct = sum(counts.values()), len(counts)
    for i, r in found.items():
        base = sum(np.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens[i])
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == total and r["held_out"] == held[i]
        assert r["n_tokens"] == len(tokens[i]) and r["n_known"] == sum(counts[t] > 0 for t in tokens[i])
    out = [r for i, r in found.items() if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_small_vocabulary_gives_the_same_base(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", (id_crc32() % 10 == 0).alias("held_out"), "text")
    columns = ("doc_id", "n_known", F.round("base_score", 6))
    assert rows_of(maxent.fit_and_score(docs, 50), *columns) == rows_of(maxent.fit_and_score(docs), *columns)


def fitted(spark, rows, size=maxent.VOCABULARY):
    docs = documents(spark, rows).select("doc_id", (F.col("doc_id") % 10 == 0).alias("held_out"), "text")
    counted = maxent.count_words(docs.filter("not held_out")).cache()
    model = maxent.vocabulary(counted, size)
    numbered = maxent.number(docs, model).cache()
    return docs, maxent.fit(numbered.filter("not held_out"), model), counted, numbered


def sentences(n=300):
    rng = random.Random(11)
    kinds = [[f"{c}{i}" for i in range(12)] for c in "abc"]
    rows = []
    for i in range(n):
        words = rng.choice(kinds)
        text = [rng.choice(words)]
        while rng.random() < 0.95:  # what follows a word depends on it
            text.append(words[(words.index(text[-1]) * 2 + rng.choice([0, 0, 1])) % 12] if rng.random() < 0.8 else rng.choice(words))
            if rng.random() < 0.05:
                text.append(f"rare{rng.randrange(400)}")
                text.append(rng.choice(words))
        rows.append((i, " ".join(text).upper() if i % 3 else " ".join(text), "en", "a"))
    return rows


@pytest.mark.parametrize("size", [maxent.VOCABULARY, 30])
def test_scores_against_brute_force(spark, size):
    """Scores from the class weights by plain loops: softmax of features, pairs and shares inside classes, counts of rare words."""
    rows = sentences()
    docs, model, counted, numbered = fitted(spark, rows, size)
    tokens = {i: [*t.encode().lower().split(), b"\xff"] for i, t, _, _ in rows}
    learned = [w for i, w in tokens.items() if i % 10]
    counts = Counter(t for w in learned for t in w)
    place = {h: i for i, h in enumerate(model.words.tolist())}
    of = {t: place.get(maxent._hash(t)) for w in tokens.values() for t in w}
    assert all(counts[t] == model.counts[i] for t, i in of.items() if i is not None) and (size > 30 or None in of.values())
    klass = {t: int(model.classes[i]) if i is not None else maxent.CLASSES - 1 for t, i in of.items()}
    follow, pairs = Counter(), Counter()
    for w in learned:
        for x, y in zip(w, w[1:]):
            if of[x] is not None and of[x] < maxent.HEAD:
                follow[x, klass[y]] += 1
                pairs[x, y] += of[y] is not None and of[y] < maxent.HEAD
    share = {}
    for c in set(klass.values()):
        own = [t for t in counts if klass[t] == c and of[t] is not None]
        share |= {t: (counts[t] + 0.1) / (sum(counts[u] for u in own) + 0.1 * len(own)) for t in own}
    rare = [t for t in counts if of[t] is None]
    mass = sum(counts[t] for t in rare) + 0.1 * len(rare)

    def inside(x, y):
        if of[y] is None:
            return (1 - model.unseen) * (counts[y] + 0.1) / max(0.1, mass) if counts[y] else model.unseen
        own = [t for t in share if klass[t] == klass[y]]
        with_ = {t: (pairs[x, t] - 0.75) / follow[x, klass[y]] for t in own if x is not None and pairs[x, t] >= 4}
        room = 1 - sum(share[t] for t in with_)
        if with_ and room < 1e-6:
            return with_[y] / sum(with_.values())
        return with_[y] if y in with_ else share[y] * (1 - sum(with_.values())) / room if with_ else share[y]

    found = {r["doc_id"]: r for r in maxent.score(numbered, model, counted).collect()}
    for i, words in list(tokens.items())[:60]:
        numbers = [model.rare + 1] * 3 + [of[t] if of[t] is not None else model.rare for t in words]
        total, known = 0.0, 0.0
        for j, t in enumerate(words):
            one, two, three = (int(model.buckets[numbers[j + 2 - d]]) for d in range(3))
            pair = ((one * maxent.WORD_BUCKETS + two) * 0x9E3779B97F4A7C15 % 2**64 >> 33) % maxent.PAIR_BUCKETS
            w = maxent.WORD_BUCKETS
            z = sum(model.weights[r].astype(float) for r in (0, 1 + one, 1 + w + two, 1 + 2 * w + three, 1 + 3 * w + pair))
            p = np.exp(z[klass[t]]) / np.exp(z).sum() * inside(words[j - 1] if j else None, t)
            total += np.log10(p)
            known += np.log10(p) if counts[t] else 0
        assert found[i]["score"] == pytest.approx(total, rel=1e-4) and found[i]["known_score"] == pytest.approx(known, rel=1e-4)
    out = [r for i, r in found.items() if i % 10 == 0]
    assert sum(r["known_score"] for r in out) > 0.8 * sum(r["known_base"] for r in out)


def test_probabilities_sum_to_one(spark):
    _, model, _, _ = fitted(spark, sentences())
    rare = model.rare
    for last in ([0, 1, 2], [5, 3, rare], [rare + 1] * 3, [1, rare + 1, 0]):
        numbers = np.concatenate([[*last, w] for w in range(rare)])
        at = np.arange(rare) * 4 + 3
        logs = maxent._log_softmax(model.weights, maxent._features(numbers, at, model.buckets))
        words = 10 ** (logs[np.arange(rare), model.classes[:rare]] / np.log(10) + maxent._inside(model, numbers, at))
        empty = [c for c in range(maxent.CLASSES) if c not in set(model.classes[:rare])]  # and the class of rare words
        assert words.sum() + np.exp(logs[0][empty]).sum() == pytest.approx(1, abs=1e-4)


def test_kinds_come_from_all_texts(spark):
    """A kind of texts too rare for any sample still has words of its own."""
    rows = [(i, "the cat and the dog " * 5, "en", "a") for i in range(1, 800)] + [(801 + i, "der hund und die katze " * 5, "de", "b") for i in range(3)]
    _, model, _, numbered = fitted(spark, rows)
    centres = maxent.find_kinds(numbered, model.rare)
    kinds = {i: int(maxent._kind(maxent._profiles(*maxent._laid(pa.array([bytes(r["numbers"])]), model.rare + 1)), centres)[0]) for i, r in
             ((r["doc_id"], r) for r in numbered.filter("doc_id in (1, 2, 801, 802, 803)").collect())}
    assert kinds[1] == kinds[2] != kinds[801] == kinds[802] == kinds[803]


@pytest.mark.parametrize("rounds", [(0.3, 0.15, 0.08), (0.0, 0.0, 0.3), (0.3,)])
def test_every_round_passes_over_all_texts(spark, rounds):
    """Steps by plain loops, over all texts in each round; a round of rate 0 changes nothing."""
    _, model, _, numbered = fitted(spark, sentences(60))
    learned = numbered.filter("not held_out").coalesce(1)
    numbers, at, _ = maxent._laid(learned.toArrow().column("numbers").combine_chunks(), model.rare + 1)
    want = np.zeros((maxent._FEATURES, maxent.CLASSES))
    want[0] = model.prior
    assert len(at) < maxent.STEP  # a step takes all
    for rate in rounds:
        z = want[maxent._features(numbers, at, model.buckets)].sum(axis=0)
        slope = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        slope[np.arange(len(at)), model.classes[numbers[at]]] -= 1
        by_row = {}
        for rows in maxent._features(numbers, at, model.buckets):
            for row, x in zip(rows.tolist(), slope):
                by_row.setdefault(row, []).append(x)
        for row, of in by_row.items():
            g = np.sum(of, axis=0) / np.sqrt(len(of))
            want[row] -= rate * g / np.sqrt(0.1 + (g * g).mean())
    found = maxent.train(learned, model, rounds).weights
    assert np.abs(found - want).max() < 1e-3


def test_language_model_edge_cases(spark):
    docs = documents(spark, ODD).select("doc_id", F.lit(False).alias("held_out"), "text")
    found = maxent.fit_and_score(docs)
    assert found.count() == len(ODD) and rows_of(found.filter("doc_id <= 3"), "n_tokens", "n_known") == [(1, 1)] * 3
    assert rows_of(found.filter("isnan(score) or isnan(base_score) or score is null")) == []
    unseen = maxent.fit_and_score(docs.withColumn("held_out", F.lit(True)))
    assert rows_of(unseen, "train_tokens", "n_known", "base_score") == [(0, 0, 0.0)] * len(ODD)
    assert maxent.fit_and_score(docs.limit(0)).count() == 0


# Repeated passages


def brute_covered(texts, length):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    where = {}
    for i, w in words.items():
        for p in range(len(w) - length + 1):
            where.setdefault(tuple(w[p : p + length]), set()).add(i)
    out = {}
    for i, w in words.items():
        hit = {q for p in range(len(w) - length + 1) if len(where[tuple(w[p : p + length])]) > 1 for q in range(p, p + length)}
        if hit:
            out[i] = hit
    return out


def covered(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["n_words"] >= 50 and r["partner_id"] != r["doc_id"]
    return out


def test_repeated_passages_of_all_documents(spark, small):
    assert covered(catalog.op10_sparse_suffixes(spark, SMALL)) == brute_covered({i: r["text"] for i, r in small.items()}, 50)


def test_planted_passages_of_every_length(spark):
    rng = np.random.default_rng(5)

    def fresh(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))

    texts = {}
    for n in (49, 50, 51, 60, 93, 200):
        passage = fresh(n)
        texts[10 * n] = f"{fresh(7)} {passage} {fresh(30)}"
        texts[10 * n + 1] = f"{fresh(90)} {passage}"
    hot = fresh(70)
    texts |= {10000 + i: f"{fresh(i % 9)} {hot} {fresh(5)}" for i in range(300)}
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts.items()])
    assert covered(suffixes.repeated_spans(docs)) == brute_covered(texts, 50)


def test_suffix_edge_cases(spark):
    docs = documents(spark, ODD)
    assert rows_of(suffixes.repeated_spans(docs)) == []  # repeats within a document, and rows that repeat, are left alone
    twice = documents(spark, [*ODD, (9, "word " * 60, "en", "a"), (None, "word " * 55, "en", "a")])
    assert rows_of(suffixes.repeated_spans(twice), "doc_id", "start_word")[0][1] == 0
    assert suffixes.repeated_spans(docs.limit(0)).count() == 0
