"""Scoring texts with a hashed maximum-entropy model with class-factored softmax.

A token's probability is that of its class given the words before it, times its
probability within the class given the word before it. The class softmax sums weights
of hashed features: the last word, the last two (n-grams), the second and the third
last (skips); its weights come from gradient updates. Inside a class, a word has its
share of the class and a weight for each frequent pair with the word before; these
weights are where the gradient of the discounted counts is zero, which can be said in
closed form, and the softmax over the class is exact. Classes are kinds of texts in
which a word is at home (k-means over the commonest words) times bands of frequency;
words too rare for the vocabulary share one more class, with a Good-Turing share for
words never seen.

Words are counted and then numbered once; training and scoring read the numbers.
Kinds, classes, pairs and gradients are worked out over all training texts. Training
passes over all of them in every round: each task starts from the round's weights, walks its
texts with AdaGrad steps and returns, for each feature it met, its change
and how often it met it; the weighted means make the next weights. Vocabulary, pairs and
weights have fixed sizes, which bound what is broadcast; rarer words are looked up by a
join.

The base is the unigram model with 0.1 added. Defined results: null and empty texts are
the end token alone; without training texts every token is unseen and both scores are 0; repeated rows agree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import materialize

#: Bounds of what is broadcast: words of the vocabulary, buckets of the features.
VOCABULARY = 1 << 17
WORD_BUCKETS = 2048
OWN_BUCKETS = 1500
PAIR_BUCKETS = 8192
#: Commonest words, by which kinds of texts are told apart, and steps of the k-means.
MARKERS = 256
KINDS = 8
STEPS = 6
BANDS = 2
CLASSES = KINDS * BANDS + 1
#: Commonest words whose pairs have weights, times a pair is met at least, and what is taken off its count.
HEAD = 512
PAIR_LEAST = 4
DISCOUNT = 0.75
ADD = 0.1
ROUNDS = (0.3, 0.15, 0.08)
#: Words a task counts at once, and tokens of one gradient step.
REMEMBERED = 400_000
STEP = 4096
#: Length of a text's profile, in whole numbers.
UNIT = 30_000
#: No text holds this byte.
END = b"\xff"


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]  # bytes: A-Z only, ASCII white space only


def _hashes(words: Collection[bytes]) -> np.ndarray:
    """``_hash`` of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each token (by its hash) is in ``text`` of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_hashes(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(_tokens(text))
            if len(seen) > REMEMBERED:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Vocabulary in order of frequency, classes and shares, the numbers behind both scores, and weights."""

    words: np.ndarray
    counts: np.ndarray
    buckets: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int
    unseen: float
    classes: np.ndarray | None = None
    share: np.ndarray | None = None
    prior: np.ndarray | None = None
    weights: np.ndarray | None = None
    gain: np.ndarray | None = None
    rest: np.ndarray | None = None

    @property
    def rare(self) -> int:
        return len(self.words)


_FEATURES = 1 + 3 * WORD_BUCKETS + PAIR_BUCKETS


def vocabulary(counted: DataFrame, size: int = VOCABULARY) -> Model:
    """The most frequent words, at most ``size`` of them: the threshold is a power of 2^(1/16)."""
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counted.groupBy(step.alias("s")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    rows = sorted((r["s"], r["v"], r["n"], r["once"]) for r in steps)[::-1]  # at most 1,024
    tokens, distinct, once = (sum(r[i] for r in rows) for i in (2, 1, 3))
    room, least = size, None
    for s, v, _, _ in rows:
        if v > room or s == 0:  # words met once stand for those never met
            break
        room, least = room - v, s
    head = counted.filter(step >= least) if least is not None else counted.filter("false")
    table = head.select("word", "n").orderBy(F.desc("n"), "word").toArrow()
    n = table.column("n").to_numpy().astype(np.int64)
    rare_tokens, rare_distinct = int(tokens - n.sum()), int(distinct - len(n))
    place = np.arange(len(n) + 2)
    mixed = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    buckets = np.where(place < OWN_BUCKETS, place, OWN_BUCKETS + 2 + mixed % (WORD_BUCKETS - OWN_BUCKETS - 2))
    buckets[len(n)], buckets[len(n) + 1] = OWN_BUCKETS, OWN_BUCKETS + 1
    # Good-Turing: of what falls outside the vocabulary, the share never seen before.
    edge = int(n[-1]) * int((n == n[-1]).sum()) if len(n) else 0
    unseen = once / (rare_tokens + edge) if once else 0.001 if rare_tokens else 1.0
    return Model(table.column("word").to_numpy(), n, buckets, int(tokens), int(distinct), rare_tokens, rare_distinct, unseen)


_NUMBERED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, numbers binary, rare array<long>"


def number(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, held_out, text)`` with each token's place in the vocabulary, and the hashes of those outside of it."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = shared.value
        rare, order = len(words), np.argsort(words)
        ordered, places = words[order], np.append(order, rare).astype(np.int32)

        def placed(hashes: np.ndarray) -> np.ndarray:
            found = np.searchsorted(ordered, hashes)
            found[np.append(ordered, 0)[found] != hashes] = rare
            return places[found]

        end = _hashes([END])
        weight = np.append(np.log10(counts + ADD), 0.0)
        for batch in batches:
            # Words are cut and told apart by Arrow; each different one is looked up once a batch.
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(3), "")))
            told = lists.flatten().dictionary_encode()
            names = told.dictionary.cast(pa.binary()).to_pylist()
            hashes = _hashes(names)
            place = placed(hashes)
            code = told.indices.to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            real = np.array([w != b"" for w in names], dtype=bool)[code] if names else np.zeros(0, dtype=bool)
            code, text = code[real], text[real]
            sizes = np.bincount(text, minlength=batch.num_rows) + 1
            ends = np.cumsum(sizes)
            at = np.arange(len(code)) + text  # an end after each text
            numbers, hashed = np.full(int(sizes.sum()), placed(end)[0], dtype=np.int32), np.full(int(sizes.sum()), end[0])
            numbers[at], hashed[at] = place[code], hashes[code]
            starts, out = ends - sizes, numbers == rare
            outside = np.add.reduceat(out.astype(np.int64), starts) if len(starts) else sizes
            data = [pa.py_buffer(np.append(0, 4 * ends).astype(np.int32).tobytes()), pa.py_buffer(numbers.tobytes())]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(sizes), pa.array(sizes - outside),
                    pa.array(np.add.reduceat(weight[numbers], starts) if len(starts) else np.zeros(0)),
                    pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, *data]),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(outside)).astype(np.int32)), pa.array(hashed[out])),
                ],
                names=[c.split()[0] for c in _NUMBERED.split(", ")],
            )

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(run, _NUMBERED)


def _laid(column: pa.Array, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts, three starts before each; where tokens are; how many each text has."""
    texts = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in column]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    at = np.arange(int(sizes.sum())) + np.repeat(3 * np.arange(1, len(sizes) + 1), sizes)
    numbers = np.full(len(at) + 3 * len(sizes), start, dtype=np.int64)
    if len(at):
        numbers[at] = np.concatenate(texts)
    return numbers, at, sizes


def _portions(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` tokens, or one long text."""
    ends = np.cumsum(batch.column("n_tokens").to_numpy())
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _profiles(numbers: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of how often it has each marker word, of length ``UNIT``, in whole numbers."""
    own = numbers[at]
    text = np.repeat(np.arange(len(sizes)), sizes)[own < MARKERS]
    counts = np.bincount(text * MARKERS + own[own < MARKERS], minlength=len(sizes) * MARKERS).reshape(len(sizes), MARKERS)
    rows = np.sqrt(counts)
    return np.rint(rows * (UNIT / np.maximum(np.sqrt(counts.sum(axis=1, keepdims=True)), 1e-9))).astype(np.uint16)


def _kind(profiles: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (profiles.astype(np.float64) @ centres.T).argmax(axis=1)


def find_kinds(learned: DataFrame, rare: int) -> np.ndarray:
    """Centres of the kinds of all texts of ``learned(n_tokens, numbers)``: spherical k-means from far-apart starts."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _portions(batch):
                rows = _profiles(*_laid(some.column("numbers"), rare + 1))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows[rows.any(axis=1)]], pa.binary())], names=["profile"])

    profiles = materialize(learned.select("n_tokens", "numbers").mapInArrow(profile, "profile binary"), "profiles")

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint16).reshape(-1, MARKERS)

    def sums(centres: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), MARKERS), dtype=np.int64)
            for batch in batches:
                rows = rows_of(batch)
                kind = _kind(rows, centres)
                for k in np.unique(kind):
                    total[k] += rows[kind == k].sum(axis=0, dtype=np.int64)
            kind, dim = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(dim), pa.array(total[kind, dim])], names=["kind", "dim", "v"])

        found = profiles.mapInArrow(run, "kind long, dim long, v long").groupBy("kind", "dim").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((len(centres), MARKERS))  # exact sums of whole numbers, at most KINDS * MARKERS rows
        for r in found:
            total[r["kind"], r["dim"]] = r["v"]
        return total

    def farthest(centres: np.ndarray) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: tuple[int, bytes] | None = None
            for batch in batches:
                rows = rows_of(batch)
                if len(rows):
                    near = np.rint((rows.astype(np.float64) @ centres.T).max(axis=1)).astype(np.int64)
                    best = min([(int(near[i]), rows[i].tobytes()) for i in np.flatnonzero(near == near.min())] + ([best] if best else []))
            yield pa.RecordBatch.from_arrays([pa.array([best[0]] if best else [], pa.int64()), pa.array([best[1]] if best else [], pa.binary())], names=["near", "profile"])

        row = profiles.mapInArrow(run, "near long, profile binary").agg(F.min(F.struct("near", "profile")).alias("r")).first()["r"]
        return None if row is None else np.frombuffer(bytes(row["profile"]), dtype=np.uint16).astype(np.float64)

    def unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)

    centres = unit(sums(np.zeros((1, MARKERS))))
    for _ in range(KINDS - 1):
        far = farthest(centres)
        if far is not None:
            centres = np.vstack([centres, unit(far[None, :])])
    for _ in range(STEPS):
        total = sums(centres)
        centres = np.where(total.any(axis=1, keepdims=True), unit(total), centres)
    return centres


def classify(learned: DataFrame, model: Model, centres: np.ndarray) -> Model:
    """Give every word its class and its share of it: the kind of text it is most at home in, and a band of frequency."""
    rare = model.rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((KINDS, rare + 1), dtype=np.int64)
        for batch in batches:
            for some in _portions(batch):
                numbers, at, sizes = _laid(some.column("numbers"), rare + 1)
                kind = np.repeat(_kind(_profiles(numbers, at, sizes), centres), sizes)
                for k in np.unique(kind):
                    met[k] += np.bincount(numbers[at[kind == k]], minlength=rare + 1)
        kind, word = np.nonzero(met[:, :rare])
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(kind), pa.array(met[kind, word])], names=["word", "kind", "n"])

    found = learned.select("n_tokens", "numbers").mapInArrow(run, "word long, kind long, n long")
    found = found.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"k{k}") for k in range(KINDS)]).toArrow()
    met = np.zeros((rare, KINDS))  # the vocabulary's counts
    met[found.column("word").to_numpy()] = np.stack([found.column(f"k{k}").to_numpy() for k in range(KINDS)], axis=1).reshape(-1, KINDS)
    home = (met / np.maximum(met.sum(axis=0), 1)).argmax(axis=1)
    n = model.counts
    classes = np.full(rare + 2, CLASSES - 1, dtype=np.int64)
    for k in range(KINDS):
        own = np.flatnonzero(home == k)
        mass = np.cumsum(n[own])
        classes[own] = k * BANDS + np.minimum(BANDS - 1, (mass - n[own]) * BANDS // max(1, mass[-1] if len(own) else 1))
    of = np.bincount(classes[:rare], n, CLASSES)
    many = np.bincount(classes[:rare], minlength=CLASSES)
    model.classes = classes
    model.share = np.log10((n + ADD) / (of + ADD * many)[classes[:rare]]) if rare else np.zeros(0)
    of[CLASSES - 1] = model.rare_tokens
    model.prior = np.log((of + 0.5) / (of + 0.5).sum())
    return model


def weigh_pairs(learned: DataFrame, model: Model) -> Model:
    """Weights of frequent pairs inside the classes.

    A pair with a weight has its discounted share of what follows its first word in the
    class of its second; what is left goes to the other words by their shares.
    """
    rare, width = model.rare, HEAD + CLASSES
    classes = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(HEAD * width, dtype=np.int64)
        for batch in batches:
            for some in _portions(batch):
                numbers, at, _ = _laid(some.column("numbers"), rare + 1)
                last, word = numbers[at - 1], numbers[at]
                after = last < min(HEAD, rare)
                last, word = last[after], word[after]
                both = word < min(HEAD, rare)
                met += np.bincount(np.concatenate([last * width + HEAD + classes[word], last[both] * width + word[both]]), minlength=HEAD * width)
        code = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(met[code])], names=["code", "n"])

    found = learned.select("n_tokens", "numbers").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    met = np.zeros(HEAD * width)  # at most HEAD * (HEAD + CLASSES) numbers
    met[found.column("code").to_numpy()] = found.column("n").to_numpy()
    met = met.reshape(HEAD, width)
    model.gain, model.rest = _pair_weights(met[:, :HEAD], met[:, HEAD:], classes[:rare][:HEAD], model.share[:HEAD])
    return model


def _pair_weights(pairs: np.ndarray, follow: np.ndarray, classes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of what a pair's second word gains on its share (NaN: no weight), and of what others of its class gain; one more row and column for none."""
    gain, rest = np.full((HEAD + 1, HEAD + 1), np.nan), np.zeros((HEAD + 1, CLASSES))
    words = len(classes)
    for c in np.unique(classes):
        own = np.flatnonzero(classes == c)
        with_ = pairs[:, own] >= PAIR_LEAST
        total = np.maximum(follow[:, c], 1)[:, None]
        mass = np.where(with_, (pairs[:, own] - DISCOUNT) / total, 0.0)
        plain = 10 ** share[own]
        left, room = 1 - mass.sum(axis=1), 1 - (with_ * plain).sum(axis=1)
        some = with_.any(axis=1)
        full = some & (room < 1e-6)  # all of the class have weights: nothing is left for others
        mass[full] /= mass[full].sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            gain[np.ix_(np.arange(HEAD), own)] = np.where(with_, np.log10(mass) - share[own], np.nan)
        rest[:HEAD, c] = np.where(some & ~full, np.log10(np.maximum(left, 1e-12) / np.maximum(room, 1e-6)), 0.0)
    assert words <= HEAD
    return gain, rest


def _features(numbers: np.ndarray, at: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token: bias, last, second and third last word, last two."""
    one, two, three = (buckets[numbers[at - j]] for j in (1, 2, 3))
    pair = ((one * WORD_BUCKETS + two).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % PAIR_BUCKETS
    return np.stack([np.zeros_like(one), 1 + one, 1 + WORD_BUCKETS + two, 1 + 2 * WORD_BUCKETS + three, 1 + 3 * WORD_BUCKETS + pair])


def _sums(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[1], axis=0)
    z += weights[0]
    for row in rows[2:]:
        z += weights.take(row, axis=0)
    return z


def _log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = _sums(weights, rows)
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _inside(model: Model, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 of each token's probability within its class, but for rare words."""
    last, word = numbers[at - 1], numbers[at]
    most = min(HEAD, model.rare)
    first, second = np.where(last < most, last, HEAD), np.where(word < most, word, HEAD)
    gain = model.gain[first, second]
    return np.append(model.share, [0.0, 0.0])[word] + np.where(np.isnan(gain), model.rest[first, model.classes[word]], gain)


def _step(w: np.ndarray, steep: np.ndarray, met: np.ndarray, rows: np.ndarray, classes: np.ndarray, rate: float) -> None:
    """One AdaGrad step over tokens of ``classes`` with the features ``rows``: ``w``, ``steep`` and ``met`` are changed in place."""
    n = len(classes)
    p = _sums(w, rows).T.copy()  # a row for each class: sums and maxima over classes run along the tokens
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    p[classes, np.arange(n)] -= 1
    total = p.sum(axis=1)
    steep[0] += (total**2 / n).mean()
    w[0] -= rate * total / np.sqrt(n * steep[0])
    met[0] += n
    slope = np.zeros((n, CLASSES + CLASSES % 2), dtype=np.float32)
    slope[:, :CLASSES] = p.T
    code = rows[1:].astype(np.uint16).ravel()  # features have rows of their own; 16 bits: sorted by radix
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    row = sorted_[first].astype(np.int64)
    times = np.diff(np.append(first, len(sorted_)))
    token = np.tile(np.arange(n), len(rows) - 1).take(order)
    g = slope.take(token[first], axis=0)
    many = times > 1
    several = times[many]
    if len(several):  # two classes in one complex number: half as many sums
        g[many] = np.add.reduceat(slope.take(token[np.repeat(many, times)], axis=0).view(np.complex64), np.cumsum(several) - several, axis=0).view(np.float32)
    g = g[:, :CLASSES]
    g /= np.sqrt(times, dtype=np.float32)[:, None]
    steep[row, 0] += np.einsum("ij,ij->i", g, g) / np.float32(CLASSES)
    g *= (rate / np.sqrt(steep[row])).astype(np.float32)
    w[row] -= g
    met[row] += times


def train(learned: DataFrame, model: Model, rounds: tuple[float, ...] = ROUNDS) -> Model:
    """Fit the class weights to all rows of ``learned(n_tokens, numbers)``: each round passes over all of them."""
    weights = np.zeros((_FEATURES, CLASSES), dtype=np.float32)
    weights[0] = model.prior
    names = [f"d{i}" for i in range(CLASSES)]
    context = learned.sparkSession.sparkContext
    rare = model.rare
    for rate in rounds:
        shared = context.broadcast((model.classes, model.buckets, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            classes, buckets, begun = shared.value
            w = begun.copy()
            steep = np.full((_FEATURES, 1), 0.1, dtype=np.float32)
            met = np.zeros(_FEATURES)
            for batch in batches:
                for some in _portions(batch):
                    numbers, at, _ = _laid(some.column("numbers"), rare + 1)
                    for s in range(0, len(at), STEP):
                        now = at[s : s + STEP]
                        _step(w, steep, met, _features(numbers, now, buckets), classes[numbers[now]], rate)
            row = np.flatnonzero(met)
            change = ((w - begun)[row] * met[row, None]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row.astype(np.int32)), pa.array(met[row]), *map(pa.array, np.ascontiguousarray(change.T))], names=["row", "met", *names]
            )

        changes = learned.select("n_tokens", "numbers").mapInArrow(run, f"row int, met double, {', '.join(f'{n} double' for n in names)}")
        summed = changes.groupBy("row").agg(F.sum("met").alias("met"), *[F.sum(n).alias(n) for n in names]).toArrow()
        row = summed.column("row").to_numpy()
        mean = np.stack([summed.column(n).to_numpy() for n in names], axis=1) / summed.column("met").to_numpy()[:, None]
        weights = weights.copy()
        weights[row] += mean.astype(np.float32)
        shared.unpersist()
    model.weights = weights
    return model


_PARTIAL = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, part double, rare array<long>, outside array<double>"


def score(numbered: DataFrame, model: Model, counted: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of the texts in ``numbered``.

    ``known_base`` and ``known_score`` are the parts of both scores that known tokens have.
    """
    shared = numbered.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in batches:
            for some in _portions(batch):
                numbers, at, sizes = _laid(some.column("numbers"), own.rare + 1)
                part, rare = np.empty(len(at)), numbers[at] == own.rare
                for s in range(0, len(at), STEP):
                    now = at[s : s + STEP]
                    z = _sums(own.weights, _features(numbers, now, own.buckets)).T.copy()
                    z -= z.max(axis=0)
                    chosen = z[own.classes[numbers[now]], np.arange(len(now))]
                    part[s : s + STEP] = (chosen - np.log(np.exp(z, out=z).sum(axis=0))) / np.log(10)
                part += _inside(own, numbers, at)
                starts = np.cumsum(sizes) - sizes
                outside = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(rare, starts, dtype=np.int64))).astype(np.int32)), pa.array(part[rare]))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:6], pa.array(np.add.reduceat(np.where(rare, 0.0, part), starts)), some.column("rare"), outside],
                    names=[c.split()[0] for c in _PARTIAL.split(", ")],
                )

    columns = ("row", "doc_id", "held_out", "n_tokens", "n_head", "base", "rare", "numbers")
    partial = materialize(numbered.select(*columns).mapInArrow(run, _PARTIAL), "partial")
    least = int(model.counts[-1]) if len(model.counts) else 1 << 62
    seen = counted.filter(F.col("n") <= least).select("word", "n")
    # A rare token's class has its score in context; the word in it is looked up.
    tail = partial.select("row", F.explode(F.arrays_zip("rare", "outside")).alias("t"))
    tail = tail.select("row", F.col("t.rare").alias("word"), F.col("t.outside").alias("part")).join(seen, "word", "left")
    n = F.coalesce("n", F.lit(0))
    unseen, rest = np.log10(model.unseen), np.log10(max(1e-12, 1 - model.unseen)) - np.log10(max(ADD, model.rare_tokens + ADD * model.rare_distinct))
    inside = F.col("part") + F.when(n > 0, F.log10(n + ADD) + float(rest)).otherwise(float(unseen))
    base = F.log10(n + ADD)
    known = lambda c: F.sum(F.when(n > 0, c).otherwise(0))
    tail = tail.groupBy("row").agg(
        known(F.lit(1)).alias("known"), F.sum(base).alias("tail_base"), F.sum(inside).alias("tail_part"),
        known(base).alias("known_base"), known(inside).alias("known_part"),
    )
    whole = float(np.log10(model.tokens + ADD * (model.distinct + 1)))
    none = F.lit(0.0)
    rows = partial.drop("rare", "outside").join(tail, "row", "left")
    rows = rows.withColumn("n_known", F.col("n_head") + F.coalesce("known", F.lit(0)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", none) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("part") + F.coalesce("tail_part", none)).alias("score"),
        (F.col("base") + F.coalesce("known_base", none) - F.col("n_known") * whole).alias("known_base"),
        (F.col("part") + F.coalesce("known_part", none)).alias("known_score"),
    )


def fit(learned: DataFrame, model: Model) -> Model:
    """All that is learned from the numbered texts ``learned``."""
    model = classify(learned, model, find_kinds(learned, model.rare))
    return train(learned, weigh_pairs(learned, model))


def fit_and_score(docs: DataFrame, vocabulary_size: int = VOCABULARY) -> DataFrame:
    """Learn from the rows of ``docs(doc_id, held_out, text)`` that are not held out, and score all rows."""
    counted = materialize(count_words(docs.filter("not held_out")), "words")
    model = vocabulary(counted, vocabulary_size)
    numbered = materialize(number(docs, model), "numbers")
    return score(numbered, fit(numbered.filter("not held_out"), model), counted)
