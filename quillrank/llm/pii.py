"""Personal data found by weak supervision.

Candidates are the spans of the base patterns and of looser ones (numbers without a
country code, spelt-out addresses and the like). For each candidate several labelers
vote yes, no or abstain: the strict pattern, checks of the value, gazetteers of hosts
and of words that announce a kind of data, and the characters around. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is,
by kind; its posteriors are the soft labels of a logistic span classifier, which
decides about the candidates beyond the base patterns. Base spans always stay.

Votes are gathered from every text, but as counts of patterns: at most
``3 ** len(LABELERS)`` numbers a kind, whatever the corpus.

Defined results: null and empty texts hold nothing; spans are code points, end
exclusive; repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "value", "host", "announced", "edges", "number")

# Starts are tied to where a run of digits begins: the same leftmost matches as the
# plain patterns, without trying every digit of a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

_LOOSE = {
    "email": re.compile(
        r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}"
        r"(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,4}"
    ),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![\w.+-])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+/-])(?:(?:\+|00)[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![\w-])"),
}
#: What a text must contain for a loose pattern to be worth trying.
_HINT = {"email": re.compile(r"[\[({]\x20?(?:at|AT)\b"), "ip": re.compile(r":[0-9A-Fa-f]{1,4}:"), "card": None, "phone": None}

#: Gazetteers: common top-level domains, and words that announce a kind.
HOSTS = frozenset("com org net edu gov io dev info biz eu de fr es it uk us ca nl ch at be pl se no fi dk pt br mx jp cn in au".split())
ANNOUNCED = {
    "email": frozenset("email e-mail mail mailto contact correo courriel kontakt write reply from to".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address addr gateway dns subnet client adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit cc karte carte tarjeta payment pan".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono móvil handy sms whatsapp".split()),
}
#: Words that announce another kind of number.
OTHER = frozenset("version ver v order invoice isbn issn doi sku serial id no nr build release section page ref rev".split())
_LAST_WORDS = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _octets(text: str) -> list[int] | None:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return [int(p) for p in parts] if all(len(p) <= 3 for p in parts) else None


def _valid(kind: str, span: str) -> bool:
    if kind == "ip":
        octets = _octets(span)
        return octets is not None and max(octets) <= 255
    if kind == "card":
        digits = _digits(span)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_digits(span)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``start, kind, end`` by the base patterns, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for n, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        if n == 3 and "+" not in text:
            continue
        found += [(m.start(), n, m.end()) for m in pattern.finditer(text) if m.end() - m.start() > 6 and _valid(KINDS[n], m.group())]
    return [(s, KINDS[n], e) for s, n, e in sorted(found)]


_ANY = re.compile(r"[0-9@\[({]")


def candidates(text: str) -> list[tuple[int, str, int, bool]]:
    """``start, kind, end, base``: base spans, and loose ones that overlap none of them."""
    if not text or not _ANY.search(text):
        return []
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    taken = bytearray(len(text))
    for s, _, e in base:
        taken[s:e] = b"\1" * (e - s)
    for kind, pattern in _LOOSE.items():
        hint = _HINT[kind]
        if hint and not hint.search(text):
            continue
        for m in pattern.finditer(text):
            if taken.find(1, m.start(), m.end()) < 0:
                out.append((m.start(), kind, m.end(), False))
    return sorted(out, key=lambda c: (c[0], KINDS.index(c[1]), c[2]))


def votes(text: str, start: int, kind: str, end: int, base: bool) -> tuple[int, ...]:
    """1 yes, -1 no, 0 abstain, in the order of ``LABELERS``."""
    span = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 2]
    value = 0
    if kind == "email":
        value = 1 if len(span) <= 254 and ".." not in span else -1
    elif kind == "ip":
        octets = _octets(span) if ":" not in span else None
        value = 0 if octets is None else 1 if octets[0] not in (0, 127, 255) and len(set(octets)) > 1 else -1
    elif kind == "card":
        digits = _digits(span)
        value = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    elif kind == "phone":
        digits = _digits(span)
        value = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 3 else -1
    host = 0
    if kind == "email":
        host = 1 if re.split(r"[^A-Za-z]+", span.lower().rstrip("])} "))[-1] in HOSTS else -1
    words = [w.lower() for w in _LAST_WORDS.findall(before)[-3:]]
    announced = 1 if any(w in ANNOUNCED[kind] for w in words) else -1 if any(w in OTHER for w in words[-1:]) else 0
    left, right = before[-1:], after[:1]
    glued = (left.isalnum() or left in "_#$=/\\") if left else False
    glued |= bool(right) and (right.isalnum() or right in "_/\\")
    number = -1 if kind != "email" and (re.search(r"[0-9][.,-]?\Z", before) or re.match(r"[.,-]?[0-9]", after)) else 0
    return (1 if base else 0, value, host, announced, -1 if glued else 1, number)


def _code(vote: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(vote))


@dataclass
class SpanModel:
    """``weights[kind]``: bias and one weight for each labeler and vote; ``reliability`` as EM left it."""

    weights: np.ndarray
    reliability: np.ndarray

    def accepts(self, kind: str, vote: tuple[int, ...]) -> bool:
        return float(_features(np.array([vote]))[0] @ self.weights[KINDS.index(kind)]) > 0


def _features(vote: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(vote), 1)), vote == 1, vote == -1], axis=1).astype(float)


def expectation_maximisation(vote: np.ndarray, times: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and P(vote | truth) by labeler.

    Pseudo-counts that say "labelers are more often right than wrong" tie the two
    classes to their meaning, also where hardly any candidates exist.
    """
    hot = np.stack([vote == -1, vote == 0, vote == 1], axis=2).astype(float)  # pattern, labeler, vote
    prior = np.array([[6.0, 4.0, 1.0], [1.0, 4.0, 6.0]])
    post = np.clip(0.5 + vote.sum(axis=1) / (2 * vote.shape[1]), 0.05, 0.95)
    table = np.zeros((2, vote.shape[1], 3))
    for _ in range(rounds):
        for y, p in ((0, 1 - post), (1, post)):
            table[y] = np.einsum("p,plv->lv", times * p, hot) + prior[y]
            table[y] /= table[y].sum(axis=1, keepdims=True)
        share = (times @ post + 1) / (times.sum() + 2)
        fit = np.einsum("plv,ylv->yp", hot, np.log(table)) + np.log([[1 - share], [share]])
        post = 1 / (1 + np.exp(np.clip(fit[0] - fit[1], -50, 50)))
    return post, table


def fit(docs: DataFrame) -> SpanModel:
    """Learn from the ``text`` of all rows."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for s, kind, e, base in candidates(text):
                    seen[KINDS.index(kind), _code(votes(text, s, kind, e, base))] += 1
        rows = [(k, c, n) for (k, c), n in seen.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kind", "code", "times"])

    counted = docs.select("text").mapInArrow(gather, "kind long, code long, times long")
    patterns = np.array([tuple(r) for r in counted.groupBy("kind", "code").agg(F.sum("times")).orderBy("kind", "code").collect()], dtype=np.int64).reshape(-1, 3)
    width = len(LABELERS)
    weights, tables = np.zeros((len(KINDS), 1 + 2 * width)), np.zeros((len(KINDS), 2, width, 3))
    for k in range(len(KINDS)):
        own = patterns[patterns[:, 0] == k]
        vote = np.array([[c // 3**i % 3 - 1 for i in range(width)] for c in own[:, 1]], dtype=np.int64).reshape(-1, width)
        times = own[:, 2].astype(float)
        post, tables[k] = expectation_maximisation(vote, times)
        x = _features(vote)
        w = weights[k]
        # Start from what EM says of the labelers, then fit the soft labels by Newton steps.
        odds = np.log(tables[k, 1]) - np.log(tables[k, 0])
        w[1 : 1 + width], w[1 + width :] = odds[:, 2] - odds[:, 1], odds[:, 0] - odds[:, 1]
        w[0] = odds[:, 1].sum() + (np.log((times @ post + 1) / (times @ (1 - post) + 1)) if len(own) else 0)
        anchor = w.copy()
        for _ in range(20 if len(own) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (times * (post - p)) - (w - anchor)
            curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            w += np.linalg.solve(curve, slope)
    return SpanModel(weights, tables)


def spans(text: str | None, model: SpanModel) -> list[tuple[int, str, int, bool]]:
    """``start, kind, end, base`` of all personal data in one text; no added spans overlap."""
    out: list[tuple[int, str, int, bool]] = []
    free = 0
    for s, kind, e, base in candidates(text or ""):
        if base:
            out.append((s, kind, e, True))
        elif s >= free and model.accepts(kind, votes(text, s, kind, e, base)):
            out.append((s, kind, e, False))
            free = e
    return out


def _joined(found: list[tuple[int, str, int, bool]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e, _ in found)


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` without its text: base spans counted by kind and hashed, and all spans."""
    made = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    rest = [c for c in docs.columns if c not in ("text", *made)]
    fields = [docs.schema[c] for c in rest] + [T.StructField(c, T.LongType()) for c in made[:4]] + [T.StructField(c, T.StringType()) for c in made[4:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(len(rest)).to_pylist():
                found = spans(text, model)
                base = [x for x in found if x[3]]
                counts = Counter(x[1] for x in base)
                rows.append((*(counts[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            columns = list(zip(*rows)) or [()] * 6
            made_arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *made_arrays], names=[*rest, *made])

    return docs.select(*rest, "text").mapInArrow(run, T.StructType(fields))


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with every span of its text replaced by the kind in brackets."""
    place = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for s, kind, e, _ in spans(text, model):
            if s >= at:
                parts += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        return "".join([*parts, text[at:]]) if parts or at else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], texts, *batch.columns[place + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
