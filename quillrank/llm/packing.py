"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. What fits where depends on
lengths alone, so the plan is made on the histogram of lengths: at most ``capacity``
numbers, whatever the corpus. Dominance fixes sets of lengths that are at least as
good as any other choice for their largest member, the rest is packed best-fit
decreasing. Both work on multiplicities and leave *runs*: "pieces number i to j of
this length go to sequences from s on, k in each, from this offset". A piece finds its
run by its rank among the pieces of its length. No step gathers pieces.

Dominance rules for the largest length L still unpacked, beside it room R, and the
largest length J that fits there: J fills R; or no two pieces fit into R; or no three
do and J is at least as long as any two that do; or no three do and J with its best
companion covers every other pair. In each case the set may be fixed (Martello and
Toth: any other feasible set can be exchanged for it without using more sequences).

Defined results: null and empty texts are one piece with the end token alone; a
table without rows gives none; repeated rows are packed as often as they come.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillrank.llm.common import materialize

CAPACITY = 2048
END = 0
#: Words, and stems, whose ids a task remembers at most.
REMEMBERED = 400_000
#: Pieces of one length that one task numbers, about.
NUMBERED = 50_000


#: How the vocabulary's tokenizer cuts lower-case text into words.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words the quick way covers: no controls, no special spaces, nothing that normal forms change.
_PLAIN = r"[!-~\u00a1-\u024f]*"


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Ids(dict):
    """Little-endian ids by white-space-free word: no token spans white space, so words stand alone.

    A task meets the same words and stems again and again and remembers them. Plain
    words are cut here and looked up in the tokenizer's model, all others go through
    the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut, self.plain = regex.compile(_CUT).findall, regex.compile(_PLAIN).fullmatch
        self.letters = _byte_letters()
        self.stems: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode("utf-8", "replace")
        if len(word) > 256 or "<|" in text or not self.plain(text):
            out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            out = b"".join(map(self.stem, self.cut(text.lower())))
        if len(word) <= 256:
            self[word] = out
        return out

    def stem(self, text: str) -> bytes:
        out = self.stems.get(text)
        if out is None:
            if len(self.stems) >= REMEMBERED:
                self.stems.clear()
            shown = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
            out = self.stems[text] = np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, on demand, ``ids`` of every document's pieces."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(tokenizer)
        end = np.array([END], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                text = text or b""
                if b"<|" not in text:  # no special token, and lower case comes anyway
                    text = text.lower()
                data = b"".join(map(ids.__getitem__, text.split())) + end
                for n, s in enumerate(range(0, len(data), width)):
                    piece = data[s : s + width]
                    row = [doc, n, s // 4, len(piece) // 4, zlib.crc32(piece)]
                    out.append([*row, np.frombuffer(piece, dtype="<i4")] if keep_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            columns = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Plan:
    """Runs: (length, first rank, per sequence, first sequence, offset), for ``times`` sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.left)
        self.taken = dict.fromkeys(self.left, 0)
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []

    def take(self, length: int, per: int, times: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], per, sequence, offset))
        self.taken[length] += per * times
        self.left[length] -= per * times
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def fitting(self, room: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length of at most ``room`` once ``without`` is taken."""
        for i in range(bisect.bisect_right(self.lengths, room) - 1, -1, -1):
            if self.left[self.lengths[i]] > without.count(self.lengths[i]):
                return self.lengths[i]
        return None

    def smallest(self, many: int, without: tuple[int, ...]) -> int:
        """Sum of the ``many`` smallest pieces, or more than any room if there are fewer."""
        total = 0
        for length in self.lengths:
            have = min(many, self.left[length] - without.count(length))
            total, many = total + have * length, many - have
            if not many:
                return total
        return self.capacity + 1

    def best_pair(self, room: int, without: tuple[int, ...]) -> tuple[int, int]:
        """The largest sum of two pieces within ``room``, and the largest length that is the lesser of such two."""
        best = lesser = 0
        i, j = bisect.bisect_right(self.lengths, room) - 1, 0
        for a in self.lengths[: i + 1]:
            b = self.fitting(room - a, (*without, a))
            if self.left[a] > without.count(a) and b is not None:
                best, lesser = max(best, a + b), max(lesser, min(a, b))
        return best, lesser

    def dominant(self, large: int) -> tuple[int, ...] | None:
        """A set with ``large`` that may be fixed."""
        room, own = self.capacity - large, (large,)
        mate = self.fitting(room, own)
        if mate is None:
            return own
        if mate == room or self.smallest(2, own) > room:
            return large, mate
        if self.smallest(3, own) <= room:
            return None
        best, lesser = self.best_pair(room, own)
        if mate >= best:
            return large, mate
        third = self.fitting(room - mate, (large, mate))
        if third is not None and lesser <= third:
            return large, mate, third
        return None

    def reduce(self) -> None:
        """Fix dominating sets until no length gives another."""
        again = True
        while again:
            again = False
            for large in self.lengths[::-1]:
                while large in self.left and (found := self.dominant(large)):
                    times = min(self.left[x] // found.count(x) for x in set(found))
                    offset = 0
                    for x in found:
                        self.take(x, 1, times, self.sequences, offset)
                        offset += x
                    self.sequences += times
                    again = True

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence that has room; equal sequences move together."""
        rooms: list[int] = []  # sorted rooms that occur
        at: dict[int, list[tuple[int, int]]] = {}  # room → (first sequence, how many)

        def put(room: int, first: int, many: int) -> None:
            if many and room:
                if room not in at:
                    bisect.insort(rooms, room)
                at.setdefault(room, []).append((first, many))

        for length in self.lengths[::-1]:
            while length in self.left:
                i = bisect.bisect_left(rooms, length)
                if i == len(rooms):
                    first, room = self.sequences, self.capacity
                    many = -(-self.left[length] // (room // length))
                    self.sequences += many
                else:
                    room = rooms[i]
                    first, many = at[room].pop()
                    if not at[room]:
                        del at[room]
                        rooms.pop(i)
                have = self.left[length]
                per = room // length
                full = min(many, have // per)
                if full:
                    self.take(length, per, full, first, self.capacity - room)
                    put(room - per * length, first, full)
                some = min(have - full * per, per) if full < many else 0
                if some:
                    self.take(length, some, 1, first + full, self.capacity - room)
                    put(room - some * length, first + full, 1)
                rest = full + bool(some)
                put(room, first + rest, many - rest)


def plan(counts: dict[int, int], capacity: int = CAPACITY, dominance: bool = True) -> tuple[list, int]:
    """Runs for a histogram of lengths, and the number of sequences."""
    made = _Plan(counts, capacity)
    if dominance:
        made.reduce()
    made.best_fit()
    return made.runs, made.sequences


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (pieces with ``length`` of at most ``capacity``) with ``sequence_id`` and ``offset``."""
    made = made.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ≤ capacity rows
    runs, _ = plan(counts, capacity)
    parts = -(-max([1, *counts.values()]) // NUMBERED)
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in made.columns]  # alike in all of them: alike in what is placed
    cut = made.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    starts = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_part").orderBy(*keys)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_start")).select(*made.columns, "_rank")
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    schema = T.StructType([*made.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    width = len(made.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            run = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence = run[:, 3] + nth // run[:, 2]
            offset = run[:, 4] + nth % run[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:width], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack."""
    return pack(materialize(pieces(docs, tokenizer, capacity, keep_ids), "pieces"), capacity)
