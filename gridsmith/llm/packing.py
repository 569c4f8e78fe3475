"""Best-fit packing of token sequences behind a Martello-Toth dominance reduction.

Only the lengths decide a packing, and there are at most CAPACITY of them. So
the instance is a histogram, which the driver solves whatever the number of
documents: it fixes sets of lengths that provably dominate all alternatives for
a length (a length that nothing fits beside; one partner that fills the
sequence exactly; the largest partner where no two fit), as often as the counts
allow, shrinks the histogram and packs what remains best-fit decreasing. Each
solution line (a set of lengths, how often) is dealt back to the pieces by
their rank among pieces of equal length. Ranks come from counts by task, so no
group of equal lengths ever meets in one task.

Defined results: a null text counts as empty and is the end id alone; an empty
table gives no rows; repeated rows are packed one by one, and keep their doc_id.
Further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.common import cut, id_and_text

CAPACITY = 1024
END = 2
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
SPACES = re.compile(r"\s\s")
_CACHED = 200_000


class _Pieces(dict):
    """Ids, as bytes, of a space and what follows it up to the next."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _CACHED:
            self.clear()
        ids = self[piece] = self.encode(" " + piece)
        return ids


class Encoder:
    """Little-endian unsigned 32-bit ids of a text under the byte-level BPE vocabulary."""

    def __init__(self, ranks_file: str):
        with open(ranks_file, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        self.whole = lambda text: np.array(bpe.encode(text, allowed_special="all"), "<u4").tobytes()
        self.part = lambda text: np.array(bpe.encode_ordinary(text), "<u4").tobytes()
        self.pieces = _Pieces(self.part)

    def ids(self, text: str) -> bytes:
        """The pattern never joins characters across a single space but to what follows it, so those pieces are looked up one by one; a text with runs of white space or the special token goes through whole."""
        if SPECIAL in text or SPACES.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.part(first) + b"".join(map(self.pieces.__getitem__, rest))


@lru_cache(1)
def encoder(ranks_file: str) -> Encoder:
    return Encoder(ranks_file)


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences from the end, what is over comes first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, ranks_file: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece, with its task and its rank among the task's pieces of that length."""
    path = ranks_file or public_tokenizers.path(RANKS)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.ids(text) + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length])))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return id_and_text(docs).mapInArrow(run, PIECES)


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Sets that dominate all others for a length, with how often they are fixed, and the histogram that remains."""
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[tuple[list[int], int]] = []

    def fix(items: list[int], times: int) -> None:
        fixed.append((items, times))
        for n in items:
            left[n] -= times
        for n in set(items):
            if not left[n]:
                del left[n]

    again = True
    while again:
        again = False
        for n in sorted(left, reverse=True):
            while left.get(n, 0):
                room = capacity - n
                other = lambda m: left.get(m, 0) - (m == n)  # noqa: B023, E731
                rising = sorted(left)
                small: list[int] = []
                for m in rising:
                    small += [m] * min(2 - len(small), other(m))
                    if len(small) == 2:
                        break
                if not small or small[0] > room:
                    fix([n], left[n] if n > room else 1)
                elif other(room) > 0:
                    fix([n, room], left[n] // 2 if n == room else min(left[n], left[room]))
                elif len(small) == 1 or sum(small) > room:
                    best = max(m for m in rising if m <= room and other(m) > 0)
                    fix([n, best], left[n] // 2 if n == best else min(left[n], left[best]))
                else:
                    break
                again = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram: open sequences with equal contents are kept as one entry with a count."""
    done: list[tuple[list[int], int]] = []
    open_by: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(items: list[int], times: int, room: int) -> None:
        if not room:
            done.append((items, times))
            return
        if not open_by[room]:
            insort(rooms, room)
        open_by[room].append((items, times))

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                items, times = open_by[room].pop()
                if not open_by[room]:
                    rooms.pop(at)
                use = min(times, todo)
                if use < times:
                    put(items, times - use, room)
                put([*items, n], use, room - n)
                todo -= use
            else:
                each = min(capacity // n, todo)
                use = todo // each
                put([n] * each, use, capacity - n * each)
                todo -= use * each
    return done + [entry for room in rooms for entry in open_by[room]]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _runs(solution: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank: where runs of ranks begin, their first sequence, and their place in it."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for items, times in solution:
        offset = 0
        for n in items:
            runs[n].append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in runs.items()}


def pack(docs: DataFrame, ranks_file: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, ranks_file, capacity))
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # At most `capacity` lengths come to the driver, and as many lists of runs go back.
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = _runs(solve(histogram, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = rows.join(bases.select("part", "length", "base"), ["part", "length"]).select(*names, (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                starts, first, place_in = runs[int(n)]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                sequence[at], offset[at] = first[k] + rank[at] - starts[k], place_in[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
