"""Benchmark decontamination by greedy string tiling.

Seeds are MATCH consecutive words. A document's windows are joined with the
benchmark's by their Karp-Rabin hash (and then word by word); seeds on one
diagonal join to maximal matches. The longest match is tiled first, its words
on both sides are marked, and what is left of the others is cut to unmarked
words and tried again, until none of MATCH words remains. An item's coverage is
the share of its words in tiles, so passages in another order count fully. A
document that covers COVERAGE or more of an item is contaminated by it.

Which items may be covered follows from the distinct seeds a document shares
with each, one entry a seed; only for these are pairs of places made, at most
PAIRS at once, and folded into runs on their diagonals before the next come. So
a text that repeats itself costs time by its places, but no more memory than its
diagonals.

A benchmark whose measured text is at most BLOCK_BYTES goes to the tasks whole,
and each document is looked at once, where it stands. A larger one is joined by
a shuffle on the seeds' hashes; documents that share seeds enough of an item
meet it by their keys. Both ways give the same rows, and each takes one pass
over the documents' words, whatever the benchmark's size.

Defined results: null texts count as empty, and texts or items without words
match nothing; texts of any length are taken whole; items of fewer than MATCH
words must occur as a whole. Of equally long matches the one that starts first
in the document, then in the item, is tiled first. Repeated rows, on either
side, give a row each. Empty tables give no rows. Further columns, whatever
their names, are ignored, or kept as they are by `drop_contaminated`.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import cut, id_and_text, small_batches

MATCH = 5
COVERAGE = 0.5
BLOCK_BYTES = 8 << 20
#: Pairs of places that are held at once.
PAIRS = 500_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _STIR
    mixed ^= mixed >> np.uint64(29)
    for i in range(n):
        out = out * _BASE + mixed[i : i + len(out)]
    return out


def tile(matches: list[tuple[int, int, int]], n_doc: int, n_item: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal matches (doc start, item start, length): the longest first, no word twice."""
    heap = [(-n, p, q) for p, q, n in matches if n >= least]
    heapq.heapify(heap)
    doc, item = np.zeros(n_doc, bool), np.zeros(n_item, bool)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        used = doc[p : p + n] | item[q : q + n]
        if not used.any():
            doc[p : p + n] = item[q : q + n] = True
            tiles.append((p, q, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], used, [1]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), p + int(a), q + int(a)))
    return tiles


class Benchmark:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], match: int = MATCH):
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.number: dict[bytes, int] = {}
        self.ids = [np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int64) for _, w in self.items]
        self.match = match
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, ids in enumerate(self.ids):
            n = min(match, len(ids))
            by[n] += [(int(h), k, q) for q, h in enumerate(rolling(ids, n))]
        for n, rows in by.items():
            rows.sort()
            self.seeds[n] = tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))

    def covers(self, text: str, coverage: float) -> list[tuple[int, int, int, int]]:
        """(item id, its words, words in tiles, tiles) of every item that the text covers enough of."""
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words_of(text)), np.int64)
        out = []
        for n, (hashes, item, place) in self.seeds.items():
            inside = np.concatenate([[0], np.cumsum(ids >= 0)])
            at = np.flatnonzero(inside[n:] - inside[:-n] == n) if len(ids) >= n else np.zeros(0, np.int64)
            if not len(at):
                continue
            own = rolling(ids, n)[at]
            # The benchmark's seeds that the document holds, one entry each: no tiling covers more words than these touch.
            distinct = np.unique(own)
            low, high = np.searchsorted(hashes, distinct, "left"), np.searchsorted(hashes, distinct, "right")
            many = high - low
            held = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            if not len(held):
                continue
            held = held[np.argsort(item[held], kind="stable")]
            numbers, starts = np.unique(item[held], return_index=True)
            for one, mine in zip(numbers.tolist(), np.split(held, starts[1:]), strict=True):
                words = self.ids[one]
                touched = np.zeros(len(words), bool)
                for i in range(n):
                    touched[place[mine] + i] = True
                if touched.sum() < coverage * len(words):
                    continue
                runs = diagonal_runs(ids, words, at, own, place[mine], hashes[mine], n)
                tiles = tile(runs, len(ids), len(words), n)
                total = sum(t[2] for t in tiles)
                if total >= coverage * len(words):
                    out.append((self.items[one][0], len(words), total, len(tiles)))
        return sorted(out)


def diagonal_runs(doc: np.ndarray, item: np.ndarray, at: np.ndarray, own: np.ndarray, place: np.ndarray, hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal matches (doc start, item start, length) from the document's windows (at, own) and the item's (place, hashes)."""
    order = np.argsort(hashes, kind="stable")
    place, hashes = place[order], hashes[order]
    low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
    some = high > low
    at, low, many = at[some], low[some], (high - low)[some]
    ends = np.cumsum(many)
    # Runs as (diagonal, first and last seed); seeds come by document place, so a run only grows at its end.
    diagonal, first, last = (np.zeros(0, np.int64) for _ in range(3))
    begin = 0
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        count = many[begin:stop]
        p = np.repeat(at[begin:stop], count)
        q = place[np.repeat(low[begin:stop] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        same = np.all([doc[p + i] == item[q + i] for i in range(n)], axis=0)
        p, q = p[same], q[same]
        diagonal, first, last = (np.concatenate(x) for x in ((diagonal, p - q), (first, p), (last, p)))
        by = np.lexsort((first, diagonal))
        diagonal, first, last = diagonal[by], first[by], last[by]
        if len(by):
            fresh = np.ones(len(by), bool)
            fresh[1:] = (diagonal[1:] != diagonal[:-1]) | (first[1:] > last[:-1] + 1)
            starts = np.flatnonzero(fresh)
            diagonal, first, last = diagonal[starts], first[starts], last[np.append(starts[1:], len(by)) - 1]
        begin = stop
    return list(zip(first.tolist(), (first - diagonal).tolist(), (last - first + n).tolist(), strict=True))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def whole(benchmark: DataFrame, block_bytes: int) -> list[tuple[int, str]] | None:
    """The items, or None where their text is more than block_bytes."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return None if size > block_bytes else [(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 for w in words), np.int64, len(words))


def _windows(frame: DataFrame, key: str, sizes: Callable[[int], set[int]]) -> DataFrame:
    """key, words in the window, its hash and its first word, for every window; a text's shorter windows are made where sizes says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _hashed(words_of(text))
                for n in sorted(sizes(len(words))):
                    h = rolling(words, n).view(np.int64)
                    if len(h):
                        h, at = np.unique(h, return_index=True) if key == "doc" else (h, np.arange(len(h)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(np.full(len(h), n, np.int32)), pa.array(h), pa.array(at.astype(np.int32)), pa.array(np.full(len(h), len(words), np.int32))], [key, "n", "hash", "place", "words"])

    return frame.mapInArrow(run, f"{key} long, n int, hash long, place int, words int")


def _met(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """doc (a key of the text), item_id, and both texts, for documents that hold enough of an item's seeds: the join of a large benchmark.

    A tile of MATCH words holds a seed, and seeds touch MATCH words each, so the
    items that a document may cover are among those with so many of their seeds
    in it. Equal texts meet an item once.
    """
    items = cut(_items(benchmark).groupBy("text").agg(F.collect_list("item_id").alias("item_ids")).withColumn("item", F.xxhash64("text")))
    seeds = _windows(items.select("item", "text"), "item", lambda many: {min(MATCH, many)} - {0})
    texts = id_and_text(docs).withColumn("doc", F.xxhash64("text"))
    own = _windows(texts.select("doc", "text"), "doc", lambda many: {n for n in range(1, MATCH + 1) if n <= many}).select("doc", "n", "hash").distinct()
    held = own.join(seeds, ["n", "hash"]).groupBy("doc", "item").agg(F.countDistinct("place").alias("seeds"), F.max("words").alias("words"), F.max("n").alias("n"))
    enough = cut(held.where(F.col("seeds") * F.col("n") >= F.lit(coverage) * F.col("words")).select("doc", "item"))
    return texts.join(enough, "doc").join(items.withColumnRenamed("text", "item_text"), "item")


SCHEMA = "doc_id long, item_id long, item_words long, tiled_words long, tiles long, coverage double"


_FIELDS = ["doc_id", "item_id", "item_words", "tiled_words", "tiles", "coverage"]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[3] / r[2] for r in rows], pa.float64())], _FIELDS)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for every document and item that it covers enough of."""
    items = whole(benchmark, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Benchmark(items)
        for batch in batches:
            yield _found([(d, *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for found in index.covers(t, coverage)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, one, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_text", "item_ids")), strict=True):
                rows += [(d, i, *found[1:]) for found in Benchmark([(0, one)]).covers(t, coverage) for i in ids]
            yield _found(rows)

    if items is not None:
        return id_and_text(docs).mapInArrow(run, SCHEMA)
    return _met(docs, benchmark, coverage).select("doc_id", "text", "item_text", "item_ids").mapInArrow(pairs, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that cover no item enough, with all their columns; a benchmark that fits needs no join."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    items = whole(benchmark, block_bytes)
    if items is None:
        names = [f"c{i}" for i in range(len(docs.columns))]
        plain = docs.toDF(*names)
        bad = contaminated_texts(docs, benchmark, coverage)
        kept = plain.withColumn("key", F.sha2(F.coalesce(F.col(names[at]), F.lit("")), 256)).join(bad, "key", "left_anti")
        return kept.select(*names).toDF(*docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Benchmark(items)
        for batch in batches:
            yield batch.filter(pa.array([not index.covers(t or "", coverage) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """key: the SHA-256 of every text that covers some item of a large benchmark enough."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [bool(Benchmark([(0, one)]).covers(t, coverage)) for t, one in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("text").filter(pa.array(bad, pa.bool_()))], ["text"])

    met = _met(docs, benchmark, coverage).select("text", "item_text").mapInArrow(judge, "text string")
    return met.select(F.sha2("text", 256).alias("key")).distinct()
