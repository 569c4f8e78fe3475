import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridsmith.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(tokenizer, texts):
    coder = packing.encoder(public_tokenizers.path(packing.RANKS))
    r = random.Random(1)
    bits = ["a", "B", " ", "  ", "\n", "'s", "'", ".", "é", "1", "\xa0", "\x1c", "\U0001f600", "\t", "　", "<|endoftext|>", "ß", "don't"]
    odd = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(800)]
    for t in [*odd, *(t or "" for _, t in texts)]:
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pieces_lie_gapless_and_hold_all_ids(documents, texts, tokenizer):
    rows = packing.pack(documents).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == 1 or all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(documents.limit(0)).count() == 0


def optimal(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    r = random.Random(2)
    for _ in range(150):
        items = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        fixed, left = packing.reduce_by_dominance(Counter(items), 20)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + optimal(rest, 20) == optimal(items, 20), items


def test_solutions_are_packings_near_the_bound():
    r = random.Random(3)
    counts = Counter(r.randint(1, 1024) for _ in range(5000))
    solution = packing.solve(counts)
    placed = Counter()
    for items, times in solution:
        assert sum(items) <= 1024
        for n in items:
            placed[n] += times
    assert placed == counts
    solved = sum(t for _, t in solution)
    assert solved <= 1.01 * lower_bound(counts, 1024) and solved <= sum(t for _, t in packing.best_fit(counts))


def lower_bound(counts, capacity):
    """Martello and Toth's L2."""
    items = sorted(counts.elements())
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(1 for n in items if n > capacity - k)
        large = [n for n in items if capacity / 2 < n <= capacity - k]
        small = sum(n for n in items if k <= n <= capacity / 2)
        best = max(best, alone + len(large) + max(0, math.ceil((small - len(large) * capacity + sum(large)) / capacity)))
    return best


def test_repeated_rows_and_clashing_columns_are_packed_each(spark, tokenizer):
    long = "one two three " * 900
    rows = [(1, long, 3), (1, long, 4), (None, "a", 5), (None, "a", 5), (2, None, 6)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece int")).collect()
    n = len(tokenizer.encode(long, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got if r.doc_id == 1) == 2 * n and sum(r.doc_id is None for r in got) == 2
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(set(places)) == len(places) == 2 * -(-n // 1024) + 3
