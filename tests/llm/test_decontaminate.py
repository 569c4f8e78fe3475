import random
import tracemalloc

import numpy as np

from gridsmith.llm import decontaminate as d


def plain_tiles(doc, item, least):
    """Greedy string tiling by definition: the longest unmarked common run, again and again."""
    a, b, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not a[p + n] and not b[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return sum(n for n, _, _ in tiles)
        tiles.append(best)
        for i in range(n):
            a[p + i] = b[q + i] = True


def test_reordered_passages_are_found_and_others_left(spark):
    r = random.Random(1)
    say = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    item = say(40)
    swapped = say(30) + item[20:] + say(9) + item[:20] + say(30)
    part = say(50) + item[:12] + say(50)
    docs = spark.createDataFrame([(1, " ".join(swapped)), (2, " ".join(part)), (3, None), (4, ""), (5, "A, " + " -- ".join(item).upper() + "!"), (6, "tiny"), (6, "tiny")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "Tiny."), (10, "...")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.tiled_words, x.tiles) for x in d.contaminated(docs, bench).collect()}
    assert got == {(1, 7): (40, 2), (5, 7): (40, 1), (6, 9): (1, 1)}
    assert d.contaminated(docs, bench).count() == 4
    assert sorted(x.doc_id for x in d.drop_contaminated(docs, bench).collect()) == [2, 3, 4]
    joined = {(x.doc_id, x.item_id): (x.tiled_words, x.tiles) for x in d.contaminated(docs, bench, block_bytes=0).collect()}
    assert joined == got and d.contaminated(docs, bench, block_bytes=0).count() == 4
    assert sorted(x.doc_id for x in d.drop_contaminated(docs, bench, block_bytes=0).collect()) == [2, 3, 4]
    assert d.contaminated(docs.limit(0), bench).count() == d.contaminated(docs, bench.limit(0)).count() == 0


def test_tiling_is_that_of_the_definition(monkeypatch):
    monkeypatch.setattr(d, "PAIRS", 7)
    r = random.Random(5)
    for _ in range(80):
        doc, item = ([r.choice("abc") for _ in range(r.randrange(5, 40))] for _ in range(2))
        index = d.Benchmark([(1, " ".join(item))], match=3)
        found = index.covers(" ".join(doc), 0.0)
        assert (found[0][2] if found else 0) == plain_tiles(doc, item, 3)


def test_texts_that_repeat_themselves_cost_no_product():
    item, doc = "la " * 2_000, "la " * 20_000
    tracemalloc.start()
    found = d.Benchmark([(1, item)]).covers(doc + "end", 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(1, 2000, 2000, 1)] and peak < 200 << 20


def test_clashing_columns_and_repeated_items(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, "other words here", 6, "y"), (None, text, 7, "z")], "doc_id long, text string, item_id int, key string")
    bench = spark.createDataFrame([(4, text), (4, text), (9, None)], "item_id long, text string")
    for block in (d.BLOCK_BYTES, 0):
        assert sorted((x.doc_id or 0, x.item_id) for x in d.contaminated(docs, bench, block_bytes=block).collect()) == [(0, 4), (0, 4), (1, 4), (1, 4)]
        kept = d.drop_contaminated(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and [tuple(x) for x in kept.collect()] == [(2, "other words here", 6, "y")]


def test_marked_words_are_not_used_twice():
    tiles = d.tile([(0, 0, 10), (5, 5, 10), (20, 0, 6)], 40, 20, 3)
    used = np.zeros(20, int)
    for _, q, n in tiles:
        used[q : q + n] += 1
    assert used.max() == 1
