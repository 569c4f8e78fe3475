import random
import re

import duckdb
import numpy as np
import pytest

from gridsmith.llm import graph, jaccard, queries, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(n, edits, words=60, seed=1):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        one = list(base)
        for _ in range(r.randint(0, edits)):
            one[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(one))
    return out


def test_components_are_those_of_all_pairs(documents, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents).collect()}
    assert got == plain(texts)


@pytest.mark.parametrize("block", [(4_000_000, 4_000_000), (500, 900), (300, 1_000_000)])
def test_groups_of_near_copies_chains_and_common_passages(spark, block):
    r = random.Random(2)
    common = " ".join(f"c{i}" for i in range(40))
    rows = copies(25, 3) + copies(12, 2, 30, 3) + [common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(2, 90))) for _ in range(30)]
    chain = [f"k{i}" for i in range(80)]
    for i in range(6):
        rows.append(" ".join(chain))
        chain = chain[5:] + [f"n{i}{j}" for j in range(5)]
    rows += rows[:3]
    docs = [(1000 - i, t) for i, t in enumerate(rows)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(frame, block).collect()}
    assert got == plain(docs)


def test_copies_in_descending_order_in_one_task_keep_their_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:59], "other"]
    docs = [(5, " ".join(base)), (7, " ".join(near)), (3, " ".join(base)), (6, " ".join(near)), (9, "something else"), (2, "something else")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(frame).collect()}
    assert got == plain(docs) and got[6][1] == 3
    assert {r.doc_id for r in jaccard.keep_one_of_each(frame).collect()} == {2, 3}


def test_prefixes_of_sets_that_link_share_one():
    rng = np.random.default_rng(1)
    for _ in range(400):
        universe = rng.permutation(400)
        n = int(rng.integers(5, 120))
        a = set(universe[:n].tolist())
        b = set(universe[int(rng.integers(0, 1 + n // 6)) : n + int(rng.integers(0, 1 + n // 6))].tolist())
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        heads = [set(sorted(x)[: int(jaccard.prefix_length(np.array(len(x))))]) for x in (a, b)]
        assert heads[0] & heads[1]


def test_repeated_rows_null_ids_and_keeping_one(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (9, None), (8, "")]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, None), (9, 0, 9), (8, 0, 8)], key=str)
    kept = jaccard.keep_one_of_each(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "8", "9", "None"]
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    n = 300
    order = np.random.default_rng(2).permutation(n)
    edges = [(int(order[i]), int(order[i + 1])) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.v: r.label for r in graph.components(frame).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 1001: 1000, 1002: 1000}
    assert graph.components(frame.limit(0)).count() == 0
    a, b = graph.forest(np.array([5, 9, 3]), np.array([3, 8, 1]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {3: 1, 5: 1, 9: 8}


def test_ties_grow_as_a_list_does_and_part_where_no_size_can_link():
    gram = np.repeat(np.array([5, 9], np.uint64), [6, 3])
    low = np.array([10, 12, 13, 40, 41, 90, 10, 10, 30])
    assert np.flatnonzero(jaccard._breaks(gram, low, low)).tolist() == [0, 3, 5, 6, 8]
    # A long run of sizes stands for all between its ends.
    assert np.flatnonzero(jaccard._breaks(gram[:3], np.array([10, 12, 40]), np.array([45, 12, 40]))).tolist() == [0]


def test_very_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 300)
    monkeypatch.setattr(words, "_POWERS", [])
    r = random.Random(4)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(2500))
    docs = [(9, long), (4, long.replace("w7 ", "other ")), (2, "y" * 2000), (3, "Y" * 2000 + "\n"), (6, "a " + "z" * 900 + " b c d e"), (5, None)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain(docs)


def test_words_have_equal_numbers_where_they_are_equal(texts, monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 64)
    monkeypatch.setattr(words, "_POWERS", [])
    some = [t or "" for _, t in texts]
    many, number = words.word_numbers(some)
    flat = [w for t in some for w in t.encode().lower().split()]
    assert many.tolist() == [len(t.encode().lower().split()) for t in some]
    assert len(set(zip(flat, number.tolist(), strict=True))) == len(set(flat)) == len(set(number.tolist()))
    for a in ([], [0], [2**64 - 1], [3, 3, 2**40]):
        assert words.unsteps(words.steps(np.array(a, np.uint64))).tolist() == a


def test_rows_of_one_id_with_different_texts_are_one_document(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    rows = [(8, one), (8, two), (3, one), (5, two), (6, "none of these")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame).collect()} == {(8, 3), (3, 3), (5, 3), (6, 6)}
    again = spark.createDataFrame([(1, "x"), (1, "longer text"), (1, None)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.keep_one_of_each(again).collect()] == [(1, "longer text")]


def test_op8_gives_its_sql_rows(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = duck.sql(queries.SQL["op8_jaccard_join"])
    got = queries.QUERIES["op8_jaccard_join"](spark, sf_dir)
    assert [c[0] for c in found.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(found.fetchall())
