import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gridsmith.llm import queries, suffixes


def plain(rows):
    """Every window in order, by definition."""
    seen, out = {}, []
    texts = [(-math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - 99):
            seen[b[p : p + 100]] = min((i, p), seen.get(b[p : p + 100], (i, p)))
    for (i, b), (doc_id, _) in zip(texts, rows, strict=True):
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if seen[b[p : p + 100]] < (i, p):
                mask[p : p + 100] = True
        out.append((doc_id, len(b), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    return sorted(out, key=str)


def removed(frame):
    return sorted((tuple(r) for r in suffixes.remove_repeats(frame).collect()), key=str)


def test_removed_bytes_are_those_of_the_definition(documents, texts):
    assert removed(documents) == plain(texts)


def test_texts_longer_than_a_chunk(spark):
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(400_000))
    at = suffixes.CHUNK - 150
    assert len(long) > 1.4 * suffixes.CHUNK
    rows = [(1, long), (2, long[at : at + 300]), (3, "z" + long[at + 50 : at + 2000] + "y"), (4, long[-120:]), (5, "q" * 3000)]
    got = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans) for i in range(1, 6)] == [(len(long), 0, 0), (300, 300, 1), (1952, 1950, 1), (120, 120, 1), (3000, 2999, 1)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_a_gram_in_very_many_surroundings(hot):
    """A passage of 60 bytes, too short to repeat, stands in every text, and some share more around it."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, beside = word(60), [word(45) for _ in range(4)]
    rows = [(i, word(r.randint(0, 80)) + r.choice(beside) + passage + r.choice(beside) + word(r.randint(0, 80))) for i in range(300)]
    assert local(rows, hot) == plain(rows)


def local(rows, hot=4096, parts=4, buckets=3):
    """The stages without Spark."""
    keys = list(range(buckets))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffixes, "HOT", hot)
        patch.setattr(suffixes, "DENSE", 500)
        frame = lambda k: pa.table({"doc_id": [suffixes.NO_ID if i is None else i for i, _ in rows if hash(i) % parts == k], "text": [t or "" for i, t in rows if hash(i) % parts == k], "part": [k for i, _ in rows if hash(i) % parts == k]})
        split = lambda tables, by: [t.filter(pc.equal(t[by], k)) for t in [pa.concat_tables(tables)] for k in sorted(set(t[by].to_pylist()))]
        texts = [t for k in range(parts) if (t := frame(k)).num_rows]
        answers = pa.concat_tables([suffixes._answer(t) for t in split([suffixes._ask(keys)(t) for t in texts], "bucket")])
        mine = lambda t, table: table.filter(pc.equal(table["part"], t["part"][0]))
        shipped = [suffixes._ship(keys)(t, mine(t, answers)) for t in texts]
        removed = pa.concat_tables([suffixes._meet(t) for t in split(shipped, "bucket")])
        return sorted((tuple(r.values()) for t in texts for r in suffixes._report(t, mine(t, removed)).to_pylist()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_any_texts_by_definition(seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("ab\0é") for _ in range(r.choice([3, 60, 150, 400]))) for _ in range(8)]
    rows = [(r.choice([None, *range(40)]), "".join(r.choice(pool) for _ in range(r.randint(0, 5)))) for _ in range(60)]
    assert local(rows, r.choice([1, 4096])) == plain(rows)


def test_rows_of_one_id(spark, documents):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(150)
    rows = [(1, word(30) + passage), (1, word(170) + passage + word(50)), (1, word(20)), (2, "x" + passage), (3, word(90) + passage[10:130]), (None, "abc"), (None, passage), (7, passage), (7, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(frame) == plain(rows)
    assert suffixes.remove_repeats(documents.limit(0)).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 5, 8])
def test_levels_keep_the_earliest_of_equals(batches):
    rng = np.random.default_rng(batches)
    text = np.array([f"{k:02d}".encode() * 60 for k in rng.integers(0, 20, 200)], "S168")
    doc = rng.permutation(200).astype(np.int64)
    zero = np.zeros(200, np.int64)
    family = suffixes.Levels()
    for part in np.array_split(np.arange(200), batches):
        family.add(suffixes.Suffixes(text, zero + 21, doc, zero, zero, zero, zero).take(part))
    assert [x is not None for x in family.levels] == [bool(batches >> k & 1) for k in range(batches.bit_length())]
    for level in family.levels:
        assert level is None or (level.text[:-1] < level.text[1:]).all()
    left, gone = family.close(), family.removed()
    assert dict(zip(left.text.tolist(), left.doc.tolist(), strict=True)) == {k: int(doc[text == k].min()) for k in np.unique(text).tolist()}
    assert len(gone) + len(left) == 200


def test_op1_gives_its_sql_rows(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = duck.sql(queries.SQL["op1_suffix_dedup"])
    got = queries.QUERIES["op1_suffix_dedup"](spark, sf_dir)
    assert [c[0] for c in found.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(found.fetchall())
