import random
import zlib

import numpy as np

from gridsmith.llm import toxicity


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < 0.3)
        if toxic:
            for w in ("you", r.choice(["idiot", "1d10t", "zorgblat", "moron"]), "zorgblat"):
                text.insert(r.randrange(len(text)), w)
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, 9, 9.5) for i, t, _ in rows], "doc_id long, text string, predicted int, score double").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 5], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [(got[i].score, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(got[i].score >= 0.3) and 0 <= got[i].score <= 1 for i in got)
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in bad for b in good]) > 0.9
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_held_out_labels_change_nothing(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a, b = (spark.createDataFrame([(i, (1 - y) if flip and held(i) else y) for i, _, y in rows], "doc_id long, toxic int") for flip in (False, True))
    first, second = (sorted(map(tuple, toxicity.score_toxicity(docs, x).collect())) for x in (a, b))
    assert first == second


def test_edge_rows(spark, documents):
    labels = spark.createDataFrame([(0, None), (1, 1), (1, 0), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(documents, labels).collect()
    assert len(got) == documents.count() and {r.score for r in got} <= {0.5, 1.0, 0.0}
    assert toxicity.score_toxicity(documents, labels.limit(0)).first().score == 0.0
    assert toxicity.score_toxicity(documents.limit(0), labels).count() == 0


def plain_isotonic(y):
    """Least squares under a rising order, by the min-max formula."""
    sums = np.concatenate([[0.0], np.cumsum(y)])
    mean = lambda a, b: (sums[b] - sums[a]) / (b - a)
    n = len(y)
    return np.array([max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)])


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(1)
    for n in (12, 40, 90):
        s = rng.permutation(n).astype(float)
        y = (rng.random(n) < 1 / (1 + np.exp(3 - 6 * s / n))).astype(float)
        at, p = toxicity.isotonic(s, y)
        assert (np.diff(at) > 0).all() and (np.diff(p) > 0).all()
        order = np.argsort(s)
        steps = p[np.searchsorted(at, s[order], side="right") - 1]
        share = toxicity.DRAWN / (n + toxicity.DRAWN)
        assert np.allclose(steps, (1 - share) * plain_isotonic(y[order]) + share * y.mean())


def test_scores_never_fall_as_the_trees_sum_rises():
    rng = np.random.default_rng(2)
    for n in (50, 3000):
        s = rng.normal(size=n)
        model = toxicity.ToxicModel(frozenset(), None, toxicity.isotonic(s, (rng.random(n) < 0.2).astype(float)), 0.2)
        p = model.calibrated(np.sort(np.concatenate([s, rng.normal(scale=4, size=500)])))
        assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_trees_split_where_a_plain_search_does():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (120, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(120) < 0.1)).astype(float)
    tree = toxicity.Boosted(depth=1, rounds=1).fit(x, y)
    feature, cut, leaf = tree.trees[0]
    p = y.mean()
    g, h = p - y, np.full(120, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(x[:, j] <= c), j, c) for j in range(3) for c in range(8))
    assert (feature[0], np.sum(x[:, feature[0]] <= cut[0])) == (best[1], np.sum(x[:, best[1]] <= best[2]))
    left = x[:, best[1]] <= best[2]
    assert np.allclose(leaf[1:3], [-0.15 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_a_very_long_text_is_taken_whole(spark):
    docs = spark.createDataFrame([(i, "fine words here " * (40_000 if i == 1 else 2) + ("you idiot" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == 40 and all(0 <= s <= 1 for s in got.values()) and min(got[i] for i in range(3, 40, 2)) > max(got[i] for i in range(0, 40, 2))


def test_obfuscations_are_read():
    assert "idiot" in toxicity.unmasked("1d10t") and "loser" in toxicity.unmasked("l0ser") and "stupid" in toxicity.unmasked("stuuuupid")
    plain = toxicity.features("word " * 20, frozenset())
    for text in ("you are an 1d10t", "you m.o.r.o.n go", "such a m o r o n here"):
        assert toxicity.features(text, frozenset()) != plain and max(toxicity.features(text, frozenset())[13:15]) >= 1
