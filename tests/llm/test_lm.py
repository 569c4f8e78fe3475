import math
import re
import zlib
from collections import Counter

import numpy as np

from gridsmith.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


END = ""


class PlainAutomaton:
    """States with arcs and a failure arc each, walked a token at a time."""

    def __init__(self, training):
        self.c = Counter(tuple(w[i : i + k + 1]) for w in training for k in range(lm.ORDER) for i in range(len(w) - k))
        self.n = sum(c for g, c in self.c.items() if len(g) == 1)
        self.v = sum(len(g) == 1 for g in self.c)
        self.arcs = {(): {}}
        for g in sorted(self.c, key=len):
            self.arcs.setdefault(g[:-1], {})[g[-1]] = self.p(g[:-1], g[-1])

    def p(self, h, w):
        if not h:
            return (self.c[(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))
        return lm.LAMBDA * self.c[(*h, w)] / self.c[h] + (1 - lm.LAMBDA) * self.p(h[1:], w) if self.c[h] else self.p(h[1:], w)

    def walk(self, words):
        state, total = (), 0.0
        for w in words:
            at = state
            while at and w not in self.arcs[at]:
                total += math.log10(1 - lm.LAMBDA)
                at = at[1:]
            total += math.log10(self.arcs[at].get(w) or self.p((), w))
            state = (*state, w)[-lm.ORDER + 1 :]
            while state and state not in self.arcs:
                state = state[1:]
        return total


def plain(rows):
    words = [(i, [*WORD.findall(lower(t or "")), END]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    model = PlainAutomaton([w for i, w in words if not held(i)])
    return [(i, held(i), len(w), sum(model.c[(x,)] > 0 for x in w), model.n, sum(math.log10(model.p((), x)) for x in w), model.walk(w)) for i, w in words]


def test_scores_are_those_of_a_plain_traversal(documents, texts):
    got = sorted(tuple(r) for r in lm.score_documents(documents).collect())
    for a, b in zip(got, sorted(plain(texts)), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])


def test_every_state_is_a_distribution(texts):
    training = [t or "" for _, t in texts]
    vocabulary = sorted({w for t in training for w in WORD.findall(lower(t))})
    some = [w.split() for w in (lower(training[0]), lower(training[6]))]
    histories = [" ".join(x) for w in some for x in (w[:1], w[:2], w[1:3], ["unheard", w[0]])] + ["", "unheard"]
    for h in histories:
        probes = [f"{h} {w}" for w in vocabulary] + [h]
        part = lm.Part([*training, *probes], [False] * len(training) + [True] * len(probes))
        counts = part.counts()
        n, v = int(counts[0].sum()), int((counts[0] > 0).sum())
        model = lm.Automaton(part, counts, n, v)
        weight, ends = model.walk(), np.cumsum(part.size) - 1
        known = sum(10.0 ** weight[ends[len(training) + k] - (k < len(vocabulary))] for k in range(len(probes)))
        state = model.state[ends[-1]]
        assert math.isclose(known + (1 - lm.LAMBDA) ** state * 0.1 / (n + 0.1 * (v + 1)), 1.0), h


def test_repeated_rows_count_each_and_empty_tables_give_none(spark, documents):
    rows = [(1, "a b"), (1, "a b"), (None, "a")]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and {r.train_tokens for r in got} == {8}
    assert lm.score_documents(documents.limit(0)).count() == 0


def test_histories_of_any_rarity_are_states(spark):
    held = [i for i in range(600, 700) if zlib.crc32(str(i).encode()) % 10 == 0]
    filler = [(1000 + i, " ".join(f"f{i}x{j}" for j in range(200))) for i in range(60)]
    rows = [*filler, *((i, "zeta omega psi") for i in range(20)), (500, "zeta unseen omega psi"), (501, "zeta omega"), (held[0], "f3x7 f3x8 f3x9"), (held[1], "other f3x8 f3x9"), (None, "zeta psi")]
    want = plain(rows)
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for one in want:
        assert tuple(got[one[0]])[:5] == one[:5] and np.allclose(tuple(got[one[0]])[5:], one[5:], rtol=1e-12), one[0]
    rare = {i: s - b for i, *_, b, s in want}
    assert rare[held[0]] > rare[held[1]] + 1 > 2  # a history seen once tells


def test_a_very_long_text(spark):
    rows = [(1, "a b c " * 200_000), (2, "b c a"), (3, "x" * 1_500_000 + " b c")]
    got = {r.doc_id: tuple(r) for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for one in plain(rows):
        assert got[one[0]][:5] == one[:5] and np.allclose(got[one[0]][5:], one[5:], rtol=1e-9)
