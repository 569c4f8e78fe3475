"""Language-model scores from a weighted backoff automaton.

The model is a smoothed n-gram model of ORDER words over words and one end
token. Every history of up to ORDER - 1 words that the training tokens hold is
a state of the automaton, however rare it is, so the states grow with the
corpus; the root state stands for the empty history. A state h has an arc for
every word w seen after it, of weight log10(LAMBDA * c(h, w) / c(h) +
(1 - LAMBDA) * p(w | h')), where h' is h without its first word, and a failure
arc to h' that costs log10(1 - LAMBDA). The root's arcs are the smoothed
unigrams, and every state's probabilities sum to one.

A text is traversed once from left to right. The state after a word is the
longest history that ends there and was seen; from there the traversal follows
failure arcs, longest history first, until a state has an arc for the next word,
adding the weights up. Words and histories are numbers of 64 bits.

Counts cover all training documents and are never cut off. Documents are dealt
out in parts by a hash of their id. A part sends its distinct n-grams to buckets
by ranges of these numbers, with their training counts; a bucket adds up what
all parts sent and answers each part in the order it asked, and whether other
parts hold the n-gram too. Words and pairs are asked for first. A longer n-gram
is asked for only where others hold both of its shorter ones: else no other part
holds it, and the part's own count is the corpus's. So no table of words or
n-grams is ever broadcast or collected, and a frequent one costs one entry a
part. Every part asks every bucket, and adds N and V up from the buckets' shares
of them. Parts and buckets are as many as the measured size of the texts asks
for. The words of a part are taken anew for each exchange and for the scores:
that costs less than keeping them between the shuffles.

Defined results: a null text counts as empty and scores its end token alone;
texts of any length are scored whole (see `words`); repeated rows are counted
and scored one by one; a null doc_id is a training row; an empty table gives no
rows. Without training tokens all tokens are unknown. Further columns are
ignored.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import bucket_of, buckets_and_parts, id_and_text, part_of
from gridsmith.llm.words import planes, ranges, steps, stir, unplanes, unsteps, word_numbers

ORDER = 3
LAMBDA = 0.5
#: N-grams of up to so many tokens are asked for at once; each longer kind has an exchange of its own.
FIRST = 2
FAIL = float(np.log10(1 - LAMBDA))
#: The end token's number; words have hashes.
END = np.uint64(0)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Part:
    """A part's tokens in turn, and its distinct n-grams: index[k] tells which of table[k] ends at a token, for those with k tokens before them (at[k])."""

    def __init__(self, texts: list[str], held: list[bool]):
        many, word = word_numbers(texts)
        self.size = many + 1
        ends = np.cumsum(self.size)
        token = np.full(int(self.size.sum()), END)
        inner = np.ones(len(token), bool)
        inner[ends - 1] = False
        token[inner] = word
        # Four bytes a place: a part's tokens are far fewer than 2^31.
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)
        self.train = ~np.array(held, bool)[self.doc]
        place = np.arange(len(token)) - np.repeat(ends - self.size, self.size)
        self.at, self.table, self.index = [], [], []
        number = stir(token.copy())
        for k in range(ORDER):
            if k:
                longer = np.zeros(len(token), np.uint64)
                longer[1:] = stir(number[:-1] * _A + token[1:] * _B + np.uint64(k))
                number = longer
            at = np.flatnonzero(place >= k).astype(np.int32)
            table, index = np.unique(number[at], return_inverse=True)
            self.at.append(at)
            self.table.append(table)
            self.index.append(index.astype(np.int32))

    def counts(self) -> list[np.ndarray]:
        """The part's own training counts of each table."""
        return [np.bincount(index[self.train[at]], minlength=len(table)) for at, table, index in zip(self.at, self.table, self.index, strict=True)]

    def needed(self, k: int, shared: np.ndarray) -> np.ndarray:
        """Which n-grams of table[k] other parts may hold too: those of whose shorter ones, of table[k - 1], others hold both."""
        held = np.zeros(len(self.doc), bool)
        held[self.at[k - 1]] = shared[self.index[k - 1]]
        at = self.at[k]
        out = np.zeros(len(self.table[k]), bool)
        out[self.index[k][held[at] & held[at - 1]]] = True
        return out

    def requests(self, part: int, keys: list[int], orders: dict[int, np.ndarray]) -> list[tuple]:
        """A row for each bucket: for every order given its distinct n-grams, those that the flags choose, and their training counts. Only a bucket of words must be asked in any case."""
        counts = self.counts()
        rows: list[tuple] = [(key, part, [], [], []) for key in keys]
        empty = np.ones(len(keys), bool)
        for k, chosen in orders.items():
            table, count = self.table[k][chosen], counts[k][chosen]
            for b, s in enumerate(ranges(table, len(keys))):
                empty[b] &= s.stop == s.start and k > 0
                for column, value in zip(rows[b][2:], (k, steps(table[s]), planes(count[s])), strict=True):
                    column.append(value)
        return [row for row, none in zip(rows, empty.tolist(), strict=True) if not none]


def total_requests(rows: list[tuple]) -> list[tuple]:
    """One bucket's requests of all parts, added up: answers for each part in its own order, counts and which n-grams others hold too, with the bucket's share of N and V."""
    answers: list[tuple] = [(row[1], row[0], row[2], [], []) for row in rows]
    n = v = 0
    for at, k in enumerate(rows[0][2]):
        grams = [unsteps(row[3][at]) for row in rows]
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unplanes(row[4][at]) for row in rows]), len(distinct)).astype(np.int64)
        shared = np.bincount(inverse, minlength=len(distinct)) > 1
        if k == 0:
            n, v = int(total.sum()), int((total > 0).sum())
        ends = np.cumsum([len(g) for g in grams]).tolist()
        for answer, some, end in zip(answers, grams, ends, strict=True):
            mine = inverse[end - len(some) : end]
            answer[3].append(planes(total[mine]))
            answer[4].append(_bits(shared[mine]))
    return [(*answer, n, v) for answer in answers]


def _bits(flags: np.ndarray) -> bytes:
    return struct.pack("<I", len(flags)) + np.packbits(flags).tobytes()


def _flags(blob: bytes) -> np.ndarray:
    many = struct.unpack("<I", blob[:4])[0]
    return np.unpackbits(np.frombuffer(blob, "u1", offset=4), count=many).astype(bool)


class Told:
    """What the buckets answered a part: counts (where they were sent along) and flags by order, in the order of its requests."""

    def __init__(self, answers: pa.Table, keys: list[int]):
        place = {key: b for b, key in enumerate(keys)}
        rows = sorted(answers.to_pylist(), key=lambda r: (r["orders"], place[r["bucket"]]))
        parts: dict[int, tuple[list, list]] = {}
        for r in rows:
            for at, k in enumerate(r["orders"]):
                count, shared = parts.setdefault(k, ([], []))
                if "counts" in r:
                    count.append(unplanes(r["counts"][at]).astype(np.int64))
                shared.append(_flags(r["shared"][at]))
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        none = (np.zeros(0, np.int64), np.zeros(0, bool))
        self.count = defaultdict(lambda: none[0], {k: whole(c, np.int64) for k, (c, _) in parts.items()})
        self.shared = defaultdict(lambda: none[1], {k: whole(f, bool) for k, (_, f) in parts.items()})
        self.n, self.v = (sum(r.get(c, 0) for r in rows) for c in ("n", "v"))

    def counts(self, part: Part) -> list[np.ndarray]:
        """Corpus counts of the part's tables: answered, or the part's own where no other holds the n-gram."""
        out = []
        shared = None
        for k, own in enumerate(part.counts()):
            count, flags = own.copy(), np.zeros(len(own), bool)
            asked = np.ones(len(own), bool) if k < FIRST else part.needed(k, shared)
            count[asked], flags[asked] = self.count[k], self.shared[k]
            out.append(count)
            shared = flags
        return out

    def flags(self, part: Part, k: int) -> np.ndarray:
        """Which n-grams of table[k] other parts hold too."""
        asked = np.ones(len(part.table[k]), bool) if k < FIRST else part.needed(k, self.flags(part, k - 1))
        out = np.zeros(len(asked), bool)
        out[asked] = self.shared[k]
        return out


class Automaton:
    """The model as far as a part's tokens reach: count[k] is the corpus count of the n-gram of k + 1 tokens that ends at a token, 0 where the text is too short for it."""

    def __init__(self, part: Part, counts: list[np.ndarray], n: int, v: int):
        self.count = np.zeros((ORDER, len(part.doc)), np.int64)
        for k, (at, index) in enumerate(zip(part.at, part.index, strict=True)):
            self.count[k, at] = counts[k][index]
        self.root = np.log10((self.count[0] + 0.1) / (n + 0.1 * (v + 1)))
        # The state that a token is read in: how many tokens of history it holds, and how often each was seen.
        self.seen = np.zeros((ORDER, len(part.doc)), np.int64)
        for k in range(1, ORDER):
            inside = part.at[k]
            self.seen[k, inside] = self.count[k - 1, inside - 1]
        self.state = (self.seen > 0).sum(0)

    def walk(self) -> np.ndarray:
        """Every token's weight: failure arcs from its state down to one that has an arc for it, and that arc."""
        lower = 10.0**self.root
        arcs = [self.root]
        for k in range(1, ORDER):
            # p(w | h) for histories of k tokens; where h was not seen it is that of the next shorter one.
            share = self.count[k] / np.maximum(self.seen[k], 1)
            lower = np.where(self.seen[k] > 0, LAMBDA * share + (1 - LAMBDA) * lower, lower)
            arcs.append(np.log10(lower))
        weight = np.zeros(len(self.root))
        left = np.ones(len(self.root), bool)
        for k in range(ORDER - 1, 0, -1):
            here = left & (self.state >= k)
            arc = here & (self.count[k] > 0)
            weight[arc] += arcs[k][arc]
            weight[here & ~arc] += FAIL
            left &= ~arc
        weight[left] += self.root[left]
        return weight


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_INTS, _BLOBS = pa.list_(pa.int32()), pa.list_(pa.binary())
_ASKED = [("bucket", pa.int32()), ("part", pa.int32()), ("orders", _INTS), ("grams", _BLOBS), ("many", _BLOBS)]
_ANSWERED = [("part", pa.int32()), ("bucket", pa.int32()), ("orders", _INTS), ("counts", _BLOBS), ("shared", _BLOBS), ("n", pa.int64()), ("v", pa.int64())]
#: Bytes of text of a part; its n-grams take some twenty times as much while they are sorted.
PART_BYTES = 24 << 20


def _schema(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", _INTS: "array<int>", _BLOBS: "array<binary>"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in fields)


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(fields)})


def score_documents(docs: DataFrame) -> DataFrame:
    """The rows that op2 returns."""
    frame = id_and_text(docs)
    keys, width = buckets_and_parts(frame, PART_BYTES, 1)
    held = F.coalesce(bucket_of(F.col("doc_id"), 10) == 0, F.lit(False))
    parts = frame.withColumn("held_out", held).withColumn("part", part_of(width))
    texts_of = lambda group: Part(group.column("text").to_pylist(), group.column("held_out").to_pylist())

    def ask(group: pa.Table) -> pa.Table:
        part = texts_of(group)
        return _table(part.requests(group.column("part")[0].as_py(), keys, {k: np.ones(len(part.table[k]), bool) for k in range(FIRST)}), _ASKED)

    def ask_longer(k: int):
        def run(group: pa.Table, answers: pa.Table) -> pa.Table:
            part, told = texts_of(group), Told(answers, keys)
            return _table(part.requests(group.column("part")[0].as_py(), keys, {k: part.needed(k, told.flags(part, k - 1))}), _ASKED)

        return run

    def answer(group: pa.Table) -> pa.Table:
        rows = group.select([name for name, _ in _ASKED]).to_pylist()
        return _table(total_requests([tuple(r.values()) for r in rows]), _ANSWERED)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part, told = texts_of(texts), Told(answers, keys)
        model = Automaton(part, told.counts(part), told.n, told.v)
        many = len(part.size)
        columns = [
            texts.column("doc_id"),
            texts.column("held_out"),
            pa.array(part.size),
            pa.array(np.bincount(part.doc, model.count[0] > 0, many).astype(np.int64)),
            pa.array(np.full(many, told.n, np.int64)),
            pa.array(np.bincount(part.doc, model.root, many)),
            pa.array(np.bincount(part.doc, model.walk(), many)),
        ]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    total = lambda asked: asked.groupBy("bucket").applyInArrow(answer, _schema(_ANSWERED))
    answers = total(parts.groupBy("part").applyInArrow(ask, _schema(_ASKED)))
    for k in range(FIRST, ORDER):
        # Only the flags travel for this.
        flags = answers.select("part", "bucket", "orders", "shared")
        longer = parts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(ask_longer(k), _schema(_ASKED))
        answers = answers.unionByName(total(longer))
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, SCORES)
