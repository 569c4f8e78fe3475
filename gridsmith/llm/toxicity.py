"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a seed lexicon and of a lexicon learned from
the training rows (plainly written and with obfuscation undone), how often a
second person stands near a lexicon word, capitals, punctuation and digits,
obfuscation rates, and size. Trees are fitted on the logistic loss over
quantile bins; folds out of sight of the trees calibrate their sum by isotonic
regression. A training row's features always come from a lexicon learned
without its fold, as a new document's do, so the trees, the calibration and the
scores see features of one kind.

The fit uses at most SAMPLE labelled rows, drawn by a hash of the id (a
documented bound for the classifier alone); every document is scored.

Defined results: a null text counts as empty and gets a score like any other;
so do very long texts, which are taken whole;
rows with a null label are not learned from; labels repeated for one id count
once (toxic if any says so). Without labelled rows of both classes the score is
the share of toxic training rows (0 if there are none). Repeated document rows
give a row each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import bucket_of, cut, id_and_text, small_batches

SAMPLE = 12_000
FOLDS = 3
#: So many rows of mean toxicity weigh against the labelled rows in the calibration.
DRAWN = 2.0
THRESHOLD = 0.3
#: Log-odds of a word of the learned lexicon, chosen on the training rows' folds.
ODDS = 3.0

#: The seed lexicon, and second persons in the corpus's languages.
LEXICON = "idiot idiots moron morons stupid dumb fool fools loser losers pathetic worthless scum trash garbage clown clowns jerk creep pig liar ugly disgusting hate kill die shut crap damn hell bastard imbecile cretin dimwit twit freak filthy vile parasite coward".split()
SECOND = "you your yours yourself u ur ya tu te toi vous votre vos du dich dir dein deine ihr euch tú usted ustedes tus ti vosotros".split()
LEET = [str.maketrans("01345@$!+|*-", "o" + one + "easasiti__") for one in "il"]
EDGES = ".,;:?!()\"'[]{}<>*-_«»"
SPACED = re.compile(r"(?<!\w)(?:\w[ .*_-]){3,60}\w(?!\w)")
MIXED = re.compile(r"[A-Za-z][0-9@$!*|+]+[A-Za-z]")
SIGN = re.compile(r"[0-9@$!*|+]")
DOTTED = re.compile(r"\w[.*_-]\w[.*_-]\w[.*_-]\w")
REPEAT = re.compile(r"([^\W\d_])\1{2,}")


def plain_words(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def unmasked(word: str) -> set[str]:
    """What a word reads as with look-alike digits and signs taken for letters, marks dropped and tripled letters made single."""
    return {REPEAT.sub(r"\1", re.sub(r"[\W_]", "", word.translate(table))) for table in LEET} - {word}


def features(text: str, learned: frozenset[str]) -> list[float]:
    """The features of a text, with a learned lexicon beside the seed."""
    words = plain_words(text)
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    # The slower patterns run only on texts that can match them.
    code = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    tripled = bool(((code[2:] == code[1:-1]) & (code[1:-1] == code[:-2])).any())
    odd = [w for w in counts if not w.isalpha() and len(w) > 2]
    long = [w for w in counts if w.isalpha() and REPEAT.search(w)] if tripled else []
    reads = [(counts[w], unmasked(w)) for w in [*odd, *long]]
    single = sum(c for w, c in counts.items() if len(w) == 1) > 3 or any(len(w) > 6 and DOTTED.search(w) for w in odd)
    # A word of one letter may stand before or after the letters of a spaced one.
    spaced = [{u, u[1:], u[:-1], u[1:-1]} for m in (SPACED.findall(text) if single else []) if (u := re.sub(r"[\W_]", "", m).lower())]
    hits = sum(counts[w] for w in _SEED if w in counts)
    second = np.array([i for i, w in enumerate(words) if w in _SECOND] or [-(10**9)])
    signs = SIGN.search(text) is not None
    plain = [
        sum(counts[w] for w in _SECOND if w in counts) / n, sum(1 for w in text.split() if len(w) > 2 and w.isupper()) / n,
        text.count("!") / size, text.count("?") / size, text.count("*") / size, (len(MIXED.findall(text)) if signs else 0) / n,
    ]
    bad = _SEED | learned
    kinds = [w for w in counts if w in bad]
    own = sum(counts[w] for w in kinds if w in learned)
    near = 0
    if kinds:
        marks = [i for i, w in enumerate(words) if w in bad]
        at = np.searchsorted(second, marks)
        after, before = second[np.minimum(at, len(second) - 1)], second[np.maximum(at - 1, 0)]
        near = int(((np.abs(after - marks) <= 4) | (np.abs(before - marks) <= 4)).sum())
    masked = sum(c for c, u in reads if not u.isdisjoint(bad))
    apart = sum(1 for u in spaced if not u.isdisjoint(bad))
    lexical = [hits / n, own / n, min(hits, 20.0), min(own, 20.0), min(len(kinds), 20.0), near / n, min(near, 20.0)]
    return [*lexical, *plain, min(masked, 20.0), min(apart, 20.0), len(spaced) / n, float(np.log1p(n))]


_SEED, _SECOND = frozenset(LEXICON), frozenset(SECOND)


@dataclass
class Boosted:
    """Depth-limited trees over binned features; each tree is (feature, cut, left or leaf) arrays in heap order."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.15
    bins: int = 32
    least: float = 4.0
    prior: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.prior, self.trees = float(np.log(share / (1 - share))), []
        z = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(binned, p - y, p * (1 - p), cuts)
            self.trees.append(tree)
            z += self._run(tree, x)
        return self

    def _grow(self, binned, g, h, cuts):
        """A level at a time: one histogram over all of its nodes, features and bins."""
        size, wide, many = 2 ** (self.depth + 1) - 1, self.bins + 1, len(cuts)
        feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        columns = np.arange(many) * wide + binned
        for level in range(self.depth + 1):
            first, nodes = 2**level - 1, 2**level
            here = np.flatnonzero((node >= first) & (node < first + nodes))
            slot = node[here] - first
            total_g, total_h = np.bincount(slot, g[here], nodes), np.bincount(slot, h[here], nodes)
            leaf[first : first + nodes] = -self.rate * total_g / (total_h + 1)
            if level == self.depth or not len(here):
                continue
            index = (slot[:, None] * (many * wide) + columns[here]).ravel()
            shape = (nodes, many, wide)
            gl = np.bincount(index, np.repeat(g[here], many), nodes * many * wide).reshape(shape).cumsum(2)
            hl = np.bincount(index, np.repeat(h[here], many), nodes * many * wide).reshape(shape).cumsum(2)
            g_all, h_all = total_g[:, None, None], total_h[:, None, None]
            gain = gl**2 / (hl + 1) + (g_all - gl) ** 2 / (h_all - hl + 1) - g_all**2 / (h_all + 1)
            gain[(hl < self.least / 4) | (h_all - hl < self.least / 4)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            j, k = best // wide, best % wide
            split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            for n in np.flatnonzero(split):
                feature[first + n], cut[first + n] = j[n], cuts[j[n]][k[n]]
            rows = here[split[slot]]
            at = node[rows] - first
            node[rows] = np.where(binned[rows, j[at]] <= k[at], 2 * node[rows] + 1, 2 * node[rows] + 2)
        return feature, cut, leaf

    def _run(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(go, 2 * node + 1 + right, node)
        return leaf[node]

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((self._run(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: steps (score, probability), both rising. All are drawn to the mean by one share, which keeps their order."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(s), float(v), 1.0])
        while len(blocks) > 1 and (blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]):
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    share = DRAWN / (len(y) + DRAWN)
    return np.array([b[0] for b in blocks]), np.array([(1 - share) * b[1] / b[2] + share * float(y.mean()) for b in blocks])


@dataclass
class ToxicModel:
    learned: frozenset
    trees: Boosted | None
    steps: tuple | None
    share: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        z = self.trees.decide(np.array([features(t, self.learned) for t in texts]))
        return self.calibrated(z)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        """The pool's probability; within a pool the trees' sum still orders, by a small amount. Both rise with z, so their sum does."""
        at, p = self.steps
        return (p[np.clip(np.searchsorted(at, z, side="right") - 1, 0, None)] + 1e-6 / (1 + np.exp(-z))) / (1 + 1e-6)


def lexicon(counts: list[tuple[str, list[int], list[int]]], n_toxic: list[int], n_clean: list[int], without: int | None = None) -> frozenset[str]:
    """All words that toxic rows hold far more often than others do, by smoothed log-odds; one fold's rows may be left out."""
    keep = [k for k in range(len(n_toxic)) if k != without]
    n1, n0 = sum(n_toxic[k] for k in keep), sum(n_clean[k] for k in keep)
    found = set()
    for word, toxic, clean in counts:
        c1, c0 = sum(toxic[k] for k in keep), sum(clean[k] for k in keep)
        if c1 >= max(3, 0.005 * n1) and np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)) > ODDS:
            found.add(word)
    return frozenset(found)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, words: frozenset[str]) -> ToxicModel:
    """x holds each row's features under the lexicon without its fold; words is the whole lexicon."""
    share = float(y.mean()) if len(y) else 0.0
    if len(y) < 2 * FOLDS or y.min() == y.max():
        return ToxicModel(frozenset(), None, None, share)
    held = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        held[~rest] = Boosted().fit(x[rest], y[rest]).decide(x[~rest]) if rest.any() else 0.0
    return ToxicModel(words, Boosted().fit(x, y), isotonic(held, y), share)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Fits on at most `sample` labelled rows whose crc32(doc_id) mod 4 is not 2, those with the smallest hashes.

    Words are counted and features made on the executors; the driver gets the
    sample's features and the words that may enter the lexicon.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 4) != 2))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The drawn ids are at most `sample` rows of 12 bytes: that bounds what is broadcast.
    rows = cut(id_and_text(docs).join(F.broadcast(drawn), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((w, f, t) for text, f, t in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic")), strict=True) for w in {"", *plain_words(text)} if len(w) != 1)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array(list(seen.values()), pa.int64())], ["word", "fold", "toxic", "n"])

    of = lambda f, t: F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0))
    counted = rows.select("text", "fold", "toxic").mapInArrow(words, "word string, fold int, toxic int, n long").groupBy("word").agg(F.array(*[of(f, 1) for f in range(FOLDS)]).alias("t"), F.array(*[of(f, 0) for f in range(FOLDS)]).alias("c"), F.sum(F.col("n") * F.col("toxic")).alias("all_t"))
    # Words too rare among toxic rows for any fold's lexicon stay behind; those that come are bounded by the sample.
    found = [(r["word"], list(r["t"]), list(r["c"])) for r in counted.where((F.col("word") == "") | (F.col("all_t") >= 3)).collect()]
    (_, n_toxic, n_clean), counts = next((x for x in found if x[0] == ""), ("", [0] * FOLDS, [0] * FOLDS)), [x for x in found if x[0] != ""]
    lexicons = [lexicon(counts, n_toxic, n_clean, k) for k in [*range(FOLDS), None]]

    def all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t, lexicons[f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "fold", "toxic")] + [pa.array(values, pa.list_(pa.float64()))], ["doc_id", "fold", "toxic", "x"])

    got = sorted(rows.mapInArrow(all_features, "doc_id long, fold int, toxic int, x array<double>").toLocalIterator(), key=lambda r: (r["doc_id"], list(r["x"])))
    if not got:
        return ToxicModel(frozenset(), None, None, 0.0)
    x = np.array([r["x"] for r in got], float)
    return fit(x, np.array([r["toxic"] for r in got], float), np.array([r["fold"] for r in got], int), lexicons[-1])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def scores(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score and predicted, one row a document."""
    rows = id_and_text(docs).select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, SCHEMA)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that op10 returns."""
    return scores(docs, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below THRESHOLD, with all their columns: one pass, without a join back."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)
    schema = docs.schema
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(keep, schema)
