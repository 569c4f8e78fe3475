"""N-gram Jaccard join by a blocked sparse product of documents and n-grams.

1. Documents are dealt to parts by a hash of their id. A part asks buckets of
   n-grams how many distinct sets hold each of its n-grams, all parts together;
   the answers order every n-gram of the corpus from rare to common.
2. Sizes alone say that two sets that link share one of the first
   n - ceil(3n/4) + 1 n-grams of each in that order (see `prefix_length`). Those
   that no other set holds tie nothing and stay where they are. Column blocks
   lay equal n-grams side by side and tie their sets together, by size: along a
   list sets are tied to the next larger while their sizes allow a link. So a
   list gives rows as it is long, whatever its length, and a part sends a list
   that many of its sets are in once for each range of sizes.
3. The components of these ties are supersets of the result's. Their documents
   meet in row blocks of bounded size (see `_links`). There a sparse product of
   full rows, in BFS order against documents not yet reached, accumulates whole
   overlap counts; pairs below the bound that their sizes give are discarded
   where they are made, and only a forest of the links leaves the task.

Sets with equal digests are one vertex, wherever they lie, so exact copies cost
one row a part.

Defined results: a null text, or one without words, has an empty set, links
with nothing, and is its own component; a text of fewer than five words is one
shingle, of all of them. Texts of any length go through in pieces (see
`words`); a set is held by one task. Equal rows are linked like other copies
and give a row each; rows of one doc_id with different texts are one document
with the links of all of them. A row without doc_id links to nothing and gets a
null component. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import buckets_and_parts, cut, id_and_text, part_of
from gridsmith.llm.graph import components, forest
from gridsmith.llm.words import planes, ranges, steps, stir, unplanes, unsteps, word_numbers

N = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: N-grams of a block: small ones where few sets are left to compare, so that no task holds much of a large group, and at most the larger number.
BLOCK_NGRAMS = 20_000, 1_000_000
#: Ids up to this many (of some 40 bytes) are broadcast to the texts; more of them are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Characters of text whose words are held at once.
_CHUNK = 2_000_000
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """How many of a set's n-grams, in the common order, hold one of every set that links with it.

    Sets that link share at least ceil(3n/4) of these n; leave out all but the
    first n - ceil(3n/4) + 1 of either set, and the first shared one is in both.
    """
    return n - -(-PERCENT * n // 100) + 1


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's size, and all their shingles' hashes, sorted and distinct within a text."""
    many, word = word_numbers(texts)
    rows = max(0, len(word) - N + 1)
    # The windows of the whole run of words; those that cross texts are not taken.
    window = word[:rows].copy()
    for i in range(1, N):
        window ^= window >> _U(31)
        window *= _MIX
        window += word[i : i + rows]
    window = stir(window)
    out = []
    for end, k in zip(np.cumsum(many).tolist(), many.tolist(), strict=True):
        if k >= N:
            own = np.sort(window[end - k : end - N + 1])
            fresh = own[1:] != own[:-1]
            out.append(own if fresh.all() else own[np.concatenate([[True], fresh])])
        elif k:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[end - k : end].tobytes(), seed=k)], _U))
        else:
            out.append(np.zeros(0, _U))
    return np.array([len(x) for x in out], np.int64), np.concatenate(out) if out else np.zeros(0, _U)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of bounded text, with where they start."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total > _CHUNK or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, total = i + 1, 0


@dataclass
class PartSets:
    """A part's documents and its distinct sets: which set a document has (-1: none that links), each set's smallest doc_id, digest, size and n-grams in turn."""

    ids: list[int | None]
    n: np.ndarray
    which: np.ndarray
    least: np.ndarray
    marks: np.ndarray
    size: np.ndarray
    gram: np.ndarray

    @classmethod
    def of(cls, texts: pa.Table) -> PartSets:
        ids = texts.column("doc_id").to_pylist()
        number: dict[bytes, int] = {}
        least: list[int] = []
        n_all, which, sizes, grams = [], [], [], []
        for start, some in _chunks(texts.column("text").to_pylist()):
            n, value = shingle_sets(some)
            n_all.append(n)
            for i, (k, end) in enumerate(zip(n.tolist(), np.cumsum(n).tolist(), strict=True), start):
                if not k or ids[i] is None:
                    which.append(-1)
                    continue
                own = value[end - k : end]
                at = number.setdefault(blake2b(own.tobytes(), digest_size=16).digest(), len(number))
                if at == len(least):
                    least.append(ids[i])
                    sizes.append(k)
                    grams.append(own)
                least[at] = min(least[at], ids[i])
                which.append(at)
        marks = np.frombuffer(b"".join(number), "<i8").reshape(-1, 2)
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return cls(ids, whole(n_all, np.int64), np.array(which, np.int64), np.array(least, np.int64), marks, np.array(sizes, np.int64), whole(grams, _U))


def _arrow(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(fields)})


_INT, _LONG, _BIN = pa.int32(), pa.int64(), pa.binary()


def _ask(keys: list[int]):
    """A part's distinct n-grams, by bucket, with how many of its sets hold them."""

    def run(texts: pa.Table) -> pa.Table:
        part = texts.column("part")[0].as_py()
        gram, many = np.unique(PartSets.of(texts).gram, return_counts=True)
        rows = [(keys[b], part, steps(gram[s]), planes(many[s])) for b, s in enumerate(ranges(gram, len(keys))) if s.stop > s.start]
        return _arrow(rows, [("bucket", _INT), ("part", _INT), ("grams", _BIN), ("many", _BIN)])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """For every part that asked, its n-grams' ranks from rare to common: 0 for those of one set, else an eighth of a power of two apart."""
    rows = group.select(["bucket", "part", "grams", "many"]).to_pylist()
    grams = [unsteps(r["grams"]) for r in rows]
    _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unplanes(r["many"]) for r in rows]))
    rank = np.minimum(255, 8 * np.log2(total)).astype("u1")[inverse]
    ends = np.cumsum([len(g) for g in grams])
    out = [(r["part"], r["bucket"], rank[e - len(g) : e].tobytes()) for r, g, e in zip(rows, grams, ends.tolist(), strict=True)]
    return _arrow(out, [("part", _INT), ("bucket", _INT), ("ranks", _BIN)])


TIED = [("doc_id", _LONG), ("n", _LONG), ("own", _LONG), ("hi", _LONG), ("lo", _LONG), ("a", _LONG), ("b", _LONG), ("bucket", _INT), ("grams", _BIN), ("ids", _BIN), ("low", _BIN), ("high", _BIN)]
TIED_SCHEMA = "doc_id long, n long, own long, hi long, lo long, a long, b long, bucket int, grams binary, ids binary, low binary, high binary"


def _tie(keys: list[int]):
    """A part again, with the answers. Rows with n are documents (hi and lo with the first of each set), rows with a are ties within the part, rows with a bucket are lists for the column blocks."""
    place = {k: b for b, k in enumerate(keys)}

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _arrow([], TIED)
        sets = PartSets.of(texts)
        rows: list[tuple] = []
        told = [False] * len(sets.least)
        for i, n, w in zip(sets.ids, sets.n.tolist(), sets.which.tolist(), strict=True):
            new = w >= 0 and i == sets.least[w] and not told[w]
            rows.append((i, n, int(sets.least[w]) if w >= 0 else i, *(sets.marks[w].tolist() if new else (None, None)), *[None] * 7))
            if new:
                told[w] = True
        distinct, inverse = np.unique(sets.gram, return_inverse=True)
        blobs = sorted((place[r["bucket"]], r["ranks"]) for r in answers.to_pylist())
        rank = np.frombuffer(b"".join(x for _, x in blobs), "u1")[inverse] if len(distinct) else np.zeros(0, "u1")
        owner = np.repeat(np.arange(len(sets.size)), sets.size)
        use = np.flatnonzero(rank > 0)
        alone = np.bincount(owner, rank == 0, len(sets.size)).astype(np.int64)
        use = use[np.lexsort((sets.gram[use], rank[use], owner[use]))]
        own = owner[use]
        kept = np.bincount(own, minlength=len(sets.size))
        position = alone[own] + np.arange(len(own)) - (np.cumsum(kept) - kept)[own]
        early = position < prefix_length(sets.size)[own]
        own, gram = own[early], sets.gram[use[early]]
        size = sets.size[own]
        by = np.lexsort((size, gram))
        own, gram, size = own[by], gram[by], size[by]
        first = _breaks(gram, size, size)
        at = np.flatnonzero(first)
        seg = np.cumsum(first) - 1
        ids = sets.least[own]
        a, b = forest(ids, ids[at][seg]) if len(ids) else (ids, ids)
        rows += [(None,) * 5 + (x, y) + (None,) * 5 for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        last = np.append(at[1:], len(own))[: len(at)] - 1
        gram, low, high, ids = gram[at], size[at], size[last], ids[at]
        for key, s in zip(keys, ranges(gram, len(keys)), strict=True):
            if s.stop > s.start:
                rows.append((None,) * 7 + (key, steps(gram[s]), ids[s].astype("<i8").tobytes(), planes(low[s]), planes(high[s])))
        return _arrow(rows, TIED)

    return run


def _breaks(gram: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where a new run starts in lists sorted by n-gram and low: another n-gram, or a size that no earlier set of the list can link with."""
    first = np.ones(len(gram), bool)
    if len(gram) > 1:
        same = gram[1:] == gram[:-1]
        which = np.concatenate([[0], np.cumsum(~same)])
        most = np.maximum.accumulate(which * 2**32 + high) % 2**32
        first[1:] = ~same | (100 * most[:-1] < PERCENT * low[1:])
    return first


def _column_block(group: pa.Table) -> pa.Table:
    """One column block: a forest of the ties that its lists make."""
    rows = group.select(["grams", "ids", "low", "high"]).to_pylist()
    gram = np.concatenate([unsteps(r["grams"]) for r in rows])
    ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
    low, high = (np.concatenate([unplanes(r[c]) for r in rows]).astype(np.int64) for c in ("low", "high"))
    by = np.lexsort((low, gram))
    gram, ids, low, high = gram[by], ids[by], low[by], high[by]
    first = _breaks(gram, low, high)
    a, b = forest(ids, ids[np.flatnonzero(first)][np.cumsum(first) - 1])
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def exact_links(ids: np.ndarray, n: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among the given sets (gram holds them in turn): blocks of reached rows times rows not yet reached."""
    rows = len(ids)
    doc = np.repeat(np.arange(rows), n)
    _, column = np.unique(gram, return_inverse=True)
    ends = np.cumsum(n)
    left = np.ones(rows, bool)
    at_a, at_b = [], []

    def index() -> tuple[np.ndarray, np.ndarray]:
        use = np.flatnonzero(left[doc])
        use = use[np.argsort(column[use], kind="stable")]
        return column[use], doc[use]

    by_column, by_doc = index()
    indexed = rows
    for seed in range(rows):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = [seed]
        while frontier and left.any():
            if 2 * left.sum() < indexed:
                by_column, by_doc = index()
                indexed = int(left.sum())
            x = frontier.pop()
            mine = column[ends[x] - n[x] : ends[x]]
            low, high = np.searchsorted(by_column, mine, "left"), np.searchsorted(by_column, mine, "right")
            many = high - low
            hits = by_doc[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            found, overlap = np.unique(hits, return_counts=True)
            linked = found[left[found] & (100 * overlap >= PERCENT * (n[x] + n[found] - overlap))]
            left[linked] = False
            frontier += linked.tolist()
            at_a += [seed] * len(linked)
            at_b += linked.tolist()
    return ids[np.array(at_a, int)], ids[np.array(at_b, int)]


def _verify(group: pa.Table) -> pa.Table:
    # Equal texts are one row here; their ids are tied to the first.
    texts: dict[str, int] = {}
    same_a, same_b, ids = [], [], []
    for i, t in sorted(zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), strict=True)):
        if t in texts:
            same_a.append(texts[t])
            same_b.append(i)
        else:
            texts[t] = i
            ids.append(i)
    sets = [shingle_sets(chunk) for _, chunk in _chunks(list(texts))]
    n, gram = (np.concatenate(x) for x in zip(*sets, strict=True))
    a, b = exact_links(np.array(ids, np.int64), n, gram)
    return pa.table({"a": pa.array(np.concatenate([a, np.array(same_a, np.int64)])), "b": pa.array(np.concatenate([b, np.array(same_b, np.int64)]))})


def _texts(frame: DataFrame, keyed: DataFrame) -> DataFrame:
    """The texts of some documents, with their block keys."""
    keyed = cut(keyed)
    return frame.join(F.broadcast(keyed) if keyed.count() <= BROADCAST_ROWS else keyed, "doc_id")


def _spread(column: str, blocks: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.col(blocks)).cast("int")


def _all_blocks(blocks: str) -> Column:
    return F.sequence(F.lit(0), F.col(blocks) - 1)


def _links(frame: DataFrame, sized: DataFrame, block: tuple[int, int]) -> DataFrame:
    """Exact links that connect each component of the rough graph (doc_id, label, n) as all links would.

    First every component is dealt to small blocks, its smallest document (the
    hub) to all of them. Of a group of near copies most are then linked by way of
    the hub. Documents that are not meet all others of their component, again in
    blocks, which are larger the more there are of them.
    """
    # Written first, so that the join below is between plain shuffles and AQE splits a large component.
    total = cut(sized.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("rows")).where("rows > 1").drop("rows").withColumn("blocks", F.ceil(F.col("total") / block[0]).cast("int")))
    dealt = cut(sized.join(total, "label"))
    own = F.array(_spread("doc_id", "blocks", 1))
    first = dealt.select("doc_id", "label", F.explode(F.when(F.col("doc_id") == F.col("label"), _all_blocks("blocks")).otherwise(own)).alias("i"))
    found = cut(_texts(frame, first).groupBy("label", "i").applyInArrow(_verify, "a long, b long"))
    large = dealt.where("blocks > 1")
    joined = components(found).select(F.col("v").alias("doc_id"), F.col("label").alias("hub"))
    apart = large.where(F.col("doc_id") != F.col("label")).join(joined, "doc_id", "left").where(F.coalesce(F.col("hub"), F.col("doc_id")) != F.col("label")).drop("hub")
    apart = cut(apart)
    if apart.isEmpty():
        return found
    rest = apart.groupBy("label").agg(F.sum("n").alias("rest")).withColumn("size", F.least(F.greatest("rest", F.lit(block[0])), F.lit(block[1])))
    split = cut(total.join(rest, "label").select("label", F.ceil(F.col("total") / F.col("size")).cast("int").alias("others"), F.ceil(F.col("rest") / F.col("size")).cast("int").alias("parts")))
    one = large.select("doc_id", "label").join(split, "label").select("doc_id", "label", _spread("doc_id", "others", 2).alias("i"), F.explode(_all_blocks("parts")).alias("j"))
    two = apart.select("doc_id", "label").join(split, "label").select("doc_id", "label", F.explode(_all_blocks("others")).alias("i"), _spread("doc_id", "parts", 3).alias("j"))
    # Dealt by document before the distinct: else it would lean on the join's partitions by label, and AQE could not split them.
    met = _texts(frame, one.unionByName(two).repartition("doc_id").distinct()).groupBy("label", "i", "j")
    return found.unionByName(met.applyInArrow(_verify, "a long, b long"))


def jaccard_components(docs: DataFrame, block_ngrams: tuple[int, int] = BLOCK_NGRAMS) -> DataFrame:
    """doc_id, n_shingles and component_id, one row a document: the rows that op8 returns."""
    frame = id_and_text(docs)
    keys, width = buckets_and_parts(frame)
    parts = frame.withColumn("part", part_of(width))
    asked = parts.groupBy("part").applyInArrow(_ask(keys), "bucket int, part int, grams binary, many binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer, "part int, bucket int, ranks binary")
    tied = cut(parts.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(_tie(keys), TIED_SCHEMA))
    across = tied.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_column_block, "a long, b long")
    rough = components(tied.where("a IS NOT NULL").select("a", "b").unionByName(across))
    # Copies in different parts: the smallest stands for all, which are one row a part.
    held = tied.where("hi IS NOT NULL").select("doc_id", "n", "hi", "lo")
    least = held.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    copies = held.join(least.select("hi", "lo", "rep"), ["hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    member = rough.unionByName(rough.select(F.col("label").alias("v"), "label").distinct())
    sized = member.join(least.groupBy(F.col("rep").alias("v")).agg(F.sum("n").alias("n")), "v").select(F.col("v").alias("doc_id"), "label", "n")
    documents = tied.where("n IS NOT NULL").select("doc_id", "n", "own")
    same = documents.select(F.col("doc_id").alias("a"), F.col("own").alias("b")).unionByName(copies).where("a <> b").distinct()
    labels = cut(components(_links(frame, cut(sized), block_ngrams).unionByName(same)))
    out = documents.join(labels, documents["doc_id"] == labels["v"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of every component the document with the smallest doc_id, with all its columns, once; rows without doc_id stay.

    Of rows with that doc_id and different texts the longest text stays, of
    equally long ones the first in order. The join and the removal of repeated
    rows share one shuffle by doc_id.
    """
    found = jaccard_components(docs)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    mine = plain.join(kept, doc_id == kept["doc_id"], "left_semi")
    # A key that sorts the longest text first; ties are equal texts, whose other columns are taken as one row.
    best = mine.groupBy(doc_id.alias("id")).agg(F.max(F.struct(F.coalesce(F.length(text), F.lit(-1)).alias("size"), text.alias("text"), F.struct(*names).alias("row"))).alias("best"))
    one = best.select(*[F.col(f"best.row.{n}").alias(n) for n in names])
    return one.unionByName(plain.where(doc_id.isNull())).toDF(*docs.columns)
