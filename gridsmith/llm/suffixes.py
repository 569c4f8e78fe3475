"""Exact removal of repeated 100-byte strings by a logarithmic family of suffix arrays.

Which suffixes. Of the 32-byte grams in a 100-byte window the one with the least
hash (the leftmost of equals) is its anchor; consecutive windows with one anchor
make a run. Equal windows have equal anchors, so windows can only equal windows
of runs with the same gram. Parts of the documents ask buckets, by gram hash,
which grams occur more than once; runs of others hold nothing that repeats and
stay where they are. Of the runs left the suffix at the first window is sampled,
as far as the run's windows reach (168 bytes at most).

How they are matched. Suffixes stand in the order of their text, of equal texts
the earliest place first. `Levels` is the index family: a batch's suffixes are
sorted and come in as a level; levels of equal rank merge into one of the next,
and the merge scan compares each suffix with its neighbour, byte by byte. Of
equal ones the earliest place stays in the index and the others are repeats over
their whole length. A part indexes its own documents, a chunk of text a batch,
and ships what is left to the buckets; there the parts' arrays are the batches
of another family. So a passage that very many documents hold costs one entry a
part.

Runs whose gram is left with several texts share some windows at most. Their
bytes get a dense array: all their windows, in the order of their 100 bytes,
in a family of their own. A gram with more than HOT texts is not kept together:
its windows are dealt to buckets one by one, by a hash of their bytes.

Defined results: a null text counts as empty; texts under 100 bytes lose
nothing; texts of any length go through in chunks that overlap; an empty table
gives no rows. Places are ordered by doc_id and start, whatever the row: rows of
one doc_id, with equal or different texts, give a row each, and a string at the
same start of two of them is no repeat of itself. A null doc_id orders before
all others. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import buckets_and_parts, id_and_text, part_of
from gridsmith.llm.words import planes, powers, ranges, steps, stir, unplanes, unsteps

WINDOW = 100
GRAM = 32
SPREAD = WINDOW - GRAM + 1
#: The longest a run's windows reach.
REACH = WINDOW + SPREAD - 1
CHUNK = 2 << 20
#: Windows of a batch of the dense array.
DENSE = 200_000
#: A gram with more texts than this is dealt out window by window.
HOT = 4096
NO_ID = -(2**63)

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_PLACE = _U((1 << 24) - 1)


def _eights(data: bytes) -> np.ndarray:
    """The 8 bytes from every place on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def gram_hashes(data: bytes) -> np.ndarray:
    w = _eights(data)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = w[:n] * _MIX[0]
    for i in (1, 2, 3):
        out += (w[8 * i : 8 * i + n] ^ (out >> _U(31))) * _MIX[i]
    return stir(out)


def runs(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts laid end to end (sizes in bytes): gram hash, fingerprint of the text, text, first window, windows, anchor's offset."""
    ends = np.cumsum(sizes)
    gram = gram_hashes(data)
    n = len(data) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none.astype(_U), none, none, none, none
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=_U)
    blocks = -(-len(key) // SPREAD)
    padded = np.full(blocks * SPREAD, _U(2**64 - 1))
    padded[: len(key)] = key
    table = padded.reshape(blocks, SPREAD)
    before = np.minimum.accumulate(table, 1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(after[:n], before[SPREAD - 1 : SPREAD - 1 + n]) & _PLACE).astype(np.int64)
    # Windows that would cross into the next text are none.
    owner_change = np.zeros(n + 1, np.int64)
    starts = ends - sizes
    for_text = sizes >= WINDOW
    np.add.at(owner_change, starts[for_text], 1)
    np.add.at(owner_change, (ends - WINDOW + 1)[for_text], -1)
    valid = np.cumsum(owner_change)[:n] > 0
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    fresh[starts[for_text]] = True
    first = np.flatnonzero(fresh & valid)
    stop = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
    many = stop - first + 1
    power, inverse = powers(len(gram) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(gram * power[: len(gram)])])
    span = (sums[stop + SPREAD] - sums[first]) * inverse[first]
    at = anchor[first]
    mark = stir(span + (many.astype(_U) * _MIX[1]) + ((at - first).astype(_U) * _MIX[3]))
    text = np.searchsorted(ends, first, "right")
    # An anchor has the least hash of its window: mixed once more, so that ranges of it are even.
    return stir(gram[at]), mark, text, first - starts[text], many, at - first



def window_marks(data: bytes, at: np.ndarray) -> np.ndarray:
    """A hash of the 100 bytes at each place."""
    w = _eights(data)
    x = np.full(len(at), _MIX[0])
    for i in (*range(0, WINDOW - 7, 8), WINDOW - 8):
        x = (x ^ w[at + i]) * _MIX[2]
        x ^= x >> _U(32)
    return stir(x)


def texts_at(data: bytes, first: np.ndarray, size: np.ndarray, reach: int) -> np.ndarray:
    """The bytes from each place on, as far as its size: fixed-width strings, filled up with zeros."""
    padded = np.frombuffer(data + bytes(reach), "u1")
    rows = np.lib.stride_tricks.sliding_window_view(padded, reach)[first]
    rows[np.arange(reach) >= size[:, None]] = 0
    return rows.view(f"S{reach}").ravel()


def _matrix(text: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(text).view("u1").reshape(len(text), text.dtype.itemsize)


@dataclass
class Suffixes:
    """Columns: texts, how many windows they hold (with the text, what is compared), places (doc_id and start), owners (part and text within it), anchors' offsets."""

    text: np.ndarray
    many: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    part: np.ndarray
    owner: np.ndarray
    offset: np.ndarray

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.text, self.many, self.doc, self.start, self.part, self.owner, self.offset

    def take(self, which) -> Suffixes:
        return Suffixes(*(c[which] for c in self.columns()))

    @classmethod
    def joined(cls, parts: list[Suffixes]) -> Suffixes:
        return cls(*(np.concatenate(c) for c in zip(*(p.columns() for p in parts), strict=True)))

    @classmethod
    def none(cls, reach: int = REACH) -> Suffixes:
        zero = np.zeros(0, np.int64)
        return cls(np.zeros(0, f"S{reach}"), zero, zero, zero, zero, zero, zero)

    def __len__(self) -> int:
        return len(self.many)


class Levels:
    """Suffix arrays, one for each power of two of batches."""

    def __init__(self) -> None:
        self.levels: list[Suffixes | None] = []
        self.lost: list[Suffixes] = []

    def _scanned(self, some: Suffixes) -> Suffixes:
        """The suffixes by text and place, without those that repeat an earlier one."""
        some = some.take(np.lexsort((some.start, some.doc, some.many)))
        # A stable sort: of two sorted levels it is a merge.
        some = some.take(np.argsort(some.text, kind="stable"))
        same = np.zeros(len(some), bool)
        same[1:] = (some.text[1:] == some.text[:-1]) & (some.many[1:] == some.many[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(some))))
        # Two rows of one doc_id may hold a text at the same place: neither comes before the other.
        gone = (some.doc != some.doc[first]) | (some.start != some.start[first])
        repeats = some.take(gone)
        repeats.text = np.zeros(len(repeats), "S1")
        self.lost.append(repeats)
        return some.take(~gone)

    def add(self, batch: Suffixes) -> None:
        carry = self._scanned(batch)
        at = 0
        while at < len(self.levels) and self.levels[at] is not None:
            carry = self._scanned(Suffixes.joined([self.levels[at], carry]))
            self.levels[at] = None
            at += 1
        if at == len(self.levels):
            self.levels.append(None)
        self.levels[at] = carry

    def close(self) -> Suffixes:
        """What is left, as one array."""
        parts = [x for x in self.levels if x is not None]
        self.levels = []
        return Suffixes.none() if not parts else parts[0] if len(parts) == 1 else self._scanned(Suffixes.joined(parts))

    def removed(self) -> Suffixes:
        """The repeats since the last call; their texts are not kept."""
        out, self.lost = Suffixes.joined(self.lost) if self.lost else Suffixes.none(1), []
        return out


def dense(open_runs: Suffixes) -> Suffixes:
    """The repeats among all windows of the given runs, as runs of one window."""
    family = Levels()
    ends = np.cumsum(open_runs.many)
    at = 0
    while at < len(open_runs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DENSE, "right")))
        some = open_runs.take(slice(at, to))
        row = np.repeat(np.arange(len(some)), some.many)
        step = np.arange(len(row)) - np.repeat(np.cumsum(some.many) - some.many, some.many)
        every = _matrix(some.text)
        text = np.lib.stride_tricks.sliding_window_view(every, WINDOW, 1)[row, step].view(f"S{WINDOW}").ravel()
        one = np.ones(len(row), np.int64)
        family.add(Suffixes(text, one, some.doc[row], some.start[row] + step, some.part[row], some.owner[row], one))
        at = to
    family.close()
    return family.removed()


def open_runs(left: Suffixes) -> Suffixes:
    """Of an array without repeats, the suffixes whose gram is there with several texts; single windows that were dealt out by their bytes are settled."""
    left = left.take(left.offset <= SPREAD)
    if not len(left):
        return left
    every = _matrix(left.text)
    gram = np.lib.stride_tricks.sliding_window_view(every, GRAM, 1)[np.arange(len(left)), left.offset].view(f"S{GRAM}").ravel()
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    shared = np.zeros(len(left), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return left.take(shared)


def _chunks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Bounded buffers of texts, with each piece's size, text and start; pieces of a long text overlap by all but one byte of a window, so each window is in one piece."""
    waiting: list[bytes] = []
    where: list[tuple[int, int]] = []
    size = 0
    for i, data in enumerate(texts):
        for start in range(0, max(1, len(data) - WINDOW + 1), CHUNK):
            piece = data[start : start + CHUNK + WINDOW - 1]
            if waiting and size + len(piece) > CHUNK + WINDOW:
                yield b"".join(waiting), np.array([len(w) for w in waiting], np.int64), *np.array(where, np.int64).T
                waiting, where, size = [], [], 0
            waiting.append(piece)
            where.append((i, start))
            size += len(piece)
    if waiting:
        yield b"".join(waiting), np.array([len(w) for w in waiting], np.int64), *np.array(where, np.int64).T


class Part:
    """A part's distinct texts, in the order of their doc_id and bytes, and their runs chunk by chunk."""

    def __init__(self, texts: pa.Table):
        rows = [(i, t.encode("utf-8", "surrogatepass")) for i, t in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True)]
        self.rows = rows
        self.texts = sorted(set(rows))
        self.ids = np.array([i for i, _ in self.texts], np.int64)

    def chunks(self) -> Iterator[tuple]:
        return _chunks([t for _, t in self.texts])

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The part's grams and how many texts each stands in; more than HOT need not be told apart."""
        found = [runs(data, sizes)[:2] for data, sizes, _, _ in self.chunks()]
        gram, mark = (np.concatenate(x) if x else np.zeros(0, _U) for x in (zip(*found, strict=True) if found else ((), ())))
        order = np.lexsort((mark, gram))
        gram, mark = gram[order], mark[order]
        distinct, first, places = np.unique(gram, return_index=True, return_counts=True)
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (mark[1:] != mark[:-1])
        texts = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        # 2 stands for equal texts within the part: the gram is shared, but not hot.
        return distinct, np.where((texts == 1) & (places > 1), 2, texts)

    def suffixes(self, number: int, distinct: np.ndarray, kind: np.ndarray) -> tuple[Suffixes, np.ndarray, Suffixes]:
        """What the part's own index leaves of runs with shared grams, the hashes that tell their buckets, and the repeats within the part."""
        family, single = Levels(), Levels()
        for data, sizes, text, start in self.chunks():
            gram, _, piece, first, many, offset = runs(data, sizes)
            at = np.searchsorted(distinct, gram)
            begin = (np.cumsum(sizes) - sizes)[piece]
            for hot, levels in ((False, family), (True, single)):
                use = np.flatnonzero(kind[at] == 1 + hot)
                if not len(use):
                    continue
                row, step = use, np.zeros(len(use), np.int64)
                if hot:
                    row = np.repeat(use, many[use])
                    step = np.arange(len(row)) - np.repeat(np.cumsum(many[use]) - many[use], many[use])
                count = np.ones(len(row), np.int64) if hot else many[row]
                place = begin[row] + first[row] + step
                owner = text[piece[row]]
                levels.add(Suffixes(texts_at(data, place, count + WINDOW - 1, REACH), count, self.ids[owner], start[piece[row]] + first[row] + step, np.full(len(row), number), owner, np.full(len(row), 255) if hot else offset[row]))
        runs_left, windows_left = family.close(), single.close()
        every = _matrix(runs_left.text)
        grams = np.lib.stride_tricks.sliding_window_view(every, GRAM, 1)[np.arange(len(runs_left)), runs_left.offset]
        by_gram = stir(gram_hashes(grams.tobytes())[::GRAM].copy())
        whole = windows_left.text.tobytes()
        by_window = window_marks(whole, np.arange(len(windows_left)) * REACH) if len(windows_left) else np.zeros(0, _U)
        return Suffixes.joined([runs_left, windows_left]), np.concatenate([by_gram, by_window]), Suffixes.joined([family.removed(), single.removed()])


_INT, _LONG, _BIN = pa.int32(), pa.int64(), pa.binary()
_ASKED = [("bucket", _INT), ("part", _INT), ("grams", _BIN), ("texts", _BIN)]
_ANSWERED = [("part", _INT), ("bucket", _INT), ("kinds", _BIN)]
_SHIPPED = [("bucket", _INT), ("part", _INT), *((c, _BIN) for c in ("texts", "many", "docs", "starts", "owners", "offsets"))]
_REMOVED = [("part", _INT), *((c, _BIN) for c in ("owners", "starts", "many"))]


def _schema(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {_INT: "int", _LONG: "long", _BIN: "binary", pa.string(): "string"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in fields)


def _arrow(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(fields)})


def _ask(keys: list[int]):
    def run(texts: pa.Table) -> pa.Table:
        part = texts.column("part")[0].as_py()
        gram, many = Part(texts).asked()
        return _arrow([(key, part, steps(gram[s]), planes(many[s])) for key, s in zip(keys, ranges(gram, len(keys)), strict=True) if s.stop > s.start], _ASKED)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """0 for grams that occur once, 1 for those that occur more often, 2 for hot ones."""
    rows = group.to_pylist()
    grams = [unsteps(r["grams"]) for r in rows]
    distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    texts = np.bincount(inverse, np.concatenate([unplanes(r["texts"]) for r in rows]), len(distinct))
    kind = ((texts > 1).astype("u1") + (texts > HOT).astype("u1"))[inverse]
    ends = np.cumsum([len(g) for g in grams]).tolist()
    return _arrow([(r["part"], r["bucket"], kind[e - len(g) : e].tobytes()) for r, g, e in zip(rows, grams, ends, strict=True)], _ANSWERED)


def _removed_rows(gone: Suffixes) -> Iterator[tuple]:
    """Removed places by part: neighbouring windows of a text as one."""
    gone = gone.take(np.lexsort((gone.start, gone.owner, gone.part)))
    fresh = np.ones(len(gone), bool)
    fresh[1:] = (gone.part[1:] != gone.part[:-1]) | (gone.owner[1:] != gone.owner[:-1]) | (gone.start[1:] != gone.start[:-1] + gone.many[:-1])
    first = np.flatnonzero(fresh)
    many = np.add.reduceat(gone.many, first) if len(first) else first
    part, owner, start = gone.part[first], gone.owner[first], gone.start[first]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)][: len(cuts)], strict=True):
        yield int(part[i]), planes(owner[i:j]), planes(start[i:j]), planes(many[i:j])


def _ship(keys: list[int]):
    """A part again, with the answers: its index's entries for the buckets. What repeats within the part goes to a bucket of its own (below 0), which hands it on."""
    place = {key: b for b, key in enumerate(keys)}

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if texts.num_rows:
            number = texts.column("part")[0].as_py()
            part = Part(texts)
            found = [runs(data, sizes)[0] for data, sizes, _, _ in part.chunks()]
            distinct = np.unique(np.concatenate(found)) if found else np.zeros(0, _U)
            blobs = sorted((place[r["bucket"]], r["kinds"]) for r in answers.to_pylist())
            left, key, gone = part.suffixes(number, distinct, np.frombuffer(b"".join(x for _, x in blobs), "u1"))
            order = np.argsort(key, kind="stable")
            left, key = left.take(order), key[order]
            for bucket, s in zip(keys, ranges(key, len(keys)), strict=True):
                if s.stop > s.start:
                    one = left.take(s)
                    # A range's suffixes in text order; the id as its distance from the part's least.
                    one = one.take(np.argsort(one.text, kind="stable"))
                    full = _matrix(one.text)
                    body = full[np.arange(REACH) < (one.many + WINDOW - 1)[:, None]].tobytes()
                    rows.append((bucket, number, body, planes(one.many), one.doc.astype("<i8").tobytes(), planes(one.start), planes(one.owner), planes(one.offset)))
            for part_number, owners, starts, many in _removed_rows(gone):
                rows.append((-1 - part_number, part_number, None, many, None, starts, owners, None))
        return _arrow(rows, _SHIPPED)

    return run


def _shipped(row: dict) -> Suffixes:
    many, start, owner, offset = (unplanes(row[c]).astype(np.int64) for c in ("many", "starts", "owners", "offsets"))
    size = many + WINDOW - 1
    text = texts_at(row["texts"], np.cumsum(size) - size, size, REACH)
    return Suffixes(text, many, np.frombuffer(row["docs"], "<i8"), start, np.full(len(many), row["part"]), owner, offset)


def _meet(group: pa.Table) -> pa.Table:
    """One bucket: the parts' arrays are the batches of a family; runs it leaves open go through the dense array."""
    if group.column("bucket")[0].as_py() < 0:
        return group.select([name for name, _ in _REMOVED])
    family = Levels()
    for row in sorted(group.to_pylist(), key=lambda r: r["part"]):
        family.add(_shipped(row))
    left = family.close()
    rows = list(_removed_rows(family.removed()))
    return _arrow(rows + list(_removed_rows(dense(open_runs(left)))), _REMOVED)


_REPORT = [("doc_id", _LONG), ("n_bytes", _LONG), ("n_removed", _LONG), ("n_spans", _LONG), ("kept_sha256", pa.string())]


def _report(texts: pa.Table, removed: pa.Table) -> pa.Table:
    if not texts.num_rows:
        return _arrow([], _REPORT)
    part = Part(texts)
    by: dict[int, list[tuple[int, int]]] = {}
    for r in removed.to_pylist():
        for o, p, n in zip(*(unplanes(r[c]).tolist() for c in ("owners", "starts", "many")), strict=True):
            by.setdefault(o, []).append((p, p + n - 1 + WINDOW))
    told: dict[tuple[int, bytes], tuple] = {}
    for owner, row in enumerate(part.texts):
        doc_id, data = row
        kept, gone, spans, end = hashlib.sha256(), 0, 0, 0
        for a, b in sorted(by.get(owner, ())):
            if spans and a <= end:
                gone += max(0, b - end)
                end = max(end, b)
                continue
            kept.update(data[end:a])
            spans, gone, end = spans + 1, gone + b - a, b
        kept.update(data[end:])
        told[row] = (None if doc_id == NO_ID else doc_id, len(data), gone, spans, kept.hexdigest())
    return _arrow([told[row] for row in part.rows], _REPORT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row a document: the rows that op1 returns."""
    frame = id_and_text(docs)
    keys, width = buckets_and_parts(frame)
    parts = frame.withColumn("part", part_of(width)).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    asked = parts.groupBy("part").applyInArrow(_ask(keys), _schema(_ASKED))
    answered = asked.groupBy("bucket").applyInArrow(_answer, _schema(_ANSWERED))
    shipped = parts.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(_ship(keys), _schema(_SHIPPED))
    removed = shipped.groupBy("bucket").applyInArrow(_meet, _schema(_REMOVED))
    return parts.groupBy("part").cogroup(removed.groupBy("part")).applyInArrow(_report, _schema(_REPORT))
