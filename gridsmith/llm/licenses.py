"""License scans over a positional rare-token index.

The template postings map each license word to its places in the templates. A
first pass counts, over all documents, how many hold each template word; these
document frequencies give the words' IDF. In a second pass each file's license
words are indexed by position. For every template the postings of its mandatory
key phrase are intersected by relative position, the highest-IDF word first, so
a file without that word is done at once. Around each place of the key phrase
(give or take SLACK words) an alignment that at least `agree` different words of
the template agree on is found; all the template's words vote, and its score is
the share of template words at their relative positions. So templates do not
compete: what else a file holds never hides one.

The base phrases (mit license, apache license, general public license) are
templates of their own, with themselves as key phrase, and each place of them
is found.

Defined results: a null text counts as empty; a text without words has n_words
0, no labels, null first_word and last_word and score 0. Repeated rows give a
row each, and an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import id_and_text

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SLACK = 2


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: tuple[bytes, ...]
    base: bool = False


def words_of(text: str) -> list[bytes]:
    """The words of a text: A-Z in lower case, everything but ASCII letters, digits and non-ASCII characters separates."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def _template(label: str, text: str, key: str) -> Template:
    return Template(label, tuple(words_of(text)), tuple(words_of(key)))


#: The base phrases, and the opening sentences of common public licenses with the phrase that each must show.
BASE = [Template(label, tuple(words_of(p)), tuple(words_of(p)), True) for label, p in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))]
TEMPLATES = [
    *BASE,
    _template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "permission is hereby granted free of charge"),
    _template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at", "you may not use this file except in compliance with the license"),
    _template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "free software you can redistribute it and or modify it"),
    _template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    _template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one", "terms of the mozilla public license"),
    _template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    _template("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    *(_template("cc", f"CC BY-{x}", f"CC BY-{x}") for x in ("SA", "NC", "ND")),
    _template("cc", "This work is licensed under a Creative Commons Attribution License. To view a copy of this license, visit", "creative commons attribution"),
    _template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "terms of the eclipse public license"),
]
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})
POSTINGS: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
for _k, _t in enumerate(TEMPLATES):
    for _p, _w in enumerate(_t.words):
        POSTINGS[_w].append((_k, _p))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """How many documents there are and how many hold each template word: one row a word and task goes to the driver's sum, over a fixed vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, wanted = Counter(), 0, set(VOCABULARY)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(wanted.intersection(words_of(text)))
        rows = [("", n), *((w.decode("utf-8"), c) for w, c in sorted(seen.items()))]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["word", "n"])

    total = id_and_text(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in total}
    return found.pop(b"", 0), found


class Scanner:
    """Finds templates in one file's words; idf tells which words of a key phrase are looked up first."""

    def __init__(self, n_docs: int, frequencies: dict[bytes, int], agree: int = 3):
        self.idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) for w in VOCABULARY}
        self.agree = agree
        self.order = {t.key: sorted(range(len(t.key)), key=lambda i, t=t: (-self.idf[t.key[i]], i)) for t in TEMPLATES}

    def places(self, at: dict[bytes, list[int]], phrase: tuple[bytes, ...]) -> list[int]:
        """Where the key phrase's words stand consecutively: the words' postings intersected by relative position, the rarest first."""
        order = self.order[phrase]
        starts = {p - order[0] for p in at.get(phrase[order[0]], ())}
        for i in order[1:]:
            if not starts:
                break
            here = at.get(phrase[i], ())
            starts &= {p - i for p in here}
        return sorted(starts)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[str], float]:
        """Base places with their labels; the method's labels; the best share of a template's words in place."""
        at: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in POSTINGS:
                at[w].append(p)
        if not at:
            return [], [], 0.0
        base = sorted((p, t.label) for t in BASE for p in self.places(at, t.key))
        best = 1.0 if base else 0.0
        labels = {label for _, label in base}
        for t in TEMPLATES:
            if t.base:
                continue
            key_at = self._key_at(t)
            for shift in {p - key_at + d for p in self.places(at, t.key) for d in range(-SLACK, SLACK + 1)}:
                hits = [w for q, w in enumerate(t.words) if 0 <= shift + q < len(words) and words[shift + q] == w]
                if len(set(hits)) >= self.agree:
                    labels.add(t.label)
                    best = max(best, len(hits) / len(t.words))
        return base, sorted(labels), best

    @staticmethod
    def _key_at(t: Template) -> int:
        return next(i for i in range(len(t.words)) if t.words[i : i + len(t.key)] == t.key)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The digest that op9 returns: one row a document."""
    frame = id_and_text(docs)
    scanner = Scanner(*document_frequencies(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                base, labels, score = scanner.scan(words)
                out.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(labels), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return frame.mapInArrow(scan, SCHEMA)
