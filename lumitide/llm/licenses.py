"""Licence notices by a positional index of rare words (operator 5).

The words of all notice templates are counted over all documents.  Each template is indexed under
its ``ANCHORS`` words of highest IDF, with their positions.  A file's indexed words are looked up
from the rarest on, and postings are intersected by file position minus template position.  A notice
stands where the template's first mandatory phrase stands word for word, at least ``AGREE`` of the
anchors agree with that place (within ``SLACK`` words), and the other mandatory phrases stand within
the template's stretch there.  Headers in files (those of the FSF, ISC and others) are templates
of their own, as long as the whole notice.  After the words of an SPDX line its expression is read:
each identifier of ``SPDX`` in it is a notice at its place, unknown ones are passed over.

Defined results: an empty or null text has no notice, and an empty table no row; rows with a null id
are counted but have no results; repeated rows are scanned each, so each has its notices, and rows
that share an id give the notices of each; a text of any length is scanned whole, in time that grows
with its length; a notice that occurs several times, also one right after the other, gives a row for
each place.  Where the words that make notices of the same licence overlap (a short one inside a long
one) the one with more words found is reported, of equals the first; notices of different licences are
all reported, also on one line.  Words of equal IDF are ranked by spelling.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import hash_words, text_slices, words

ANCHORS, SLACK, AGREE = 4, 3, 0.5

_GPL, _LGPL, _AGPL = "gnu general public license", "gnu lesser general public license", "gnu affero general public license"
_FSF = "is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation{}"
_ONLY = "is free software; you can redistribute it and/or modify it under the terms of the {} version {} as published by the Free Software Foundation"
_HEADERS = [
    *((name, of, f" {how} {n} of the license") for name, of, n in (("GPL-2.0", _GPL, 2), ("GPL-3.0", _GPL, 3), ("AGPL-3.0", _AGPL, 3)) for how in ("either version", "version")),
    ("LGPL", _LGPL, ""), ("LGPL", "gnu library general public license", ""),
]
_VERSIONS = [("GPL-2.0", _GPL, 2), ("GPL-3.0", _GPL, 3), *(("LGPL", _LGPL, v) for v in ("2.1", "3")), ("AGPL-3.0", _AGPL, 3)]

#: (licence, notice, mandatory phrases)
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("MIT", "Released under the MIT License.", ["mit license"]),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license version 2 0"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2.", ["gnu general public license", "version 2"]),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License.", ["gnu lesser general public license"]),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3.", ["gnu affero general public license"]),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["creative commons attribution noncommercial 4 0"]),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ["cc by sa 4 0"]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ["cc by 4 0"]),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0"]),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under the CC0 Public Domain Dedication.", ["public domain dedication"]),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
    ("proprietary", "All rights reserved.", ["all rights reserved"]),
    *((name, _FSF.format(of, version), [f"{of} as published by the free software foundation{version}"]) for name, of, version in _HEADERS),
    *((name, _ONLY.format(of, n), [f"{of} version {n} as published by the free software foundation"]) for name, of, n in _VERSIONS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"]),
    ("Zlib", "In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose", ["permission is granted to anyone to use this software for any purpose"]),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ["boost software license version 1 0"]),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0", ["eclipse public license v 2 0"]),
]

#: (licence, identifier in SPDX expressions)
SPDX: list[tuple[str, str]] = [
    *((x, x) for x in ("MIT", "MIT-0", "Apache-2.0", "MPL-2.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-4.0", "CC0-1.0", "Unlicense", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "ISC", "0BSD", "Zlib", "BSL-1.0", "EPL-2.0")),
    *(("LGPL", f"LGPL-{v}") for v in ("2.0", "2.1", "3.0")), ("BSD", "BSD-2-Clause"), ("BSD", "BSD-3-Clause"),
]
#: Words among which an unknown identifier or an exception of an SPDX expression and the next ``OR`` or ``AND`` are.
SPDX_WORDS = 6
SPDX_LINE = "SPDX-License-Identifier"
_OR, _AND, _WITH, _ONLY_WORD, _LATER = (int(x) for x in hash_words("or and with only later"))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word of the sorted vocabulary occurs, and how many documents there are."""
    maybe = _filter(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocab), np.int64), 0
        for b in text_slices(batches):
            w = words(b.column("text"))
            n += b.num_rows
            at, k = lookup(w.hash, vocab, maybe)
            pair = np.unique(w.row()[at] * len(vocab) + k)
            df += np.bincount(pair % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(vocab)), -1)), pa.array(np.append(df, n))], names=["k", "n"])

    rows = _source(docs).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    by = {r.k: r.n for r in rows}
    return np.array([by.get(k, 0) for k in range(len(vocab))]), by.get(-1, 0)


def _filter(vocab: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocab >> np.uint64(48)).astype(np.int64)] = True
    return maybe


def lookup(h: np.ndarray, vocab: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where h holds words of the sorted vocabulary, and which."""
    at = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
    k = np.minimum(np.searchsorted(vocab, h[at]), len(vocab) - 1)
    ok = vocab[k] == h[at]
    return at[ok], k[ok]


def _offset(text: np.ndarray, phrase: np.ndarray) -> int:
    """Where a notice holds its first mandatory phrase."""
    for i in range(len(text) - len(phrase) + 1):
        if np.array_equal(text[i : i + len(phrase)], phrase):
            return i
    raise ValueError("a notice must hold its first mandatory phrase")


def spelled(notice: str) -> list[str]:
    """The words of a notice, which has ASCII letters and digits only."""
    return re.findall(r"[0-9a-z]+", notice.lower())


class Notices:
    def __init__(self, templates: list[tuple[str, str, list[str]]], vocab: np.ndarray, df: np.ndarray, n: int):
        self.names = [t[0] for t in templates]
        self.text = [hash_words(t[1]) for t in templates]
        self.phrases = [[hash_words(p) for p in t[2]] for t in templates]
        self.offset = [_offset(h, p[0]) for h, p in zip(self.text, self.phrases)]
        rank = dict(zip(vocab.tolist(), df.tolist()))
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.anchors = []
        for t, h in enumerate(self.text):
            named = {int(x): w for x, w in zip(h, spelled(templates[t][1]))}
            rare = sorted(named, key=lambda x: (rank[x], named[x]))[:ANCHORS]
            self.anchors.append(len(rare))
            for p, x in enumerate(h.tolist()):
                if x in rare:
                    self.postings[x].append((t, p))
        self.idf = {x: math.log((n + 1) / (d + 1)) for x, d in rank.items()}
        self.spdx = {tuple(hash_words(x).tolist()): name for name, x in SPDX}
        self.line = hash_words(SPDX_LINE).tolist()
        self.vocab = np.unique(np.array([*self.postings, self.line[0]], np.uint64))
        self.maybe = _filter(self.vocab)

    def expression(self, doc: list[int], begin: int) -> list[tuple[str, int, int, float, int]]:
        """The notices of the SPDX line whose first word is at begin, if one is."""
        n, out = len(self.line), []
        if doc[begin : begin + n] != self.line:
            return out
        i = begin + n
        while True:
            size = next((k for k in range(min(5, len(doc) - i), 0, -1) if tuple(doc[i : i + k]) in self.spdx), 0)
            if size:
                out.append((self.spdx[tuple(doc[i : i + size])], i, n + size, 1.0, size))
            i += size
            if size:
                i += 2 if doc[i : i + 2] == [_OR, _LATER] else doc[i : i + 1] == [_ONLY_WORD]
            far = SPDX_WORDS if not size or doc[i : i + 1] == [_WITH] else 1
            step = next((k for k, x in enumerate(doc[i : i + far]) if x in (_OR, _AND)), -1)
            if step < 0:
                return out
            i += step + 1

    def find(self, doc: np.ndarray, at: list[int]) -> list[tuple[str, int, int, float]]:
        """(licence, position, anchors that agree, share of the notice's words) in a document; at: where its indexed words are."""
        votes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for x, p in sorted(((int(doc[p]), p) for p in at), key=lambda v: (-self.idf[v[0]], v[1])):
            for t, q in self.postings[x]:
                votes[t].append((p - q, x, p))
        found = []
        for t, seen in votes.items():
            need = max(1, int(np.ceil(self.anchors[t] * AGREE)))
            if len({x for _, x, _ in seen}) < need:
                continue
            seen.sort()
            size, words_of = len(self.text[t]), np.unique(self.text[t])
            first, off = self.phrases[t][0], self.offset[t]
            i = j = 0
            for place in _places(doc, first, [s + off for s, _, _ in seen]):
                shift = place - off
                while i < len(seen) and seen[i][0] < shift - SLACK:
                    i += 1
                j = max(i, j)
                while j < len(seen) and seen[j][0] <= shift + SLACK:
                    j += 1
                near: dict[int, tuple[int, int]] = {}  # of each anchor the occurrence that agrees best
                for s, x, p in seen[i:j]:
                    if x not in near or abs(s - shift) < near[x][0]:
                        near[x] = abs(s - shift), p
                if len(near) < need:
                    continue
                stretch = doc[max(0, shift - SLACK) : shift + size + SLACK]
                if all(_holds(stretch, p) for p in self.phrases[t][1:]):
                    share = float(np.isin(words_of, stretch).mean())
                    held = [p for _, p in near.values()]
                    found.append((self.names[t], max(0, shift), len(near), share, size, min(place, *held), max(place + len(first), *(p + 1 for p in held))))
        if lines := [p for p in at if int(doc[p]) == self.line[0]]:
            every = doc.tolist()
            found += [(*f, f[1], f[1] + f[4]) for p in lines for f in self.expression(every, p)]
        found.sort(key=lambda f: (-f[3] * f[4], f[1], f[0]))
        taken: dict[str, list[tuple[int, int]]] = defaultdict(list)  # spans of each licence, in order
        out = []
        for f in found:
            spans, k = taken[f[0]], bisect_left(taken[f[0]], f[5:])
            if (k and spans[k - 1][1] > f[5]) or (k < len(spans) and spans[k][0] < f[6]):
                continue
            spans.insert(k, f[5:])
            out.append(f[:4])
        return sorted(out, key=lambda f: (f[1], f[0]))


def _places(doc: np.ndarray, phrase: np.ndarray, near: list[int]) -> list[int]:
    """Where the phrase stands, word for word, within SLACK of one of the places."""
    at = np.unique((np.array(near)[:, None] + np.arange(-SLACK, SLACK + 1)).reshape(-1))
    at = at[(at >= 0) & (at + len(phrase) <= len(doc))]
    for k, x in enumerate(phrase):
        at = at[doc[at + k] == x]
    return at.tolist()


def _holds(region: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(phrase)
    return any(np.array_equal(region[i : i + n], phrase) for i in np.flatnonzero(region[: len(region) - n + 1] == phrase[0]).tolist()) if len(region) >= n else False


def find_licenses(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """``doc_id, license, position, anchors, share``: every notice found; position: index of its first word."""
    spark = docs.sparkSession
    vocab = np.unique(np.concatenate([hash_words(t[1]) for t in templates] + [hash_words(SPDX_LINE)]))
    df, n = document_frequencies(docs, vocab)
    shared = spark.sparkContext.broadcast(Notices(templates, vocab, df, n))
    schema = "doc_id long, license string, position long, anchors int, share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = shared.value
        for b in text_slices(batches):
            w = words(b.column("text"))
            at, _ = lookup(w.hash, notices.vocab, notices.maybe)
            row = np.searchsorted(w.first, at, "right") - 1
            cut = np.flatnonzero(np.diff(row)) + 1
            rows = []
            for part in np.split(at, cut) if len(at) else []:
                r = int(np.searchsorted(w.first, part[0], "right")) - 1
                if (key := b.column("doc_id")[r].as_py()) is not None:
                    rows += [(key, *f) for f in notices.find(w.hash[w.first[r] : w.first[r + 1]], (part - w.first[r]).tolist())]
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "license", "position", "anchors", "share"])

    return _source(docs).mapInArrow(run, schema)
