"""Benchmark decontamination with BM25 and block-max WAND (operator 4).

The test items are the indexed side: items, in units of at most ``STRIDE`` words (the last unit of a
longer item is its last ``STRIDE`` words), get postings whose impact is the BM25 weight divided by the
unit's greatest attainable score, so that one threshold (a share of that score) holds for all.  Every
passage (windows of 2 * STRIDE words, one each STRIDE words, so that any run of STRIDE words lies whole
in one) of every document is a query.

* The pivot test is made for all passages of a batch at once: a unit can only reach the
  threshold if its essential terms alone reach the threshold less what all its other terms
  could add.  This bound drops no result.
* Passages that hold such a unit run block-max WAND: postings lists in unit order, pivot by term
  maxima, then by block maxima, skipping blocks that can't reach the threshold.
* A hit's region is its passage with as many words on both sides as the item has; regions of an item
  that meet are one.  Each is verified: the share of the question's and of the answer's word n-grams that
  occur in it.  The answer is the item's last sentence; of an item of one sentence, its last fifth.

Defined results: empty or null texts and items never match, and empty tables give no rows; items and
documents with a null id are ignored; items that share an id are units of one item, each verified by
itself, and documents that share an id are one in the result, with the greatest figures of its rows;
texts and items of any length are read whole, in time that grows with the words of the text and of the
items found in it; a score or share that equals its threshold counts.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import hash_words, mix, text_slices, words

STRIDE, BLOCK, K1, B, THRESHOLD, QUESTION, ANSWER = 64, 16, 1.2, 0.75, 0.6, 0.7, 0.7
#: Items of about so many bytes are indexed at a time, which makes some 80 MB of index; a larger benchmark takes several scans of the documents.
INDEX_BYTES = 4 << 20

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def halves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and of its answer."""
    h = hash_words(text)
    parts = [n for s in SENTENCE.split(text) if (n := len(hash_words(s)))]
    n = parts[-1] if len(parts) > 1 else max(1, len(h) // 5)
    return h[: len(h) - n], h[len(h) - n :]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words, or of the whole if it is shorter."""
    n = min(n, len(h))
    if not n:
        return np.empty(0, np.uint64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(g)


def shares(parts: tuple[tuple[np.ndarray, int], ...], region: np.ndarray) -> list[float]:
    """Share of each part's n-grams that occur in region; 1 for an empty part."""
    out = []
    for part, n in parts:
        g = grams(part, n)
        n = min(n, len(part))
        out.append(1.0 if not len(g) else float(np.isin(g, grams(region, n)).mean()) if len(region) >= n else 0.0)
    return out


class Index:
    """Postings of units with normalised BM25 impacts, and their block maxima, in flat arrays.

    df: sorted word hashes and in how many of all units each occurs.
    """

    def __init__(self, items: list[tuple[int, str]], df: tuple[np.ndarray, np.ndarray], n_units: int, mean: float, threshold: float):
        self.threshold = threshold
        self.parts: dict[int, tuple[int, np.ndarray, np.ndarray, int]] = {}
        of, terms, impacts, sizes = [], [], [], []
        for key, (item, text) in enumerate(items):
            h = hash_words(text)
            self.parts[key] = (item, *halves(text), len(h))
            for u in unit_words(h):
                of.append(key)
                t, tf = np.unique(u, return_counts=True)
                d = df[1][np.searchsorted(df[0], t)].astype(float)
                w = np.log(1 + (n_units - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(u) / mean))
                terms.append(t)
                impacts.append(w / w.sum())
                sizes.append(len(t))
        self.item = np.array(of, np.int32)
        term, impact = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((terms, np.uint64), (impacts, float)))
        unit = np.repeat(np.arange(len(of), dtype=np.int32), sizes)
        # what a unit's lightest terms could add in all is known: rest; the others are essential
        order = np.lexsort((term, impact, unit))
        begin = np.append(0, np.cumsum(sizes)).astype(np.int64)[:-1]
        run = np.cumsum(impact[order])
        before = np.repeat(run[begin] - impact[order][begin], sizes) if len(of) else run
        light = run - before <= threshold / 2
        self.rest = np.bincount(unit[order][light], impact[order][light], minlength=len(of))
        essential = order[~light]
        essential = essential[np.lexsort((unit[essential], term[essential]))]
        self.vocab, first = np.unique(term[essential], return_index=True)
        self.first = np.append(first, len(essential))
        self.e_unit, self.e_impact = unit[essential], impact[essential]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.vocab >> np.uint64(46)).astype(np.int64)] = True
        order = np.lexsort((unit, term))
        self.terms, start = np.unique(term[order], return_index=True)
        self.start = np.append(start, len(order))
        self.units, self.impact = array("i", unit[order].tobytes()), array("d", impact[order].tobytes())
        n = np.diff(self.start)
        blocks = -(-n // BLOCK)
        self.block_start = np.append(0, np.cumsum(blocks)).astype(np.int64)
        cut = np.repeat(start, blocks) + (np.arange(blocks.sum()) - np.repeat(self.block_start[:-1], blocks)) * BLOCK
        self.block = np.maximum.reduceat(impact[order], cut) if len(cut) else np.empty(0)
        self.top = np.maximum.reduceat(self.block, self.block_start[:-1]) if len(cut) else np.empty(0)
        self.block = array("d", self.block.tobytes())

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All units whose score for these distinct terms reaches the threshold, by block-max WAND."""
        terms = np.asarray(terms, np.uint64)
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        lists = [(int(self.start[k]), int(self.start[k + 1]), float(self.top[k]), int(self.block_start[k])) for k in at[self.terms[at] == terms].tolist()] if len(self.terms) else []
        units, impact, block = self.units, self.impact, self.block
        out, end = [], len(self.item)
        goal = self.threshold - 1e-9
        live = sorted([units[x[0]], n, x[0]] for n, x in enumerate(lists))  # unit at the cursor, list, cursor
        while live:
            total, pivot = 0.0, None
            for n, (_, k, _) in enumerate(live):
                total += lists[k][2]
                if total >= goal:
                    pivot = n
                    break
            if pivot is None:
                break
            unit = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == unit:
                pivot += 1
            until = live[pivot + 1][0] if pivot + 1 < len(live) else end
            bound = 0.0
            for cursor in live[: pivot + 1]:  # shallow move: the block that would hold unit
                begin, stop, _, blocks = lists[cursor[1]]
                i = bisect_left(units, unit, cursor[2], stop)
                cursor[2] = i
                if i < stop:
                    nth = (i - begin) // BLOCK
                    bound += block[blocks + nth]
                    until = min(until, units[min(begin + (nth + 1) * BLOCK, stop) - 1] + 1)
            to = unit + 1
            if bound < goal:
                to = max(until, to)
            else:
                score = 0.0
                for _, k, i in live[: pivot + 1]:
                    if i < lists[k][1] and units[i] == unit:
                        score += impact[i]
                if score >= goal:
                    out.append((unit, score))
            moved = []
            for _, k, i in live[: pivot + 1]:
                i = bisect_left(units, to, i, lists[k][1])
                if i < lists[k][1]:
                    moved.append([units[i], k, i])
            live = sorted(moved + live[pivot + 1 :])
        return out

    def candidates(self, h: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Distinct (row << 32 | passage) that may hold a unit at the threshold."""
        hit = np.flatnonzero(self.maybe[(h >> np.uint64(46)).astype(np.int64)])
        k = np.searchsorted(self.vocab, h[hit])
        ok = (k < len(self.vocab)) & (self.vocab[np.minimum(k, len(self.vocab) - 1)] == h[hit])
        hit, k = hit[ok], k[ok]
        p = place[hit] // STRIDE
        n_pass = np.maximum(1, -(-np.bincount(row, minlength=1) // STRIDE))
        offset = np.append(0, np.cumsum(n_pass))
        at = offset[row[hit]] + p
        v = len(self.vocab)
        both = np.concatenate([at * v + k, ((at - 1) * v + k)[p > 0]])
        if not len(both):
            return both
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])]
        passage, kk = both // v, both % v
        n = self.first[kk + 1] - self.first[kk]
        post = np.repeat(self.first[kk] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        pair = np.repeat(passage, n) * len(self.item) + self.e_unit[post]
        order = np.argsort(pair)
        pair = pair[order]
        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        score = np.add.reduceat(self.e_impact[post][order], begin)
        pair = pair[begin]
        ok = score + self.rest[pair % len(self.item)] >= self.threshold - 1e-9
        passage = np.unique(pair[ok] // len(self.item))
        r = np.searchsorted(offset, passage, "right") - 1
        return r << 32 | (passage - offset[r])

    def hits(self, h: np.ndarray, first: np.ndarray, question: float, answer: float) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question share, answer share) of the verified hits."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        found: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for c in sorted(self.candidates(h, row, place).tolist()):
            r, p = c >> 32, c & 0xFFFFFFFF
            for unit, score in self.search(np.unique(h[first[r] + p * STRIDE : min(first[r + 1], first[r] + (p + 2) * STRIDE)])):
                found[r, int(self.item[unit])].append((p, score))
        out = []
        for (r, key), at in found.items():
            item, q, a, n = self.parts[key]
            doc = h[first[r] : first[r + 1]]
            i = 0
            while i < len(at):
                j, score = i + 1, at[i][1]
                while j < len(at) and (at[j][0] - at[j - 1][0]) * STRIDE <= 2 * STRIDE + 2 * n:
                    score = max(score, at[j][1])
                    j += 1
                qs, as_ = shares(((q, 5), (a, 3)), doc[max(0, at[i][0] * STRIDE - n) : (at[j - 1][0] + 2) * STRIDE + n])
                if qs >= question and as_ >= answer:
                    out.append((r, item, score, qs, as_))
                i = j
        return out


def unit_words(h: np.ndarray) -> list[np.ndarray]:
    """An item's units: each STRIDE words, and the last STRIDE words if some are left."""
    return [h[i : i + STRIDE] for i in range(0, len(h) - STRIDE + 1, STRIDE)] + ([h[-STRIDE:]] if len(h) % STRIDE else [])


def frequencies(units: list[np.ndarray], known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and in how many units each occurs, those known before included."""
    words_of = [np.unique(u) for u in units]
    h = np.concatenate([*words_of, *([known[0]] if known else []), np.empty(0, np.uint64)])
    n = np.concatenate([np.ones(len(h) - (len(known[0]) if known else 0), np.int64), *([known[1]] if known else [])])
    t, inverse = np.unique(h, return_inverse=True)
    return t, np.bincount(inverse, n, minlength=len(t)).astype(np.int64)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every document that holds an item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / INDEX_BYTES))
    load = lambda k: sorted(map(tuple, (items if shards == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k)).collect()))
    df, n_units, n_words = None, 0, 0
    for k in range(shards):
        loaded = load(k)
        units = [u for _, text in loaded for u in unit_words(hash_words(text))]
        n_units, n_words, df = n_units + len(units), n_words + sum(map(len, units)), frequencies(units, df)
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], schema)
    for k in range(shards if n_units else 0):
        index = Index(loaded if shards == 1 else load(k), df, n_units, n_words / n_units, threshold)
        if not len(index.item):
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches):
                w = words(b.column("text"))
                rows = [(b.column("doc_id")[r].as_py(), *x) for r, *x in shared.value.hits(w.hash, w.first, question, answer)]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), *[pa.float64()] * 3])]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = src.mapInArrow(run, schema)
        found = part if k == 0 else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(*[F.round(F.max(c), 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
