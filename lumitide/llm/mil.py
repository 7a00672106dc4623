"""Quality classifier by attention-based multiple-instance learning (operator 7).

A document is a bag of passages of ``PASSAGE`` words, and every passage is encoded: the
logarithms of the counts of a learnt vocabulary of words and of word beginnings, and shape figures (capitals, symbols, digits,
spaces, word length, repeated words), through one tanh layer.  For each of two document labels,
quality and toxicity, gated attention (Ilse et al., 2018) weighs the passages, and the weighted sum of their
codes is scored.  Only document labels are used to train.  A document is rejected if its quality
probability is under ``cut`` or its toxicity probability is at or over it.

Training uses at most ``train_docs`` labelled documents, those with the smallest hashes of their
ids, and of these, in this order, those that fit into ``train_bytes`` of text; this bound is the operator's
only sample.  Scoring covers all documents and all of each text.

Defined results: a document without words has no passage; it has quality 0, toxicity 0 and is
rejected.  Labels with a null, and labels of absent documents, are ignored; of repeated labels the
lowest quality and the highest toxicity count.  Where a label has one value only (or there are none) that head
is constant: quality 1 or toxicity 0, which rejects nothing; if there are labels of which none could be used, this
is logged as a warning.  Rows with a null id are scored too, and repeated rows each; of rows that share an id the
smallest text is trained on.  A probability that equals ``cut`` is good quality, or toxic.  A text of any length is
read whole; an empty table gives no rows.  Extra columns, whatever they are called, are kept by :func:`kept` and
ignored elsewhere.
"""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_rows, save, small
from .tokens import _VAL, _borders, mix, text_slices, utf8, word_hashes

#: Lengths in bytes of the word beginnings that are features, too: inflected and compound forms share them.
STEMS = (5, 7)
PASSAGE, TRAIN_DOCS, TRAIN_BYTES, VOCAB, HIDDEN, ATTENTION, EPOCHS, CUT, SEED = 64, 4000, 64 << 20, 128, 24, 16, 160, 0.5, 5

_FOLD = _VAL.copy()
_FOLD[65:91] = _VAL[97:123]
_KINDS = np.zeros((256, 6), np.float32)  # capital, small, digit, space, symbol, byte
_KINDS[65:91, 0] = _KINDS[97:123, 1] = _KINDS[48:58, 2] = 1
_KINDS[[9, 10, 13, 32], 3] = 1
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 4] = 1
_KINDS[:, 5] = 1
_LABEL = np.select([_KINDS[:, k] > 0 for k in range(5)], np.arange(5, dtype=np.uint8), np.uint8(5)).astype(np.int64)


@dataclasses.dataclass
class Passages:
    """Words and word beginnings (hash, passage), shape figures of each passage, and each document's first passage."""

    hash: np.ndarray
    of: np.ndarray
    shape: np.ndarray
    first: np.ndarray


def passages(col: pa.Array) -> Passages:
    buf, off = utf8(col)
    if not len(buf):
        return Passages(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, 9), np.float32), np.zeros(len(off), np.int64))
    starts, ends = _borders(buf, off[:-1])
    h = word_hashes(buf, starts, ends, _FOLD)
    words = np.searchsorted(starts, off)
    n = np.diff(words)
    n_pass = -(-n // PASSAGE)
    first = np.append(0, np.cumsum(n_pass))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - np.repeat(words[:-1], n)
    of = first[row] + place // PASSAGE
    head = np.flatnonzero(place % PASSAGE == 0)
    total = first[-1]
    if not total:
        return Passages(h, of, np.empty((0, 9), np.float32), first)
    # bytes from a passage's first word to the next passage's, or the text's end
    begin = starts[head]
    end = np.append(begin[1:], off[-1])
    last = np.append(row[head][1:] != row[head][:-1], True)
    end[last] = off[1:][row[head]][last]
    size = (end - begin).astype(np.float32)
    kinds = np.stack([np.add.reduceat(_LABEL[buf] == k, begin, dtype=np.int32) for k in range(5)], 1).astype(np.float32)
    spill = np.flatnonzero(np.append(begin[1:], off[-1]) != end)  # reduceat went on into the next text's lead
    for p in spill.tolist():
        kinds[p] = np.bincount(_LABEL[buf[begin[p] : end[p]]], minlength=6)[:5]
    count = np.bincount(of, minlength=total).astype(np.float32)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    length = np.bincount(of, ends - starts, minlength=total).astype(np.float32)
    letters = kinds[:, 0] + kinds[:, 1] + 1
    shape = np.stack(
        [kinds[:, 0] / letters, kinds[:, 4] / size, kinds[:, 2] / size, kinds[:, 3] / size, kinds[:, 4] / count, length / count / 8, np.bincount(of, again, minlength=total) / count, count / PASSAGE, np.ones(total, np.float32)], 1
    )
    every, places = [h], [of]
    for k in STEMS:
        at = np.flatnonzero(ends - starts > k)
        every.append(mix(word_hashes(buf, starts[at], starts[at] + k, _FOLD) + np.uint64(k)))
        places.append(of[at])
    return Passages(np.concatenate(every), np.concatenate(places), shape.astype(np.float32), first)


@dataclasses.dataclass
class Model:
    vocab: np.ndarray  # sorted word hashes
    w: dict[str, np.ndarray]
    constant: tuple[float | None, float | None]

    def lookup(self, p: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, vocabulary index and log count of every known word of a passage."""
        if not len(self.vocab) or not len(p.hash):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        if not hasattr(self, "maybe"):
            self.maybe = np.zeros(1 << 18, bool)
            self.maybe[(self.vocab >> np.uint64(46)).astype(np.int64)] = True
        at = np.flatnonzero(self.maybe[(p.hash >> np.uint64(46)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.vocab, p.hash[at]), len(self.vocab) - 1)
        ok = self.vocab[k] == p.hash[at]
        pair = p.of[at[ok]] * len(self.vocab) + k[ok]
        pair.sort()
        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
        n = np.diff(np.append(begin, len(pair)))
        return pair[begin] // len(self.vocab), pair[begin] % len(self.vocab), np.log1p(n).astype(np.float32)

    def scores(self, p: Passages) -> tuple[np.ndarray, np.ndarray]:
        """(documents, 2) probabilities of quality and toxicity; (passages, 2) attention weights."""
        n = len(p.first) - 1
        out = np.zeros((n, 2))
        some = np.flatnonzero(np.diff(p.first) > 0)
        if not len(some):
            return out, np.zeros((0, 2))
        row, k, v = self.lookup(p)
        x = np.zeros((len(p.shape), len(self.vocab)), np.float32)
        x[row, k] = v
        z, a = forward(self.w, x, p.shape, p.first[some])[:2]
        out[some] = 1 / (1 + np.exp(-z))
        for t, c in enumerate(self.constant):
            if c is not None:
                out[some, t] = c
        return out, a


def forward(w: dict[str, np.ndarray], x: np.ndarray, shape: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ w["e"] + ((shape - w["mean"]) / w["sd"]) @ w["s"] + w["b"])
    v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    s = (v * u) @ w["a"]  # gated attention, a column for each label
    n = np.diff(np.append(first, len(h)))
    bag = np.repeat(np.arange(len(first)), n)
    ex = np.exp(s - np.maximum.reduceat(s, first, axis=0)[bag])
    a = ex / np.add.reduceat(ex, first, axis=0)[bag]
    z = np.stack([np.add.reduceat(a[:, t : t + 1] * h, first, axis=0) for t in range(2)], 1)  # bag, label, hidden
    return np.einsum("bth,ht->bt", z, w["c"]) + w["d"], a, h, v, u, z, bag


def gradients(w: dict[str, np.ndarray], x: np.ndarray, shape: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the bags, both labels added, and its derivatives by back-propagation."""
    out, a, h, v, u, z, bag = forward(w, x, shape, first)
    loss = float((np.logaddexp(0, out) - y * out).sum() / len(y))
    d_out = (1 / (1 + np.exp(-out)) - y) / len(y)
    d = {"d": d_out.sum(0), "c": np.einsum("bth,bt->ht", z, d_out)}
    d_z = d_out[:, :, None] * w["c"].T[None]
    d_h, d_s = np.zeros_like(h), np.zeros_like(a)
    for t in range(2):
        d_h += a[:, t : t + 1] * d_z[bag, t]
        d_a = (h * d_z[bag, t]).sum(1)
        mean = np.add.reduceat(a[:, t] * d_a, first)
        d_s[:, t] = a[:, t] * (d_a - mean[bag])
    d["a"] = (v * u).T @ d_s
    d_vu = d_s @ w["a"].T
    d_v, d_u = d_vu * u * (1 - v * v), d_vu * v * u * (1 - u)
    d["v"], d["u"] = h.T @ d_v, h.T @ d_u
    d_h = (d_h + d_v @ w["v"].T + d_u @ w["u"].T) * (1 - h * h)
    d["e"], d["s"], d["b"] = x.T @ d_h, ((shape - w["mean"]) / w["sd"]).T @ d_h, d_h.sum(0)
    return loss, d


def train(texts: pa.Array, labels: np.ndarray, vocab: int = VOCAB, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """labels: (documents, 2), quality and toxicity; documents without words are left out."""
    rng = np.random.default_rng(seed)
    constant = tuple(None if len(labels) and labels[:, t].min() < labels[:, t].max() else float(t == 0) for t in range(2))
    p = passages(texts)
    some = np.flatnonzero(np.diff(p.first) > 0)
    y = labels[some].astype(np.float32)
    bag_of = np.repeat(np.arange(len(p.first) - 1), np.diff(p.first))
    chosen = [np.empty(0, np.uint64)]
    if len(some):
        bag = bag_of[p.of]
        order = np.lexsort((bag, p.hash))
        f, bag = p.hash[order], bag[order]
        new = np.append(True, (f[1:] != f[:-1]) | (bag[1:] != bag[:-1]))
        f, bag = f[new], bag[new]
        words, inverse, n = np.unique(f, return_inverse=True, return_counts=True)
        for t in range(2):  # the words whose presence in a document goes with a label
            pos = np.bincount(inverse, labels[bag, t], minlength=len(words))
            rate = np.clip(y[:, t].mean(), 1e-3, 1 - 1e-3)
            z = np.abs(pos - n * rate) / np.sqrt(n * rate * (1 - rate))
            z[n < 5] = 0
            chosen.append(words[np.lexsort((words, -z))[: vocab // 2]])
    model = Model(np.unique(np.concatenate(chosen)), {}, constant)
    g = lambda *n: (rng.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
    w = {"e": g(len(model.vocab), hidden), "s": g(9, hidden), "b": np.zeros(hidden, np.float32), "v": g(hidden, ATTENTION), "u": g(hidden, ATTENTION), "a": g(ATTENTION, 2), "c": g(hidden, 2), "d": np.zeros(2, np.float32)}
    w["mean"], w["sd"] = (p.shape.mean(0), p.shape.std(0) + 1e-3) if len(some) else (np.zeros(9, np.float32), np.ones(9, np.float32))
    model.w = w
    if constant == (1.0, 0.0) or not len(some):
        model.constant = (1.0, 0.0)
        return model
    row, k, val = model.lookup(p)
    x = np.zeros((len(p.shape), len(model.vocab)), np.float32)
    x[row, k] = val
    first = p.first[some]
    names = ["e", "s", "b", "v", "u", "a", "c", "d"]
    m1, m2 = ({n: np.zeros_like(w[n]) for n in names} for _ in range(2))
    for step in range(1, epochs + 1):
        d = gradients(w, x, p.shape, first, y)[1]
        d["e"] += 1e-5 * w["e"]
        rate = 0.03 * min(1.0, 3 * (1 - step / (epochs + 1)))
        for n in names:
            m1[n] += 0.1 * (d[n] - m1[n])
            m2[n] += 0.01 * (d[n] ** 2 - m2[n])
            w[n] -= (rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, **params) -> Model:
    """A model of the labelled documents' sample, trained on the driver."""
    lab = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    lab = lab.agg((F.min("quality") > 0).cast("int").alias("quality"), (F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.select("doc_id").join(lab, "doc_id").dropDuplicates(["doc_id"])
    known = small(save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)))
    sample = texts.join(known, "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    order = F.xxhash64("doc_id")
    sizes = sample.select("doc_id", F.octet_length("text").alias("size")).orderBy(order, "doc_id").collect()
    total, fits = 0, []
    for r in sizes:
        if total + r["size"] <= train_bytes:  # one that doesn't fit is passed over
            total += r["size"]
            fits.append(r["doc_id"])
    rows = (sample if len(fits) == len(sizes) else sample.where(F.col("doc_id").isin(fits))).toArrow().sort_by("doc_id")
    y = np.stack([rows.column("quality").to_numpy(), rows.column("toxic").to_numpy()], 1) if rows.num_rows else np.empty((0, 2))
    if not rows.num_rows and not labels.isEmpty():
        logging.getLogger(__name__).warning("no labelled document could be used in training; nothing but texts without words will be rejected")
    return train(rows.column("text"), y, **params)


def _reject(p: np.ndarray, cut: float) -> np.ndarray:
    return (p[:, 0] < cut) | (p[:, 1] >= cut)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``doc_id, n_passages, quality, toxic, keep`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, limit=1 << 21):
            p = passages(b.column("text"))
            s, _ = shared.value.scores(p)
            cols = [b.column("doc_id"), pa.array(np.diff(p.first)), pa.array(s[:, 0].round(6)), pa.array(s[:, 1].round(6)), pa.array(~_reject(s, cut))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_passages", "quality", "toxic", "keep"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_passages long, quality double, toxic double, keep boolean")


def kept(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs that the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, limit=1 << 21):
            s, _ = shared.value.scores(passages(b.column("text")))
            yield b.filter(pa.array(~_reject(s, cut)))

    return map_rows(docs, run)
