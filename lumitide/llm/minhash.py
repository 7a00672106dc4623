"""MinHash near-duplicate groups with sequential Bayesian verification (operator 3).

1. Each text becomes its set of word ``shingle``-grams and a signature of ``bands * rows``
   minima, stored once.  Texts with the same sequence of words form one exact class, of which
   only the smallest id goes on.
2. Banding gives candidates (:func:`.groups.link` lists only those that can matter).
3. Each candidate pair is compared ``step`` minima at a time.  With a uniform prior the
   similarity after m agreements in n is Beta(m + 1, n - m + 1); the pair is dropped as soon as
   P(similarity >= threshold) < ``miss``.
4. Survivors are verified by the exact Jaccard similarity of their shingle sets.

Defined results: a text without words has no duplicates, and an empty table gives no rows; rows with a null id are
left out (:func:`keep_one` keeps them); rows that share an id are one document, near to whatever any of its texts is
near to, and :func:`keep_one` keeps the one of those rows whose text, then language, then source, then whole row in
JSON is the smallest; texts of any length are read whole; a pair whose similarity equals the threshold holds.  Extra
columns, whatever they are called, are kept as they are by :func:`keep_one` and ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import in_cells, link
from .store import columns, save, small
from .tokens import mix, ngrams, sequence_hash, text_slices, words

SHINGLE, BANDS, ROWS, THRESHOLD, STEP, MISS = 3, 32, 4, 0.5, 16, 0.002


def signature_params(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(g: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Minima of n permutations for each non-empty row; first: where each row's shingles begin in g."""
    a, b = signature_params(n)
    x = (g >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), n), np.uint32)
    step = 1 << 17
    i = 0
    ends = np.append(first[1:], len(x))
    while i < len(first):  # pieces that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(ends, first[i] + step, "right")))
        part, at = x[first[i] : ends[j - 1]], first[i:j] - first[i]
        t = np.empty_like(part)
        for k in range(n):
            np.multiply(part, a[k], out=t)
            t += b[k]
            out[i:j, k] = np.minimum.reduceat(t, at)
        i = j
    return out


def describe(docs: DataFrame, shingle: int = SHINGLE, total: int = BANDS * ROWS) -> DataFrame:
    """``id, exact, sig`` of every row with words: hash of its word sequence, and signature."""
    schema = pa.schema([("id", pa.int64()), ("exact", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            w = words(b.column("text"))
            g, r = ngrams(w, shingle)
            which, first = np.unique(r, return_index=True)
            if not len(which):
                continue
            sig = signatures(g, first, total)
            raw = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(0, sig.nbytes + 1, 4 * total, dtype=np.int32)), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(which)), pa.array(sequence_hash(w)[which].view(np.int64)), raw], schema=schema)

    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "id long, exact long, sig binary")


def band_keys(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``key, id``: the bucket of every band of every signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for b in batches:
            if not b.num_rows:
                continue
            parts = matrix(b.column("sig")).reshape(b.num_rows, bands, rows).astype(np.uint64)
            key = np.broadcast_to(salt, parts.shape[:2]).copy()
            for k in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
            ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return sigs.select("id", "sig").mapInArrow(run, "key long, id long")


def matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), -1)


def least_matches(threshold: float, step: int, total: int, miss: float) -> dict[int, int]:
    """For n = step, 2 step, ...: the fewest agreements with P(similarity >= threshold) >= miss."""

    def tail(m: int, n: int) -> float:  # of Beta(m + 1, n - m + 1) above threshold: at most m of n + 1 Bernoulli(threshold) draws
        return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return {n: next(m for m in range(n + 1) if tail(m, n) >= miss) for n in range(step, total + 1, step)}


def passing(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Whether the sequential posterior test lets each pair of rows i, j pass."""
    alive, agree, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, need in least.items():
        agree += (sig[i[alive], done:n] == sig[j[alive], done:n]).sum(1)
        ok = agree >= need
        alive, agree, done = alive[ok], agree[ok], n
    out = np.zeros(len(i), bool)
    out[alive] = True
    return out


def prune(pairs: DataFrame, sigs: DataFrame, threshold: float = THRESHOLD, step: int = STEP, miss: float = MISS) -> DataFrame:
    """The pairs ``a, b`` that the sequential posterior test doesn't drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = matrix(b.column("sa")), matrix(b.column("sb"))
            least = least or least_matches(threshold, step, x.shape[1], miss)
            pair = np.arange(b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(passing(np.concatenate([x, y]), pair, pair + b.num_rows, least)))

    s = sigs.select("id", "sig")
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def jaccard(left: pa.Array, right: pa.Array, shingle: int) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of each pair of texts."""
    out = np.zeros(len(left))
    sets = []
    for col in (left, right):
        g, r = ngrams(words(col), shingle)
        sets.append((g, np.searchsorted(r, np.arange(len(col) + 1))))
    (g, fa), (h, fb) = sets
    for i in range(len(left)):
        x, y = np.unique(g[fa[i] : fa[i + 1]]), np.unique(h[fb[i] : fb[i + 1]])
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = both / max(1, len(x) + len(y) - both)
    return out


def verify_exact(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``a, b, similarity`` of the pairs at or above the threshold."""
    pairs = save(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = save(texts.join(small(save(ids)), "doc_id", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_slices(batches, "ta", 1 << 20):
            for b in text_slices(iter([some]), "tb", 1 << 20):  # both sides are bounded
                sim = jaccard(b.column("ta"), b.column("tb"), shingle)
                out = b.select(["a", "b"]).append_column("similarity", pa.array(sim))
                yield out.filter(pa.array(sim >= threshold))

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, step: int = STEP, miss: float = MISS) -> DataFrame:
    """``doc_id, group_id, group_size, keep``: every document that has a near duplicate.

    group_id: the group's smallest doc_id, which is the one to keep.  Groups are the connected
    components of the verified pairs.
    """
    sigs = save(describe(docs, shingle, bands * rows))
    classes = sigs.groupBy("exact").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    later = save(sigs.select("id", "exact").join(classes.select("exact", "first"), "exact").where("id <> first").select("id", "exact", "first").distinct())
    lead = sigs.join(small(later.select("id", "exact")), ["id", "exact"], "left_anti")
    check = lambda pairs: verify_exact(prune(pairs, sigs, threshold, step, miss), docs, threshold, shingle)
    least = least_matches(threshold, step, bands * rows, miss)
    across = lambda cells: verify_exact(in_cells(cells, lead, "sig", matrix, lambda sig, i, j: passing(sig, i, j, least)), docs, threshold, shingle)
    roots = link(band_keys(lead, bands, rows), check, across, later.select(F.col("first").alias("a"), F.col("id").alias("b")))
    size = roots.groupBy("root").agg(F.count("*").alias("group_size"))
    return roots.join(size, "root").select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), "group_size", (F.col("id") == F.col("root")).alias("keep"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """docs with one document of each group of near duplicates, one row of each id; rows without id stay."""
    gone = save(near_duplicates(docs, **params).where("not keep").select("doc_id"))
    every = columns(docs)
    left = docs.join(small(gone), "doc_id", "left_anti").select(*every)
    often = save(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if often.isEmpty():
        return left
    often = small(often)
    row = F.struct(*every)
    # the smallest row of each id by partial aggregates, however many rows an id has
    order = F.struct(F.col("text"), *[F.col(c) for c in ("lang", "source") if c in docs.columns], F.to_json(row))
    one = left.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select("row.*")
    return left.join(often, "doc_id", "left_anti").select(*every).unionByName(one)
