"""Passages that repeat across documents, by a sparse suffix array (operator 6).

1. Of every document only the suffixes at minimiser positions are retained: a position whose
   hash of ``K`` words is the least of some window of ``least - K + 1`` such positions.  Any two
   copies of a passage of ``least`` words retain a suffix at the same place in it.
2. Suffixes are distributed by their first K words; those whose K words occur in one document
   only go no further.
3. A suffix whose whole surroundings (``least - K`` words on both sides) are also another
   document's is done.  Of these, two of each kind go on to stand for all, and only if their K
   words also occur in other surroundings.
4. Those and all the others are sorted by their words, neighbours are compared (longest common prefix), and
   the matches are extended to the left: for each number of words to the left, suffixes that
   agree with a neighbour on the rest of ``least`` words to the right are compared to the left.
5. The places found in each document are merged to maximal passages.

First words that begin more than ``HOT`` suffixes are too many for one task's sort.  Their groups of
equal surroundings are counted by partial aggregates instead, and what step 4 would compare is counted
by the hash of each stretch of ``least`` words; the result is the same.

What is compared at one suffix is the ``least`` words around it; longer passages come out whole
since each of their parts is found and step 5 joins them.

Defined results: null, empty and shorter texts have no passages, and an empty table has no rows; a
passage that repeats only within one document isn't reported; rows with a null id are left out; rows
that share an id are one document, so a copy under the same id isn't a repeat, and their passages are
those of all its texts, by word position; a text of any length is read whole; passages may overlap
where no other document holds a stretch across the seam.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import save, small
from .tokens import Words, mix, spans, text_slices, words

LEAST, K, HOT = 50, 16, 50_000


def _sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each window of w elements, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(w: Words, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and hash of k words of each retained suffix; equal least hashes all stay."""
    h, n = w.hash, len(w.hash)
    window = least - k + 1
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if n < least:
        return none
    g = h[: n - k + 1].copy()
    for j in range(1, k):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += h[j : n - k + 1 + j]
    g = mix(g)
    row = w.row()
    low = _sliding(g, window, np.minimum)
    inside = row[: len(low)] == row[least - 1 : least - 1 + len(low)]  # the window's words are one document's
    low = np.where(inside, low, np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    best = _sliding(np.concatenate([pad, low, pad]), window, np.maximum)  # greatest least of the windows with this position
    at = np.flatnonzero((best == g) & (g > 0))
    return row[at], at - w.first[row[at]], g[at]


def _source(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def suffixes(docs: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """``key, id, pos, around, back, ahead`` of the retained suffixes.

    key: hash of its first k words; around: hash of these with the ``back`` words before and the
    ``ahead`` words after, least - k of each if the text has them.
    """
    reach = least - k
    names = ["key", "id", "pos", "around", "back", "ahead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, limit=1 << 21):
            w = words(b.column("text"))
            row, pos, g = minimisers(w, least, k)
            if not len(row):
                continue
            at = w.first[row] + pos
            back, ahead = np.minimum(reach, pos), np.minimum(reach, w.first[row + 1] - at - k)
            around = spans(w.hash, at - back, at + k + ahead) + back.astype(np.uint64)
            cols = [g.view(np.int64), pos.astype(np.int32), mix(around).view(np.int64), back.astype(np.int32), ahead.astype(np.int32)]
            cols = [pa.array(c) for c in cols]
            yield pa.RecordBatch.from_arrays([cols[0], b.column("id").take(pa.array(row)), *cols[1:]], names=names)

    return _source(docs).mapInArrow(run, "key long, id long, pos int, around long, back int, ahead int")


def contexts(docs: DataFrame, marked: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """``key, id, pos, right, left``: the words after the first k, and those before, nearest first.

    4 bytes of each word's hash, in an order that sorts bytewise; shorter at a text's borders.
    """
    reach = least - k
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("right", pa.binary()), ("left", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, limit=1 << 20):
            w = words(b.column("text"))
            lists = b.column("at")
            n = np.asarray(lists.value_lengths())
            flat = lists.flatten()
            pos, key = flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("key")
            row = np.repeat(np.arange(b.num_rows), n)
            ok = pos + k <= w.counts()[row]  # a row of the same id may be shorter
            pos, row, key = pos[ok], row[ok], key.filter(pa.array(ok))
            if not len(pos):
                continue
            h = (w.hash >> np.uint64(32)).astype(">u4")
            at = w.first[row] + pos
            right = np.minimum(reach, w.first[row + 1] - at - k)
            left = np.minimum(reach, pos)
            span = np.arange(reach)
            cols = []
            for size, index in ((right, (at + k)[:, None] + span), (left, (at - 1)[:, None] - span)):
                took = h[np.clip(index, 0, len(h) - 1)][span < size[:, None]]
                off = np.append(0, np.cumsum(size * 4)).astype(np.int32)
                cols.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(took.tobytes())]))
            yield pa.RecordBatch.from_arrays([key, b.column("id").take(pa.array(row)), pa.array(pos.astype(np.int32)), *cols], schema=schema)

    return _marked_texts(docs, marked).mapInArrow(run, "key long, id long, pos int, right binary, left binary")


def _marked_texts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``id, text, at``: the texts of the marked suffixes' documents with their places."""
    at = marked.groupBy("id").agg(F.collect_set(F.struct("pos", "key")).alias("at"))
    texts = _source(docs).join(small(save(marked.select("id").distinct())), "id", "left_semi")
    return texts.join(at, "id").select("id", "text", "at")


def stretches(docs: DataFrame, marked: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """``stretch, id, start``: hash and place of each run of ``least`` words that holds a marked suffix's first k words."""
    reach = least - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, limit=1 << 20):
            w = words(b.column("text"))
            lists = b.column("at")
            pos = lists.flatten().field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            first = pos[:, None] - np.arange(reach + 1)
            ok = (first >= 0) & (first + least <= w.counts()[row][:, None])
            place = np.unique((w.first[row][:, None] + first)[ok])
            if len(place):
                of = np.searchsorted(w.first, place, "right") - 1
                cols = [pa.array(spans(w.hash, place, place + least).view(np.int64)), b.column("id").take(pa.array(of)), pa.array(place - w.first[of])]
                yield pa.RecordBatch.from_arrays(cols, names=["stretch", "id", "start"])

    return _marked_texts(docs, marked).mapInArrow(run, "stretch long, id long, start long")


def _matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, padded, and how many it has."""
    n = np.asarray(pc.binary_length(col)) // 4
    out = np.zeros((len(col), width), np.uint32)
    out[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(col.to_pylist()), ">u4")
    return out, n


def compare(key: np.ndarray, ids: np.ndarray, pos: np.ndarray, right: pa.Array, left: pa.Array, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of each run of repeated stretches around sorted suffixes."""
    reach = least - k
    r, nr = _matrix(right, reach)
    l, nl = _matrix(left, reach)
    same = np.append(False, key[1:] == key[:-1])
    agree = np.zeros(len(key), np.int64)  # longest common prefix with the neighbour before, past the first k words
    if len(key) > 1:
        eq = (r[1:] == r[:-1]) & (np.arange(reach) < np.minimum(nr[1:], nr[:-1])[:, None])
        agree[1:] = np.where(eq.all(1), reach, eq.argmin(1)) if reach else 0
    agree[~same] = -1
    hits, shifts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    back = np.zeros(len(key), np.uint64)
    for o in range(reach + 1):
        if o:
            back = mix(back * np.uint64(0x9E3779B97F4A7C15) + l[:, o - 1].astype(np.uint64) + np.uint64(1))
        run = np.cumsum(agree < reach - o)
        rows = np.flatnonzero((nl >= o) & (nr >= reach - o))
        if len(rows) < 2:
            continue
        mark = mix(run[rows].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ back[rows]
        order = np.argsort(mark, kind="stable")
        rows, mark = rows[order], mark[order]
        begin = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
        lo, hi = np.minimum.reduceat(ids[rows], begin), np.maximum.reduceat(ids[rows], begin)
        hit = rows[np.repeat(lo != hi, np.diff(np.append(begin, len(rows))))]
        hits.append(hit)
        shifts.append(np.full(len(hit), o))
    hit, shift = np.concatenate(hits), np.concatenate(shifts)
    order = np.lexsort((shift, hit))
    hit, shift = hit[order], shift[order]
    new = np.append(True, (hit[1:] != hit[:-1]) | (shift[1:] != shift[:-1] + 1))[: len(hit)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit))[: len(first)] - 1
    return hit[first], pos[hit[first]] - shift[last], pos[hit[first]] - shift[first] + least


def matches(context: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """``id, start, stop`` of the suffixes in repeated passages; context: sorted by key and right, whole keys in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            c = {x: t.column(x).combine_chunks() for x in t.column_names}
            ids = c["id"].to_numpy()
            hit, begin, end = compare(c["key"].to_numpy(), ids, c["pos"].to_numpy().astype(np.int64), c["right"], c["left"], least, k)
            return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(begin), pa.array(end)], names=["id", "start", "stop"])

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if held and held[-1].column("key")[-1].as_py() != key[0]:
                yield flush(pa.Table.from_batches(held))
                held = []
            if cut:
                yield flush(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    return context.select("key", "id", "pos", "right", "left").mapInArrow(run, "id long, start long, stop long")


def _surroundings(marked: DataFrame, k: int) -> DataFrame:
    """``id, start, stop`` of the whole surroundings of suffixes."""
    return marked.select("id", (F.col("pos") - F.col("back")).cast("long").alias("start"), (F.col("pos") + F.col("ahead") + k).cast("long").alias("stop"))


def _sorted(docs: DataFrame, rows: DataFrame, least: int, k: int) -> DataFrame:
    """``id, start, stop`` found by sorting: no first words have more rows than a task holds."""
    by_key, alike = Window.partitionBy("key"), Window.partitionBy("key", "around")
    marked = rows.withColumns({"lo": F.min("id").over(by_key), "hi": F.max("id").over(by_key)}).where("lo < hi")
    marked = marked.withColumns({"lo": F.min("id").over(alike), "hi": F.max("id").over(alike), "nth": F.row_number().over(alike.orderBy("id", "pos")), "n": F.count("*").over(alike)})
    marked = marked.withColumn("done", F.col("lo") < F.col("hi")).withColumn("open", F.max(~F.col("done")).over(by_key))
    marked = marked.withColumn("compare", F.col("open") & (~F.col("done") | F.col("nth").isin(1) | (F.col("nth") == F.col("n"))))
    marked = save(marked.where("done or compare").select("key", "id", "pos", "back", "ahead", "compare", "done"))
    context = contexts(docs, marked.where("compare").select("key", "id", "pos"), least, k)
    context = context.repartition(F.col("key")).sortWithinPartitions("key", "right", "id", "pos")
    return _surroundings(marked.where("done"), k).unionByName(matches(context, least, k))


def _counted(docs: DataFrame, rows: DataFrame, least: int, k: int) -> DataFrame:
    """``id, start, stop`` found by partial aggregates only, for first words with any number of rows."""
    alike = save(rows.groupBy("key", "around").agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    known = save(rows.join(alike, ["key", "around"]).select("key", "id", "pos", "back", "ahead", (F.col("lo") < F.col("hi")).alias("done"), F.col("id").isin(F.col("lo"), F.col("hi")).alias("stands")))
    runs = save(stretches(docs, known.where("not done or stands").select("key", "id", "pos"), least, k))
    often = runs.groupBy("stretch").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("stretch")
    found = runs.join(often, "stretch").select("id", "start", (F.col("start") + least).alias("stop"))
    return _surroundings(known.where("done"), k).unionByName(found)


def repeated_passages(docs: DataFrame, least: int = LEAST, k: int = K, hot: int = HOT) -> DataFrame:
    """``doc_id, start_word, end_word, n_words``: every maximal passage of at least ``least`` words of which each stretch of ``least`` words is in another document."""
    if not 0 < k <= least:
        raise ValueError("k must be between 1 and least")
    rows = save(suffixes(docs, least, k))
    hot_keys = save(rows.groupBy("key").count().where(F.col("count") > hot).select("key"))
    if hot_keys.isEmpty():
        found = _sorted(docs, rows, least, k)
    else:
        hot_keys = small(hot_keys)
        found = _sorted(docs, rows.join(hot_keys, "key", "left_anti"), least, k).unionByName(_counted(docs, rows.join(hot_keys, "key", "left_semi"), least, k))
    found = found.groupBy("id", "start").agg(F.max("stop").alias("stop"))
    in_order = Window.partitionBy("id").orderBy("start")
    before = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    # a stretch that begins right after another's begin, or at it, goes on with it
    new = F.when(F.col("start") > F.coalesce(before - least + 1, F.lit(-1)), 1).otherwise(0)
    islands = found.withColumn("new", new).withColumn("island", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("id", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"))
    return out.select(F.col("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
