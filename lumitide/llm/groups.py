"""From LSH buckets to groups of near duplicates, without listing all pairs of a hot bucket.

The groups are the components of the graph of *all* candidate pairs that verify:

1. every bucket's members are compared with its smallest id; the edges that verify are
   contracted to components;
2. in a bucket that still holds several components, members of different ones are compared, in cells of
   two blocks of about ``BLOCK`` members: each block outside of the largest component with each other
   block.  What a member is compared by is sent to the cells, not to each pair, and only pairs that pass
   leave a cell.

A pair inside a component needn't be compared, as its outcome can't change the components.  A
bucket of k true copies so costs k - 1 comparisons, and nothing is capped.  Buckets and vertices of any
size are counted by partial aggregates and joined, so that adaptive execution can split hot ones; no
window or group holds one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save

BLOCK, PAIRS = 512, 1 << 16


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    several = e.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b")
    return several.isEmpty() and e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every vertex of edges ``a, b``; root: the component's smallest id.

    Alternates large-star and small-star contraction (Kiveris et al., 2014) until all edges go straight
    to roots: a number of rounds that grows with the logarithm of the component size.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(both.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = save(large.where("u <> v").distinct())
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = save(small.where("u <> v").distinct())
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return save(roots.union(roots.select(F.col("root").alias("id"), "root").distinct()))


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots after more edges: only the components that these join are gone through."""
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_"))
    joins = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    new = components(joins)
    if new.isEmpty():
        return roots
    known = roots.join(new.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return save(known.unionByName(new.join(roots.select("id"), "id", "left_anti")))


def _hubs(buckets: DataFrame) -> DataFrame:
    """``key, id, hub``: hub is the bucket's smallest id; buckets of one member are left out."""
    hubs = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    return save(buckets.join(hubs, "key").select("key", "id", "hub"))


def _pairs(hubs: DataFrame) -> DataFrame:
    return hubs.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def _cells(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, x, y, block, id, label``: the cells of buckets with several components; a cell compares block x with block y.

    Blocks of the largest component are numbered from -1 down, the others from 0 up.
    """
    labelled = shared.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("label")).distinct()
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    by = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    tops, rest = (F.ceil(c / F.lit(BLOCK)).cast("int") for c in (F.col("most"), F.col("n") - F.col("most")))
    mixed = labelled.join(by.select("key", "top", tops.alias("tops"), rest.alias("rest")), "key").withColumn("on_top", F.col("label") == F.col("top"))
    nth = F.pmod(F.xxhash64("id"), F.when(F.col("on_top"), F.col("tops")).otherwise(F.col("rest"))).cast("int")
    blocks = mixed.withColumn("block", F.when(F.col("on_top"), -1 - nth).otherwise(nth))
    against = F.when(F.col("on_top"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(-F.col("tops"), F.col("rest") - 1))
    out = blocks.withColumn("other", F.explode(against))
    return save(out.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "label"))


def in_cells(cells: DataFrame, of: DataFrame, value: str, prepare: Callable[[pa.Array], np.ndarray], holds: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Distinct pairs ``a, b`` of the members of cells, with different labels, that hold.

    of: ``id`` and a value to compare by; prepare: makes an array of a column of values; holds: whether each pair
    of indices i, j into it does.  All cells of an Arrow batch are gone through together.
    """

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, x, y, block, ids, label = (t.column(c).to_numpy() for c in ("key", "x", "y", "block", "id", "label"))
        values = prepare(t.column(value).combine_chunks())
        new = np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        begin = np.flatnonzero(new)
        left, right = np.add.reduceat(block == x, begin), np.add.reduceat(block == y, begin)
        second = begin + np.where(x[begin] == y[begin], 0, left)  # rows of block x come first
        n = left * right
        total = np.append(0, np.cumsum(n))
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            of_cell = np.repeat(np.arange(at, to), n[at:to])
            nth = np.arange(total[at], total[to]) - total[of_cell]
            i, j = begin[of_cell] + nth // right[of_cell], second[of_cell] + nth % right[of_cell]
            ok = (label[i] != label[j]) & ((x[i] != y[i]) | (i < j)) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            ok = holds(values, i, j)
            a, b = ids[i[ok]], ids[j[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = np.ones(t.num_rows, bool)  # the last cell may go on in the next batch
            for c in ("key", "x", "y"):
                col = t.column(c).to_numpy()
                last &= col == col[-1]
            cut = int(np.argmax(last))
            if cut:
                yield from pairs(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield from pairs(held)

    rows = cells.join(of.select("id", value), "id").select("key", "x", "y", "block", "id", "label", value)
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "block", "id").mapInArrow(run, "a long, b long").distinct()


def link(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """``id, root`` of the ids that have a verified partner.

    buckets: ``key, id`` (repeats allowed); verify: takes distinct pairs ``a, b`` with a < b and
    returns those that hold; across: takes cells and returns the pairs in them that hold; known: edges ``a, b`` that hold anyway.
    """
    shared = _hubs(buckets)
    edges = save(verify(_pairs(shared)).select("a", "b"))
    roots = components(edges if known is None else edges.unionByName(known.select("a", "b")))
    cells = _cells(shared, roots)
    if cells.isEmpty():
        return roots
    more = save(across(cells).select("a", "b"))
    return roots if more.isEmpty() else merged(roots, more)
