"""Embedding near-duplicate groups by Euclidean p-stable hashing (operator 10).

Vectors are normalised; in each of L tables K Gaussian projections, shifted and cut into cells
of width ``width``, make a bucket key.  The number of tables follows from K and the wanted recall at
exactly the threshold distance; K follows from the number of vectors n, so that the tables and the
comparisons of unrelated (orthogonal) vectors they cause are fewest together: both then grow with about
n to the power 0.19 for each vector, not with n.  Candidates are checked by their exact cosine.

Defined results: a vector that is null, empty, all zero, not finite or of another length than
``dim`` has no direction and so no duplicates; rows with a null id are left out; rows that share
an id are one item (its smallest vector speaks for it); a cosine that equals the threshold holds; an
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import in_cells, link
from .store import save, small
from .tokens import mix

COSINE, WIDTH, RECALL, SEED = 0.95, 2.0, 0.97, 7
#: What a comparison of two vectors costs, in rows of a table.
COMPARISON = 4.0


def collision(distance: float, width: float) -> float:
    """Probability that two points at this distance share one projection's cell (Datar et al., 2004)."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(cosine: float, width: float, projections: int, recall: float) -> int:
    p = collision(math.sqrt(max(0.0, 2 - 2 * cosine)), width) ** projections
    return 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def projections_for(n: int, cosine: float, width: float, recall: float) -> int:
    """K for which n vectors' table rows and comparisons of orthogonal vectors cost least."""
    apart = collision(math.sqrt(2.0), width)

    def cost(k: int) -> float:
        return tables_for(cosine, width, k, recall) * (1 + COMPARISON * n * apart**k)

    return min(range(1, 65), key=cost)


def unit(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of col that have a direction, and their normalised vectors."""
    n = np.asarray(col.value_lengths().fill_null(0))
    ok = np.flatnonzero(n == dim)
    if not len(ok) or not dim:
        return np.empty(0, np.int64), np.empty((0, dim))
    x = col.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    good = np.isfinite(x).all(axis=1)
    return ok[good], x[good]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, width: float = WIDTH, projections: int | None = None, recall: float = RECALL, dim: int | None = None, seed: int = SEED) -> DataFrame:
    """``vec_id, group_id, group_size, keep``: every vector with a near duplicate; group_id: smallest vec_id.

    Groups are the connected components of the pairs with this cosine or more.  dim: by default
    the commonest length (the smaller on a tie); projections: by default those of :func:`projections_for`.
    """
    src = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    sizes = src.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).where("dim > 0")
    top = sizes.orderBy(F.desc("n"), "dim").first() if dim is None else sizes.where(F.col("dim") == dim).first()
    if not top:
        return src.select(F.col("id").alias("vec_id"), F.col("id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep")).where("false")
    dim = top["dim"]
    projections = projections or projections_for(top["n"], cosine, width, recall)
    tables = tables_for(cosine, width, projections, recall)
    rng = np.random.default_rng(seed)
    plane, shift = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, tables + 1, dtype=np.uint64))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                ok, x = unit(b.column("v"), dim)
                if not len(ok):
                    continue
                cell = np.floor((x @ plane + shift) / width).astype(np.int64).view(np.uint64).reshape(len(ok), tables, projections)
                key = np.broadcast_to(salt, (len(ok), tables)).copy()
                for k in range(projections):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, k])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, tables, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ok)), keys, b.column("v").take(pa.array(ok))], names=["id", "keys", "v"])

    often = save(src.groupBy("id").count().where(F.col("count") > 1).select("id"))
    if not often.isEmpty():  # only rows of these ids are grouped
        often = small(often)
        src = src.join(often, "id", "left_anti").unionByName(src.join(often, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))
    items = save(src.select("id", "v").mapInArrow(hashed, "id long, keys array<long>, v array<float>"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (_, x), (_, y) = unit(b.column("va"), dim), unit(b.column("vb"), dim)
            yield b.select(["a", "b"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= cosine))

    def verify(pairs: DataFrame) -> DataFrame:
        v = items.select("id", "v")
        both = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
        return both.select("a", "b", "va", "vb").mapInArrow(check, "a long, b long")

    alike = lambda x, i, j: np.einsum("ij,ij->i", x[i], x[j]) >= cosine
    roots = link(items.select(F.explode("keys").alias("key"), "id"), verify, lambda cells: in_cells(cells, items, "v", lambda v: unit(v, dim)[1], alike))
    size = roots.groupBy("root").agg(F.count("*").alias("group_size"))
    return roots.join(size, "root").select(F.col("id").alias("vec_id"), F.col("root").alias("group_id"), "group_size", (F.col("id") == F.col("root")).alias("keep"))
