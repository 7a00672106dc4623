"""Mixing sources to target weights by pivotal dependent rounding (operator 9).

Each document gets the fractional number of copies with which every source has its target share
of the budget.  The whole part is certain.  For the fractional part documents are paired, and
mass is moved between the two at random, keeping both expectations, until one is integral; the
other goes on to the next pair.  This is done within hash buckets, source by source; the one
residual that each source leaves in each bucket is combined in a reduction tree of fan-in
``FAN`` for each source, and the sources' last residuals in another.  At every level rows go to as many
buckets as keep them at about ``BUCKET_ROWS``, whatever the numbers of rows and of sources.  So a source's
total is within one copy of its target and the total of all is exact up to its own rounding.

All random numbers are hashes of the seed, the level and the two ids, and buckets depend on ids and
sources only: a lost executor's work comes out the same when it is done again.

Defined results: a null text has length 0; a source of length 0 in all gets one copy of each
document; the null source is a source; rows that share doc_id and source are one unit and are
copied together, however many; units are paired in the order of their hashes, of equal hashes in that of
their ids; texts of any length count by their characters; without documents the result is empty.  Extra columns are
kept by :func:`mixed`, whatever they are called, but for one named ``copies``, which the number of copies replaces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import columns, save

FAN, BUCKET_ROWS, SEED = 64, 20_000, 11
_EPS = 1e-9
_MASK = (1 << 64) - 1


def _uniform(*parts: int) -> float:
    x = 0
    for p in parts:
        x = (x + p * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & _MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        x ^= x >> 31
    return (x >> 11) / float(1 << 53)


def pivot(keys: list[int], mass: list[float], groups: list, seed: int) -> np.ndarray:
    """Masses after pairing each unit with the next of its group; one per group may stay fractional."""
    out = np.array(mass, float)
    held = -1
    for i in range(len(keys)):
        if held >= 0 and groups[i] != groups[held]:
            held = -1
        p = out[i]
        if p < _EPS or p > 1 - _EPS:
            out[i] = round(p)
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        s = out[a] + p
        u = _uniform(seed, keys[a], keys[b])
        if s < 1:
            win, lose = (b, a) if u * s < p else (a, b)
            out[win], out[lose] = s, 0.0
            held = win
        else:
            win, lose = (a, b) if u * (2 - s) < 1 - p else (b, a)  # win becomes 1
            out[win], out[lose] = 1.0, s - 1
            held = lose
        if out[held] < _EPS or out[held] > 1 - _EPS:
            out[held] = round(out[held])
            held = -1
    return out


def _level(units: DataFrame, seed: int, rows: int) -> DataFrame:
    """One level of the tree: pivot among the rows of each source (or of all) and node of the tree; rows: how many there are."""
    fields = "bucket long, node long, key long, source string, doc_id long, mass double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["source", "node", "key", "doc_id"], na_position="first", kind="stable").reset_index(drop=True)
        whole = part["node"].to_numpy() < 0
        groups = [0 if w else (n, s) for w, n, s in zip(whole, part["node"], part["source"].fillna("\0"))]
        part["mass"] = pivot((part["key"].astype("uint64")).tolist(), part["mass"].tolist(), groups, seed)
        return part

    n = max(1, math.ceil(rows / BUCKET_ROWS))
    of = F.when(F.col("node") < 0, F.xxhash64("key")).otherwise(F.xxhash64("node", F.coalesce("source", F.lit("\0"))))
    return save(units.withColumn("bucket", F.pmod(of, F.lit(n))).select("bucket", "node", "key", "source", "doc_id", "mass").groupBy("bucket").applyInPandas(run, fields))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, source, n_chars, copies`` of every unit.

    weights: target shares by source, normalised; a source that isn't named gets none.  By
    default all sources weigh the same.  budget: characters in all; by default those of docs.
    """
    length = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), length.alias("n_chars"))
    units = save(base.groupBy("doc_id", "source").agg(F.sum("n_chars").alias("n_chars")))
    sizes = units.groupBy("source").agg(F.sum("n_chars").alias("size"), F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        pairs = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(pairs or [("", 0.0)], "name string, weight double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "size", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = save(sizes)
    total = sizes.agg(F.sum("weight").alias("weight"), F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    goal = float(total["size"] or 0) if budget is None else float(budget)
    share = F.col("weight") / F.lit(total["weight"] or 1.0)
    rates = sizes.select(F.col("source").alias("of"), F.when(F.col("size") > 0, share * F.lit(goal) / F.col("size")).otherwise(F.lit(1.0)).alias("rate"))
    n_buckets = max(1, math.ceil((total["n"] or 0) / BUCKET_ROWS))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("source", F.lit("")))
    rated = units.join(rates, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # a mass of almost 0 or 1 is rounding noise of the division
    rated = rated.withColumn("base", F.floor(F.col("rate") + F.lit(_EPS))).withColumn("mass", F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).withColumn("key", key)
    # a node of the tree takes some BUCKET_ROWS rows at most: of the rows of one source those of a hash range
    state = rated.select(F.pmod("key", F.lit(n_buckets)).alias("node"), "key", "source", "doc_id", "mass")
    decided: list[DataFrame] = []
    level, left = 0, total["n"] or 0
    while True:
        state = _level(state, seed + level, left)
        fractional = (F.col("mass") > 0) & (F.col("mass") < 1)
        decided.append(state.where(~fractional))
        rest = state.where(fractional)
        level += 1
        if n_buckets > 1:
            n_buckets = math.ceil(n_buckets / FAN)
            left = rest.count()
            state = rest.withColumn("node", F.floor(F.col("node") / FAN))
            continue
        if n_buckets == 1:  # one residual a source: from here on all are one
            n_buckets = 0
            left = rest.count()
            state = rest.withColumn("node", F.lit(-1).cast("long"))
            continue
        left = rest.count()
        if left <= 1:
            last = rest.select("source", "doc_id", "mass").first()
            final = F.lit(0.0)
            if last:
                final = F.lit(1.0 if _uniform(seed, level) < last["mass"] else 0.0)
            decided.append(rest.withColumn("mass", final))
            break
        state = rest
    chosen = decided[0]
    for d in decided[1:]:
        chosen = chosen.unionByName(d)
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("mass").alias("won"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of"))
    return rated.join(chosen, same).select("doc_id", "source", "n_chars", (F.col("base") + F.col("won").cast("long")).cast("long").alias("copies"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that get copies, with ``copies``."""
    got = mixture(docs, **params).where("copies > 0").select(F.col("doc_id").alias("mix_id_"), F.col("source").alias("mix_of_"), F.col("copies").alias("mix_copies_"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("mix_id_")) & F.col("source").eqNullSafe(F.col("mix_of_"))
    rest = docs.drop("copies") if "copies" in docs.columns else docs
    return rest.join(got, same).select(*columns(rest), F.col("mix_copies_").alias("copies"))
