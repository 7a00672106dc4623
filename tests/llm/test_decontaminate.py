import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lumitide.llm import decontaminate as D

from . import brute
from .conftest import SF


def has(long, short):
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


def test_items_are_found_and_clean_documents_left(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    items = {r.item_id: brute.words(r.text) for r in bench.collect()}
    split = {k: brute.words(t) for k, t in texts.items()}
    exact = {(k, i) for k, w in split.items() for i, x in items.items() if x and has(w, x)}
    assert exact and exact <= found
    for k, i in found:  # the rest hold most of the item's runs of 5 words
        g = {tuple(items[i][j : j + 5]) for j in range(len(items[i]) - 4)}
        d = {tuple(split[k][j : j + 5]) for j in range(len(split[k]) - 4)}
        assert len(g & d) >= 0.5 * len(g), (k, i)


@pytest.mark.parametrize("seed", range(5))
def test_block_max_wand_is_exhaustive(seed):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 150)))) for k in range(120)]
    units = [u for _, t in items for u in D.unit_words(D.hash_words(t))]
    df, n, total = D.frequencies(units), len(units), sum(map(len, units))
    index = D.Index(items, df, n, total / n, 0.45)
    for _ in range(40):
        terms = np.unique(D.hash_words(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))))).tolist()
        want = defaultdict(float)
        for x in terms:
            k = int(np.searchsorted(index.terms, np.uint64(x)))
            if k < len(index.terms) and index.terms[k] == x:
                for i in range(index.start[k], index.start[k + 1]):
                    want[index.units[i]] += index.impact[i]
        want = {u: s for u, s in want.items() if s >= 0.45 - 1e-9}
        got = dict(index.search(terms))
        assert got.keys() == want.keys() and all(math.isclose(got[u], want[u]) for u in got)


def test_the_bound_drops_no_passage():
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(60))) for k in range(30)]
    index = D.Index(items, D.frequencies([D.hash_words(t) for _, t in items]), 30, 60.0, 0.6)
    text = " ".join([*(rng.choice(vocab) for _ in range(100)), *items[3][1].split()[5:55], *(rng.choice(vocab) for _ in range(90))])
    h = D.hash_words(text)
    held = {c & 0xFFFFFFFF for c in index.candidates(h, np.zeros(len(h), np.int64), np.arange(len(h))).tolist()}
    for p in range(-(-len(h) // D.STRIDE)):
        if index.search(np.unique(h[p * D.STRIDE : (p + 2) * D.STRIDE]).tolist()):
            assert p in held
    assert held


def test_odd_rows(spark, odd, empty):
    from .conftest import SHARED

    bench = spark.createDataFrame([(1, SHARED, "x"), (1, "another item here with several words", "x"), (None, SHARED, "x"), (2, None, "x"), (3, "", "x"), (4, "x", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(odd, bench).collect()}
    assert got == {(4, 1), (5, 1), (7, 1), (8, 4)}
    assert D.contaminated(empty, bench).count() == 0 and D.contaminated(odd, bench.where("false")).count() == 0


def test_many_shards_give_the_same(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "INDEX_BYTES", 3000)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == whole


def slow(docs, items):
    """Scores of all passages and all units, and shares of all regions, in plain loops."""
    units = []
    for key, (_, t) in enumerate(items):
        w = brute.words(t)
        starts = [*range(0, len(w) - 63, 64)] + ([max(0, len(w) - 64)] if len(w) % 64 else [])
        units += [(key, w[i : i + 64]) for i in starts]
    df, mean = defaultdict(int), sum(len(u) for _, u in units) / len(units)
    for _, u in units:
        for x in set(u):
            df[x] += 1
    weight = []
    for _, u in units:
        v = {x: math.log(1 + (len(units) - df[x] + 0.5) / (df[x] + 0.5)) * u.count(x) * 2.2 / (u.count(x) + 1.2 * (0.25 + 0.75 * len(u) / mean)) for x in set(u)}
        weight.append({x: y / sum(v.values()) for x, y in v.items()})

    def part(p, region, n):
        n = min(n, len(p))
        runs = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        return len(runs(p) & runs(region)) / len(runs(p)) if p else 1.0

    out = {}
    for d, text in docs:
        w = brute.words(text)
        at = defaultdict(dict)
        for p in range(-(-len(w) // 64)):
            have = set(w[p * 64 : p * 64 + 128])
            for (key, _), v in zip(units, weight):
                s = sum(y for x, y in v.items() if x in have)
                if s >= 0.6 - 1e-9:
                    at[key][p] = max(s, at[key].get(p, 0))
        for key, ps in at.items():
            item, t = items[key]
            iw = brute.words(t)
            sentences = [n for x in D.SENTENCE.split(t) if (n := len(brute.words(x)))]
            n = sentences[-1] if len(sentences) > 1 else max(1, len(iw) // 5)
            groups = []
            for p in sorted(ps):
                if groups and (p - groups[-1][-1]) * 64 <= 128 + 2 * len(iw):
                    groups[-1].append(p)
                else:
                    groups.append([p])
            for g in groups:
                region = w[max(0, g[0] * 64 - len(iw)) : (g[-1] + 2) * 64 + len(iw)]
                q, a = part(iw[: len(iw) - n], region, 5), part(iw[len(iw) - n :], region, 3)
                if q >= D.QUESTION and a >= D.ANSWER:
                    old = out.get((d, item), (0, 0, 0))
                    out[d, item] = tuple(max(x, round(y, 6)) for x, y in zip(old, (max(ps[p] for p in g), q, a)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_all_units_and_passages(spark, seed):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k % 25, f"{say(rng.randint(1, 170))}. {say(rng.randint(1, 12))}." if k % 3 else say(rng.randint(1, 140))) for k in range(30)]
    docs = []
    for k in range(40):
        t = say(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                w = [x for x in w if rng.random() < 0.95]
            t += " " + " ".join(w[rng.randint(0, 2) :]) + " " + say(rng.randint(0, 300))
        docs.append((k % 37, t))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in D.contaminated(df, bench).collect()}
    want = slow(docs, sorted(items))
    assert want and got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-6) for k in got)


def test_the_end_of_a_long_item_counts_and_time_is_linear(spark):
    import time

    w = [f"t{k}" for k in range(70)]
    assert [len(u) for u in D.unit_words(D.hash_words(" ".join(w)))] == [64, 64]
    long = " ".join(f"x{k}" for k in range(100_000))
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    df = spark.createDataFrame([(1, "head " + long + " tail")], "doc_id long, text string")
    t = time.time()
    assert [(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()] == [(1, 1)] and time.time() - t < 60


def test_the_sql_finds_the_same(spark, docs):
    import duckdb

    from lumitide.llm.oracles import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = sorted(con.sql(ORACLES["op4_bm25_decontamination"]).fetchall())
    cols = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    got = sorted(map(tuple, D.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select(cols).collect()))
    assert want and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose(got, want, atol=2e-6)
