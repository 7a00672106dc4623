import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitide.llm import pivotal


def test_pivoting_keeps_sums_and_expectations():
    rng = np.random.default_rng(0)
    mass = rng.random(40)
    total = np.zeros(40)
    for seed in range(1500):
        out = pivotal.pivot(list(range(40)), mass.tolist(), [0] * 40, seed)
        assert abs(out.sum() - mass.sum()) < 1e-6 and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        total += out
    assert np.abs(total / 1500 - mass).max() < 0.06
    two = pivotal.pivot([1, 2, 3, 4], [0.5] * 4, [0, 0, 1, 1], 3)
    assert two[:2].sum() == two[2:].sum() == 1.0


@pytest.mark.parametrize(("weights", "budget"), [(None, None), ({"web": 3.0, "books": 1.0}, 200_000.0)])
def test_shares(docs, weights, budget):
    rows = pivotal.mixture(docs, weights, budget).collect()
    size, got, n = {}, {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.n_chars
        n.setdefault(r.source, []).append(r.copies)
    assert len(rows) == docs.count()
    w = {s: 1.0 if weights is None else weights.get(s, 0.0) for s in size}
    goal = budget or sum(size.values())
    whole = 0.0
    for s in size:
        rate = w[s] / (sum(weights.values()) if weights else len(size)) * goal / size[s] if sum(w.values()) else 0.0
        assert {*n[s]} <= {int(rate), int(rate) + 1, int(rate + 1e-9)}
        if weights is None:
            assert abs(sum(n[s]) - rate * len(n[s])) < 1 + 1e-6
            whole += rate * len(n[s])
        got[s] = sum(n[s])
    if weights is None:
        assert abs(sum(got.values()) - whole) < 1 + 1e-6


def test_many_buckets_and_lost_work(docs, monkeypatch):
    monkeypatch.setattr(pivotal, "BUCKET_ROWS", 5)
    monkeypatch.setattr(pivotal, "FAN", 3)
    key = lambda df: sorted((r.doc_id, r.source or "", r.copies) for r in df.collect())
    one = key(pivotal.mixture(docs))
    assert one == key(pivotal.mixture(docs.repartition(7).orderBy(F.rand(1))))
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(r.text)
    goal = sum(size.values()) / len(size)
    for s in size:
        mine = [c for _, x, c in one if x == s]
        assert abs(sum(mine) - goal / size[s] * len(mine)) < 1 + 1e-6


def test_odd_rows(odd, empty):
    rows = pivotal.mixture(odd).collect()
    assert len(rows) == odd.select("doc_id", "source").distinct().count()
    out = pivotal.mixed(odd)
    assert sorted(out.columns) == sorted(odd.columns) and dict(out.dtypes)["copies"] == "bigint"
    assert all(r.copies > 0 for r in out.collect())
    twice = {r.copies for r in out.where("doc_id = 7").collect()}
    assert len(twice) <= 1
    assert pivotal.mixture(empty).count() == 0 and pivotal.mixed(empty).count() == 0


def slow_mixture(rows, bucket_rows, fan, seed, hash64):
    """The whole tree in plain loops: units, rates, nodes, pairs and the last draw."""
    import math

    units = {}
    for d, s, t in rows:
        units[d, s] = units.get((d, s), 0) + len(t or "")
    size, n = {}, len(units)
    for (_, s), k in units.items():
        size[s] = size.get(s, 0) + k
    total = sum(size.values())
    base, state = {}, []
    nodes = max(1, math.ceil(n / bucket_rows))
    for d, s in units:
        rate = total / len(size) / size[s] if size[s] else 1.0
        base[d, s] = math.floor(rate + 1e-9)
        key = hash64(d, s)
        state.append([key % nodes, key, s, d, max(0.0, rate - base[d, s])])
    won, level = {}, 0

    def draw(*parts):
        x, m = 0, (1 << 64) - 1
        for p in parts:
            x = (x + p * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & m
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
            x ^= x >> 31
        return (x >> 11) / float(1 << 53)

    def pair(units):
        """Transfer between the open unit and the next one; the open one at the end, if any."""
        held = None
        for u in units:
            if u[4] < 1e-9 or u[4] > 1 - 1e-9:
                u[4] = float(round(u[4]))
            elif held is None:
                held = u
            else:
                a, b, s = held, u, held[4] + u[4]
                x = draw(seed + level, a[1] % 2**64, b[1] % 2**64)
                if s < 1:
                    win, lose = (b, a) if x * s < b[4] else (a, b)
                    win[4], lose[4], held = s, 0.0, win
                else:
                    win, lose = (a, b) if x * (2 - s) < 1 - b[4] else (b, a)
                    win[4], lose[4], held = 1.0, s - 1, lose
                if held[4] < 1e-9 or held[4] > 1 - 1e-9:
                    held[4], held = float(round(held[4])), None

    def order(u):
        return (u[2] is not None, u[2] or "", u[0], u[1], u[3] is not None, u[3] or 0)

    while True:
        groups = {}
        for u in sorted(state, key=order):
            groups.setdefault((u[0], u[2]) if u[0] >= 0 else hash64(u[1]) % max(1, math.ceil(len(state) / bucket_rows)), []).append(u)
        for g in groups.values():
            pair(g)
        for u in state:
            if u[4] in (0.0, 1.0):
                won[u[3], u[2]] = int(u[4])
        state = [u for u in state if u[4] not in (0.0, 1.0)]
        level += 1
        if nodes > 1:
            nodes = math.ceil(nodes / fan)
            for u in state:
                u[0] //= fan
        elif nodes == 1:
            nodes = 0
            for u in state:
                u[0] = -1
        elif len(state) <= 1:
            for u in state:
                won[u[3], u[2]] = int(draw(seed, level) < u[4])
            return {k: base[k] + won[k] for k in units}


@pytest.mark.parametrize(("bucket_rows", "fan"), [(20_000, 64), (7, 3), (20, 2)])
def test_against_plain_loops(spark, docs, odd, monkeypatch, bucket_rows, fan):
    monkeypatch.setattr(pivotal, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(pivotal, "FAN", fan)
    for df in (docs, odd):
        rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
        keys = {(r.doc_id, r.source): r.k for r in df.selectExpr("doc_id", "source", "xxhash64(coalesce(doc_id, -1L), coalesce(source, '')) AS k").collect()}
        again = {r.k: r.h for r in spark.createDataFrame([(k,) for k in set(keys.values())], "k long").selectExpr("k", "xxhash64(k) AS h").collect()}
        want = slow_mixture(rows, bucket_rows, fan, pivotal.SEED, lambda *x: keys[x] if len(x) == 2 else again[x[0]])
        got = {(r.doc_id, r.source): r.copies for r in pivotal.mixture(df).collect()}
        assert got == want


def test_many_sources(spark, monkeypatch):
    """With a source for every second document no task gets more than some BUCKET_ROWS rows."""
    monkeypatch.setattr(pivotal, "BUCKET_ROWS", 50)
    df = spark.range(2000).selectExpr("id AS doc_id", "concat('site', id div 2) AS source", "repeat('x', cast(1 + id % 7 AS int)) AS text", "id AS `a.b`")
    sizes = []
    level = pivotal._level

    def spy(units, seed, rows):
        out = level(units, seed, rows)
        sizes.append(out.groupBy("bucket").count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(pivotal, "_level", spy)
    rows = pivotal.mixed(df)
    assert rows.columns == ["doc_id", "source", "text", "a.b", "copies"] and max(sizes) <= 100
    total = {}
    for r in rows.collect():
        total[r.source] = total.get(r.source, 0) + r.copies
    size = {}
    for r in df.collect():
        size[r.source] = size.get(r.source, 0) + len(r.text)
    goal = sum(size.values()) / len(size)
    assert all(abs(total.get(s, 0) - 2 * goal / size[s]) < 1 + 1e-6 for s in size)
    assert abs(sum(total.values()) - sum(2 * goal / v for v in size.values())) < 1 + 1e-6
