import numpy as np

from lumitide.llm import pstable

from . import brute
from .conftest import SF


def test_groups_against_all_pairs(spark):
    base = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rng = np.random.default_rng(5)
    noisy = [(10_000 + k, (3 * (np.array(r.embedding) + rng.standard_normal(64) * 0.002 * (k % 25))).tolist()) for k, r in enumerate(base[:250])]
    df = spark.createDataFrame([(r.vec_id, r.embedding) for r in base] + noisy, "vec_id long, embedding array<float>")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.where(np.triu(x @ x.T >= pstable.COSINE, 1))
    want = brute.components([tuple(sorted(p)) for p in zip(ids[a].tolist(), ids[b].tolist())])
    recall, sound = brute.same_groups(pstable.near_vectors(df).collect(), "vec_id", want)
    assert want and sound and recall >= 0.9, recall


def test_collision_probability():
    rng = np.random.default_rng(0)
    for d, w in ((0.3, 2.0), (1.0, 1.0)):
        hits = np.mean([np.floor((rng.standard_normal() * 0 + (u := rng.uniform(0, w))) / w) == np.floor((d * rng.standard_normal() + u) / w) for _ in range(20_000)])
        assert abs(hits - pstable.collision(d, w)) < 0.02
    assert pstable.collision(0.0, 1.0) == 1.0
    p = pstable.collision((2 - 2 * 0.95) ** 0.5, 2.0) ** 16
    n = pstable.tables_for(0.95, 2.0, 16, 0.97)
    assert 1 - (1 - p) ** n >= 0.97 > 1 - (1 - p) ** (n - 1)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0]), (None, v), (8, [1e30, 2e30, 3e30]), (9, [float("inf"), 1.0, 1.0]), (10, [-1.0, -2.0, -3.0]), (11, [1.0, None, 3.0])]
    df = spark.createDataFrame([(k, x, "clash", "clash", "clash") for k, x in rows], "vec_id long, embedding array<float>, id string, key string, v string")
    got = sorted((r.vec_id, r.group_id, r.group_size, r.keep) for r in pstable.near_vectors(df).collect())
    assert got == [(1, 1, 3, True), (2, 1, 3, False), (8, 1, 3, False)]
    assert pstable.near_vectors(df.where("false")).count() == 0
    assert pstable.near_vectors(df.where("vec_id in (4, 3)")).count() == 0


def test_the_sql_groups_all_pairs(spark, tmp_path):
    import duckdb

    from lumitide.llm.oracles import ORACLES

    base = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).collect()
    rows = [(r.vec_id, r.embedding) for r in base] + [(1000 + r.vec_id, [2 * x for x in r.embedding]) for r in base[:20]] + [(2000 + r.vec_id, r.embedding) for r in base[:5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    want = sorted(con.sql(ORACLES["op10_pstable_embeddings"]).fetchall())
    got = sorted((r.vec_id, r.group_id, r.group_size, r.keep) for r in pstable.near_vectors(df).collect())
    assert got == want and len(got) == 45


def test_comparisons_a_vector_do_not_grow_with_the_table():
    apart, near = pstable.collision(2**0.5, pstable.WIDTH), pstable.collision((2 - 2 * pstable.COSINE) ** 0.5, pstable.WIDTH)
    last = None
    for n in (500, 2_500, 50_000, 250_000, 10**9):
        k = pstable.projections_for(n, pstable.COSINE, pstable.WIDTH, pstable.RECALL)
        tables = pstable.tables_for(pstable.COSINE, pstable.WIDTH, k, pstable.RECALL)
        assert 1 - (1 - near**k) ** tables >= pstable.RECALL
        false = tables * n * apart**k
        if last:  # n to the power 0.2, with room for whole numbers
            assert false <= 1.9 * last[1] * (n / last[0]) ** 0.2 and tables <= 1.9 * last[2] * (n / last[0]) ** 0.2
        last = n, false, tables
