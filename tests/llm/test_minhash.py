import numpy as np

from lumitide.llm import minhash, tokens

from . import brute


def test_words_are_those_of_the_unicode_classes(texts):
    for t in [*texts.values(), "a_b c-d 12x Ünï", "中文 字x", "don’t…stop", "", "éa"]:
        assert len(tokens.hash_words(t)) == len(brute.words(t)), t[:80]
        w = brute.words(t)
        h = tokens.hash_words(t).tolist()
        assert len(set(zip(w, h))) == len(set(w)) == len(set(h))


def test_groups_against_all_pairs(docs, texts):
    rows = minhash.near_duplicates(docs).collect()
    want = brute.components(brute.near_pairs(texts, minhash.SHINGLE, minhash.THRESHOLD))
    recall, sound = brute.same_groups(rows, "doc_id", want)
    assert sound and recall >= 0.9, recall
    for r in rows:
        assert r.keep == (r.doc_id == r.group_id) and r.group_size == sum(x.group_id == r.group_id for x in rows)


def test_pruning_never_drops_similar_pairs_beyond_the_miss_rate():
    least = minhash.least_matches(0.5, 16, 128, 0.002)
    rng = np.random.default_rng(1)
    agree = rng.random((20_000, 128)) < 0.5
    alive = np.ones(20_000, bool)
    for n, m in least.items():
        alive &= agree[:, :n].sum(1) >= m
    assert alive.mean() > 0.95
    far = rng.random((2000, 128)) < 0.15
    assert (far[:, :32].sum(1) < least[32]).mean() > 0.9
    assert all(least[n] <= least[n + 16] for n in range(16, 128, 16))


def test_hot_group_and_chain(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base)) for k in range(300)] + [(1000 + k, " ".join(base[:-1] + [f"end{k}"])) for k in range(100)] + [(5000, " ".join(f"z{k}" for k in range(100)))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 400 and {r.group_id for r in out} == {0} and {r.group_size for r in out} == {400}
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 5000]


def test_odd_rows(odd, empty):
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(odd).collect()}
    assert got == {4: 4, 5: 4, 7: 4}
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [k for none, k in ids if not none] == [1, 2, 3, 4, 6, 8, 9, 10, 2**62] and sum(none for none, _ in ids) == 2
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_buckets_of_texts_that_do_not_verify(spark, monkeypatch):
    """Texts that share a third of their words: all meet in buckets, few pairs hold, and none of these is lost."""
    import random

    from lumitide.llm import groups

    rng = random.Random(2)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(120):
        own = [f"o{k // 2 if k < 30 else k}_{j}" for j in range(60)]
        rows.append((k, " ".join(common + own + ([f"e{k}"] if k < 30 else []))))
    rows += [(200 + k, " ".join(common + [f"copy{k % 3}"])) for k in range(90)]  # a large group among them
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(brute.near_pairs(dict(rows), 3, 0.5))
    assert len(set(want.values())) == 16
    for block, pairs in ((512, 1 << 16), (7, 20)):  # many cells, many steps
        monkeypatch.setattr(groups, "BLOCK", block)
        monkeypatch.setattr(groups, "PAIRS", pairs)
        assert {r.doc_id: r.group_id for r in minhash.near_duplicates(df).collect()} == want


def test_pairs_pass_if_every_step_does():
    rng = np.random.default_rng(3)
    least = minhash.least_matches(0.5, 16, 128, 0.002)
    sig = rng.integers(0, 3, (60, 128)).astype(np.uint32)
    i, j = (k.reshape(-1) for k in np.mgrid[0:60, 0:60])
    want = [all((sig[a, :n] == sig[b, :n]).sum() >= m for n, m in least.items()) for a, b in zip(i, j)]
    assert 60 < sum(want) < 3600 and minhash.passing(sig, i, j, least).tolist() == want


def test_a_row_of_each_id_whatever_the_order(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a b c", "en", "x", n) for n in (3, 1, 2)] + [(2, t, None, None, 0) for t in ("z", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `n.chars` long")
    kept = [sorted(map(tuple, minhash.keep_one(d).collect())) for d in (df, df.orderBy(F.desc("`n.chars`")))]
    assert kept[0] == kept[1] == [(1, "a b c", "en", "x", 1), (2, None, None, None, 0)]


def test_components_of_paths_and_random_graphs(spark):
    import random

    from lumitide.llm import groups

    rng = random.Random(4)
    order = rng.sample(range(10_000, 10_150), 150)
    edges = list(zip(order, order[1:])) + [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(5, 5)]
    got = {r.id: r.root for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components([(a, b) for a, b in edges if a != b])
    assert got == want
    half = groups.components(spark.createDataFrame(edges[::2], "a long, b long"))
    rest = spark.createDataFrame([(a, b) for a, b in edges[1::2] if a != b], "a long, b long")
    assert {r.id: r.root for r in groups.merged(half, rest).collect()} == want
