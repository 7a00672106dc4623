import random

import pytest

from lumitide.llm import suffixes

from . import brute


def passages(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.start_word)):
        assert r.n_words == r.end_word - r.start_word
        out.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    return out


def test_whole_table(docs, texts):
    assert passages(suffixes.repeated_passages(docs)) == brute.repeats(texts, suffixes.LEAST)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefghij") for _ in range(rng.randint(5, 25))] for _ in range(5)]
    rows = []
    for k in range(25):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(shared) if rng.random() < 0.4 else [rng.choice("klmnopqr") for _ in range(rng.randint(1, 9))]
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages(suffixes.repeated_passages(df, 8, 3)) == brute.repeats(dict(rows), 8)


def test_passages_of_two_documents_side_by_side(spark):
    a, b = [[f"{x}{k}" for k in range(75)] for x in "ab"]
    touching = [(1, a[:50] + b[:50]), (2, a[:50]), (3, b[:50])]
    crossing = [(11, a), (12, a[:50]), (13, a[25:75])]
    for rows, want in ((touching, {1: [(0, 50), (50, 100)], 2: [(0, 50)], 3: [(0, 50)]}), (crossing, {11: [(0, 50), (25, 75)], 12: [(0, 50)], 13: [(0, 50)]})):
        texts = [(k, " ".join(w)) for k, w in rows]
        df = spark.createDataFrame(texts, "doc_id long, text string")
        assert passages(suffixes.repeated_passages(df)) == want == brute.repeats(dict(texts), 50)
        assert passages(suffixes.repeated_passages(df, hot=0)) == want


@pytest.mark.parametrize("hot", [0, 3, 20])
def test_hot_first_words_give_the_same(docs, texts, hot):
    assert passages(suffixes.repeated_passages(docs, hot=hot)) == brute.repeats(texts, suffixes.LEAST)


def test_the_sql_finds_the_same(spark, docs):
    import duckdb

    from lumitide.llm.oracles import ORACLES

    from .conftest import SF

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.sql(ORACLES["op6_sparse_suffix_dedup"]).fetchall())
    cols = ["doc_id", "start_word", "end_word", "n_words"]
    assert want and sorted(map(tuple, suffixes.repeated_passages(docs).select(cols).collect())) == want


def test_odd_rows(odd, empty):
    assert passages(suffixes.repeated_passages(odd)) == {4: [(0, 60)], 5: [(1, 61)], 7: [(0, 60)]}
    assert suffixes.repeated_passages(empty).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeated_passages(odd, 5, 9)


def test_a_repeat_within_one_document_is_none(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, f"{text} {text}"), (2, "short")], "doc_id long, text string")
    assert suffixes.repeated_passages(df).count() == 0
