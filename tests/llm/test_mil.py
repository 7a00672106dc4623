import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumitide.llm import mil


def labelled(sf="/root/testdata/sf0.1"):
    d = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pandas().drop_duplicates("doc_id").set_index("doc_id")
    lab = pq.read_table(f"{sf}/labels.parquet").to_pandas().drop_duplicates("doc_id")
    lab = lab[lab.doc_id.isin(d.index)]
    return pa.array(d.loc[lab.doc_id, "text"].tolist()), lab[["quality", "toxic"]].to_numpy(float)


@pytest.fixture(scope="module")
def split():
    t, y = labelled()
    half = np.arange(len(y)) % 2 == 0
    return t.filter(pa.array(half)), y[half], t.filter(pa.array(~half)), y[~half]


@pytest.fixture(scope="module")
def model(split):
    return mil.train(split[0], split[1])


def test_held_out_accuracy(split, model):
    _, _, t, y = split
    p, _ = model.scores(mil.passages(t))
    hit = (p >= 0.5) == (y > 0)
    assert hit[:, 0].mean() > 0.95 and hit[:, 1].mean() > 0.95
    toxic = y[:, 1] > 0
    assert hit[toxic, 1].mean() > 0.85 and hit[~toxic, 1].mean() > 0.98
    assert mil._reject(p, mil.CUT)[toxic].mean() > 0.92
    good = (y[:, 0] > 0) & ~toxic
    assert (~mil._reject(p, mil.CUT))[good].mean() > 0.95


def test_attention_is_a_distribution(split, model):
    p = mil.passages(split[2])
    _, a = model.scores(p)
    some = np.flatnonzero(np.diff(p.first) > 0)
    assert np.allclose(np.add.reduceat(a, p.first[some], axis=0), 1, atol=1e-4) and (a >= 0).all()


def test_loss_falls_and_training_is_repeatable():
    t = pa.array(["good words here " * 30, "BAD!!! $$$ stuff", "more good words", "ugly %%% BAD"] * 4)
    y = np.array([[1, 0], [0, 1], [1, 0], [0, 0]] * 4, float)

    def loss(m):
        s, _ = m.scores(mil.passages(t))
        s = np.clip(s, 1e-6, 1 - 1e-6)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum(1).mean()

    losses = [loss(mil.train(t, y, epochs=e)) for e in (0, 5, 60)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.2
    again = mil.train(t, y, epochs=5)
    assert np.array_equal(again.w["e"], mil.train(t, y, epochs=5).w["e"])


def small_model(rng):
    t = ["good words here " * 40 + "Tail. 12", "BAD!!! $$$ stuff", "more good words\n\nx y", "ugly %%% BAD " * 30] * 2
    y = np.array([[1, 0], [0, 1], [1, 0], [0, 0]] * 2, float)
    m = mil.train(pa.array(t), y, epochs=2)
    w = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * (0.05 if k not in ("mean", "sd") else 0) for k, v in m.w.items()}
    return t, y, m, w


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(4)
    t, y, m, w = small_model(rng)
    p = mil.passages(pa.array(t))
    row, k, v = m.lookup(p)
    x = np.zeros((len(p.shape), len(m.vocab)))
    x[row, k] = v
    shape, first = p.shape.astype(np.float64), p.first[:-1]
    _, d = mil.gradients(w, x, shape, first, y)
    for name in ("e", "s", "b", "v", "u", "a", "c", "d"):
        for at in rng.permutation(w[name].size)[:12].tolist():
            up, down = ({**w, name: w[name].copy()} for _ in range(2))
            up[name].flat[at] += 1e-5
            down[name].flat[at] -= 1e-5
            numeric = (mil.gradients(up, x, shape, first, y)[0] - mil.gradients(down, x, shape, first, y)[0]) / 2e-5
            assert abs(numeric - d[name].flat[at]) < 1e-6 + 1e-4 * abs(numeric), (name, at)


def test_scores_against_plain_loops():
    """Passages, features, gated attention and heads, a number at a time."""
    import math

    from . import brute

    rng = np.random.default_rng(6)
    t, _, m, w = small_model(rng)
    m.w = w
    got, attention = m.scores(mil.passages(pa.array(t)))
    from lumitide.llm.tokens import hash_words

    nth = {int(h): k for k, h in enumerate(m.vocab)}
    place = 0
    for d, text in enumerate(t):
        words = brute.words(text)
        shapes = mil.passages(pa.array([text])).shape
        hidden, scores = [], []
        for q in range(0, len(words), mil.PASSAGE):
            counts = {}
            for word in words[q : q + mil.PASSAGE]:
                stems = [int(mil.mix(hash_words(word[:k]) * 0 + mil.word_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([k]), mil._FOLD) + np.uint64(k))[0]) for k in mil.STEMS if len(word.encode()) > k]
                for h in [int(hash_words(word)[0]), *stems]:
                    if h in nth:
                        counts[nth[h]] = counts.get(nth[h], 0) + 1
            shape = [(a - b) / c for a, b, c in zip(shapes[q // mil.PASSAGE], w["mean"], w["sd"])]
            h = [math.tanh(sum(math.log1p(n) * w["e"][k, j] for k, n in counts.items()) + sum(s * w["s"][i, j] for i, s in enumerate(shape)) + w["b"][j]) for j in range(w["b"].size)]
            gate = [math.tanh(sum(x * w["v"][i, j] for i, x in enumerate(h))) / (1 + math.exp(-sum(x * w["u"][i, j] for i, x in enumerate(h)))) for j in range(w["a"].shape[0])]
            hidden.append(h)
            scores.append([sum(g * w["a"][j, label] for j, g in enumerate(gate)) for label in range(2)])
        for label in range(2):
            e = [math.exp(s[label]) for s in scores]
            a = [x / sum(e) for x in e]
            assert np.allclose(attention[place : place + len(a), label], a, atol=1e-5)
            z = [sum(x * h[j] for x, h in zip(a, hidden)) for j in range(w["b"].size)]
            out = sum(x * w["c"][j, label] for j, x in enumerate(z)) + w["d"][label]
            assert abs(got[d, label] - 1 / (1 + math.exp(-out))) < 1e-5
        place += len(hidden)


def test_labels_that_train_nothing_are_logged(spark, odd, caplog):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert mil.fit(odd, labels, train_bytes=10).constant == (1.0, 0.0) and "no labelled document" in caplog.text


def test_shape_figures_by_hand():
    p = mil.passages(pa.array(["Ab 1!", "", None, "x " * 130, "  lead"]))
    assert np.diff(p.first).tolist() == [1, 0, 0, 3, 1]
    assert np.allclose(p.shape[0][:5], [1 / 3, 1 / 5, 1 / 5, 1 / 5, 1 / 2]) and p.shape[2][6] > 0.9


def test_scores_do_not_depend_on_neighbours(model, split):
    t = split[2][:40]
    whole, _ = model.scores(mil.passages(t))
    one = np.concatenate([model.scores(mil.passages(t[k : k + 1]))[0] for k in range(len(t))])
    assert np.allclose(whole, one, atol=1e-4)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, 0), (9, 0, 1), (None, 1, 1), (5, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    m = mil.fit(odd, labels)
    out = mil.score(odd, m).collect()
    assert len(out) == odd.count() and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in out)
    assert [(r.n_passages, r.keep) for r in out if r.doc_id in (1, 2, 3)] == [(0, False)] * 3
    kept = mil.kept(odd, m)
    assert kept.columns == odd.columns and kept.count() == sum(r.keep for r in out)
    none = mil.fit(odd, labels.where("false"))
    assert all(r.keep for r in mil.score(odd, none).where("n_passages > 0").collect())
    assert mil.score(empty, mil.fit(empty, labels)).count() == 0


def test_one_sided_labels(spark, odd):
    m = mil.fit(odd, spark.createDataFrame([(4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int"))
    assert m.constant == (1.0, 0.0)


def test_the_bound_is_kept(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in (4, 5, 6, 7, 9, 10)], "doc_id long, quality int, toxic int")
    assert mil.fit(odd, labels, train_docs=1).constant == (1.0, 0.0)
    assert mil.fit(odd, labels, train_bytes=100).constant is not None


def test_a_very_long_text_does_not_empty_the_sample(spark, monkeypatch):
    ids = [r[0] for r in spark.range(1, 9).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    rows = [(d, "long words " * 1000 if d == ids[0] else f"text {d} of few words") for d in ids]
    labels = [(d, n % 2, n // 2 % 2) for n, d in enumerate(ids)]
    seen = []
    train = mil.train
    monkeypatch.setattr(mil, "train", lambda texts, y, **k: seen.append((len(texts), int(sum(len(t.as_py()) for t in texts)))) or train(texts, y, **k))
    m = mil.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), train_bytes=1000)
    assert seen[0][0] == 7 and seen[0][1] <= 1000 and m.constant == (None, None)
