"""Each stage of the pipeline against a plain version of what it says, on its own input."""

import os

import pytest

import corpus_pipeline as C
from lumitide.llm import mil, pii
from lumitide.llm.store import save

from . import brute
from .conftest import SF
from .test_decontaminate import has


@pytest.fixture(scope="module")
def stages(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", at)]
    for name, f in C.STAGES:
        at = save(f(spark, at, SF))
        out.append((name, at))
    return {name: {"df": df, "rows": df.collect()} for name, df in out}


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontaminated", "private", "mixture"] and C.ORACLE_SQL is None
    cols = stages["documents"]["df"].columns
    assert all(stages[n]["df"].columns == cols for n in list(stages)[:-1]) and stages["mixture"]["df"].columns == [*cols, "copies"]


def test_quality(spark, stages):
    docs = stages["documents"]["df"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    keep = {r.doc_id for r in mil.score(docs, mil.fit(docs, labels)).collect() if r.keep}
    assert keep == {r.doc_id for r in stages["quality"]["rows"]}
    lab = labels.collect()
    good = [r.doc_id for r in lab if r.quality and not r.toxic]
    bad = [r.doc_id for r in lab if r.toxic or not r.quality]
    assert sum(k in keep for k in good) > 0.95 * len(good) and sum(k in keep for k in bad) < 0.1 * len(bad)


def test_near_duplicates(stages):
    before = {r.doc_id: r.text for r in stages["quality"]["rows"]}
    after = {r.doc_id for r in stages["near_duplicates"]["rows"]}
    groups = brute.components(brute.near_pairs(before, 3, 0.5))
    assert after <= before.keys() and all(k in groups for k in before.keys() - after)
    roots = set(groups.values())
    assert len([k for k in after if k in groups]) <= len(roots) * 1.1 and all(any(groups.get(k) == r for k in after) for r in roots)


def test_decontaminated(spark, stages):
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := brute.words(r.text))]
    held = {r.doc_id for r in stages["near_duplicates"]["rows"] if any(has(brute.words(r.text), w) for w in items)}
    after = {r.doc_id for r in stages["decontaminated"]["rows"]}
    gone = {r.doc_id for r in stages["near_duplicates"]["rows"]} - after
    assert not held & after and len(gone - held) <= max(3, len(held))


def test_private(stages):
    a = pii.build()
    before = {r.doc_id: r for r in stages["decontaminated"]["rows"]}
    after = {r.doc_id: r for r in stages["private"]["rows"]}
    assert before.keys() == after.keys()
    for k, r in before.items():
        assert after[k].text == pii.redact(r.text, pii.scan(r.text, a))


def test_mixture(stages):
    rows = stages["private"]["rows"]
    size, n = {}, {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(r.text)
        n[r.source] = n.get(r.source, 0) + 1
    goal = sum(size.values()) / len(size)
    got = {}
    for r in stages["mixture"]["rows"]:
        assert r.copies >= 1
        got[r.source] = got.get(r.source, 0) + r.copies
    for s in size:
        assert abs(got.get(s, 0) - goal / size[s] * n[s]) < 1 + 1e-6


def test_run_is_the_stages(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.copies) for r in rows)
    assert key(C.run(spark, SF).collect()) == key(stages["mixture"]["rows"])


def test_odd_rows_pass_every_stage(spark, odd, empty, tmp_path):
    from .conftest import SHARED

    spark.createDataFrame([(4, 1, 0), (9, 0, 1), (6, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, SHARED)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(C.STAGES)
    out = {name: f(spark, odd, str(tmp_path)) for name, f in C.STAGES}
    rows = {name: df.collect() for name, df in out.items()}
    for name, f in C.STAGES:
        added = ["copies"] if name == "mixture" else []
        assert sorted(out[name].columns) == sorted({*odd.columns, *added})
        assert name == "mixture" or out[name].columns == odd.columns
        assert all(r["meta.url"] == "own meta.url" and r["a`b"] == "own a`b" and r["key"] == "own key" for r in rows[name])
        none = f(spark, empty, str(tmp_path))
        assert none.count() == 0 and sorted(none.columns) == sorted(out[name].columns)

    def ids(name):
        return sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in rows[name])

    every = sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in odd.collect())
    keep = [r.keep for r in mil.score(odd, mil.fit(odd, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()]
    assert len(rows["quality"]) == sum(keep) and all(brute.words(r.text) for r in rows["quality"])
    assert ids("near_duplicates") == sorted((n, k, t) for n, k, t in {*every} if k not in (5, 7))
    assert ids("decontaminated") == [x for x in every if x[1] not in (4, 5, 7)]
    assert ids("private") == every and next(r.text for r in rows["private"] if r.doc_id == 9) == "mail me at <EMAIL> or <PHONE>"
    assert all(r.copies >= 1 for r in rows["mixture"]) and {r.doc_id for r in rows["mixture"]} <= {r.doc_id for r in odd.collect()}
    long = next(r for r in odd.collect() if r.doc_id == 6)
    assert all(any(r.text == long.text for r in rows[n]) for n in ("near_duplicates", "decontaminated", "private"))
    assert stage.keys() == out.keys() and os.path.exists(f"{tmp_path}/labels.parquet")
