from lumitide.llm import licenses

from . import brute

PHRASES = {}
for name, _, phrases in licenses.TEMPLATES:
    PHRASES.setdefault(name, []).append([brute.words(p) for p in phrases])


def has(w, p):
    return any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))


def test_against_a_search_of_every_notice(docs, texts):
    rows = licenses.find_licenses(docs).collect()
    found = {(r.doc_id, r.license) for r in rows}
    whole = {(k, name) for k, t in texts.items() for name, notice, _ in licenses.TEMPLATES if has(brute.words(t), brute.words(notice))}
    assert whole and whole <= found
    for r in rows:
        w = brute.words(texts[r.doc_id])
        near = w[max(0, r.position - 8) : r.position + 60]
        assert any(all(has(near, p) for p in ps) for ps in PHRASES[r.license]), r
        assert 0 < r.share <= 1 and r.anchors >= 1


def test_places_families_and_edits(spark):
    rows = [
        (1, "intro words " + licenses.TEMPLATES[0][1] + " then " + licenses.TEMPLATES[0][1]), (2, "Licensed under CC BY-SA 4.0."), (3, "licensed   under the\nAPACHE license, (version 2.0)"), (4, "the mit of licenses and a license"),
        (5, "This library is licensed under the GNU Lesser General Public License."), (6, "This program is licensed under the GNU General Public License, version 2."),
    ]
    got = {}
    for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.position))
    assert sorted(got[1]) == [("MIT", 2), ("MIT", 8)] and got[2] == [("CC-BY-SA-4.0", 0)] and got[3][0][0] == "Apache-2.0"
    assert 4 not in got and [x[0] for x in got[5]] == ["LGPL"] and [x[0] for x in got[6]] == ["GPL-2.0"]


def test_odd_rows(odd, empty):
    assert licenses.find_licenses(odd).count() == 0 and licenses.find_licenses(empty).count() == 0


def test_frequencies_are_of_all_documents(docs, texts):
    import numpy as np

    vocab = np.unique(licenses.hash_words("mit license released the"))
    df, n = licenses.document_frequencies(docs, vocab)
    assert n == len(texts)
    by = dict(zip(vocab.tolist(), df.tolist()))
    for x in ("mit", "license", "the"):
        assert by[licenses.hash_words(x)[0]] == sum(x in set(brute.words(t)) for t in texts.values())


def licences(spark, *texts):
    got = {k: set() for k in range(len(texts))}
    for r in licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    return [got[k] for k in range(len(texts))]


def test_two_licences_on_a_line(spark):
    got = licences(spark, "Licensed under either of Apache License, Version 2.0 or MIT license", "Released under the MIT license or licensed under CC BY 4.0.", "This program is licensed under the GNU General Public License, version 2.")
    assert got == [{"Apache-2.0", "MIT"}, {"MIT", "CC-BY-4.0"}, {"GPL-2.0"}]


FSF = """# This file is part of a tool.
# A tool is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, {}either version {} of the License, or
# (at your option) any later version.
#
# It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""


def test_headers_of_files(spark):
    got = licences(
        spark, FSF.format("", "", 3), FSF.format("", "", 2), FSF.format("Lesser ", "", "2.1"), FSF.format("Affero ", "", 3),
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "the GNU General Public License as published by someone, in version 3 of a text",
    )
    assert got == [{"GPL-3.0"}, {"GPL-2.0"}, {"LGPL"}, {"AGPL-3.0"}, {"GPL-2.0"}, {"ISC"}, set()]


def test_spdx_lines(spark):
    got = licences(
        spark, "// SPDX-License-Identifier: MIT\nint x;", "SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) AND Apache-2.0 WITH LLVM-exception", "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR BSD-3-Clause",
        "SPDX-License-Identifier: Foo-1.0 OR ISC", "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: LGPL-2.1+\nimport mit or isc", "the identifier of a license: MIT", "SPDX-License-Identifier:",
    )
    assert got == [{"MIT"}, {"GPL-2.0", "MIT", "Apache-2.0"}, {"GPL-2.0", "BSD"}, {"ISC"}, {"MIT-0"}, {"LGPL"}, set(), set()]


def test_a_row_for_each_place(spark):
    rows = [(1, "All rights reserved. " * 6), (2, "All rights reserved. " * 8000), (4, "Released under the MIT License. " * 3 + "Licensed under CC BY 4.0. " * 2)]
    got = {}
    for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.license), []).append(r.position)
    assert sorted(got[1, "proprietary"]) == list(range(0, 18, 3)) and len(got[2, "proprietary"]) == 8000
    assert len(got[4, "MIT"]) == 3 and len(got[4, "CC-BY-4.0"]) == 2


def slow_find(texts):
    """Every place of every template, tried one after the other."""
    import math

    split = [brute.words(t) for t in texts]
    df = {}
    for w in split:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for k, w in enumerate(split):
        hits = []
        for name, notice, phrases in licenses.TEMPLATES:
            t, ps = brute.words(notice), [brute.words(p) for p in phrases]
            rare = sorted(set(t), key=lambda x: (df.get(x, 0), x))[: licenses.ANCHORS]
            off = next(i for i in range(len(t)) if t[i : i + len(ps[0])] == ps[0])
            for at in range(len(w)):
                if w[at : at + len(ps[0])] != ps[0]:
                    continue
                shift, near = at - off, {}
                for x in rare:
                    agree = sorted((abs(p - q - shift), p - q, p) for p in range(max(0, shift - 3), min(len(w), shift + len(t) + 3)) if w[p] == x for q in range(len(t)) if t[q] == x and abs(p - q - shift) <= licenses.SLACK)
                    if agree:
                        near[x] = agree[0][2]
                stretch = w[max(0, shift - 3) : shift + len(t) + 3]
                if len(near) >= max(1, math.ceil(len(rare) / 2)) and all(has(stretch, p) for p in ps):
                    share = len(set(t) & set(stretch)) / len(set(t))
                    hits.append((-share * len(t), max(0, shift), name, len(near), share, min(at, *near.values()), max(at + len(ps[0]), *(p + 1 for p in near.values()))))
        taken = []
        for h in sorted(hits, key=lambda h: (h[0], h[1], h[2])):
            if not any(n == h[2] and b < h[6] and h[5] < e for n, b, e in taken):
                taken.append((h[2], h[5], h[6]))
                out.append((k, h[2], h[1], h[3], round(h[4], 9)))
    return sorted(out)


def test_against_every_place_of_every_template(spark, texts):
    import random

    rng = random.Random(3)
    pieces = [t[1] for t in licenses.TEMPLATES] + ["some words between", "mit license", "all rights", "the gnu general public license, version 2"]
    made = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    for data in (made, [t or "" for t in texts.values()]):
        df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
        got = sorted((r.doc_id, r.license, r.position, r.anchors, round(r.share, 9)) for r in licenses.find_licenses(df).collect())
        assert got and got == slow_find(data)


def test_the_sql_finds_the_same(spark, docs, tmp_path):
    import random

    import duckdb

    from lumitide.llm.oracles import ORACLES

    rng = random.Random(7)
    pieces = [t[1] for t in licenses.TEMPLATES] + ["some words between", "mit license", "all rights", "SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) AND Apache-2.0 WITH LLVM-exception OR ISC", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR Foo-1.0 and BSD-3-Clause", "SPDX-License-Identifier: CC-BY-SA-4.0"]
    made = [(k, " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))) for k in range(60)] + [(None, "MIT license"), (3, None), (4, "")]
    con = duckdb.connect()
    for n, df in enumerate((spark.createDataFrame(made, "doc_id long, text string"), docs.select("doc_id", "text"))):
        df.write.parquet(f"{tmp_path}/{n}")
        con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{n}/*.parquet')")
        want = sorted((d, x, p, a, round(s, 9)) for d, x, p, a, s in con.sql(ORACLES["op5_license_scan"]).fetchall())
        assert want and sorted((r.doc_id, r.license, r.position, r.anchors, round(r.share, 9)) for r in licenses.find_licenses(df).collect()) == want
