import math

import pytest

from lumitide.llm import htmltext as H

from .conftest import SF

PAGE = "<html><head><title>T</title></head><body><nav><ul>{links}</ul></nav><div id=main><p>{p}</p><p>{p}</p></div><footer>{feet}</footer><script>if (a < b) '</p>'</script></body></html>"
P = "A long sentence of real text, with commas, and full stops. It goes on; it ends."


def slow_select(nodes):
    """The method in plain loops."""
    paths = sorted({p for p, _ in nodes})
    fig = {p: [t for q, t in nodes if q == p] for p in paths}
    length = {p: sum(len(t.replace(" ", "")) for t in ts) / len(ts) for p, ts in fig.items()}
    marks = {p: sum(sum(c in ".,;:!?…。，、；：！？" for c in t) for t in ts) / len(ts) for p, ts in fig.items()}

    def smooth(x):
        out = []
        for i in range(len(x)):
            near = [(math.exp(-(d * d) / 2), x[i + d]) for d in range(-2, 3) if 0 <= i + d < len(x)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        top = max(out)
        return [v / top if top > 0 else v for v in out]

    a, b = smooth([length[p] for p, _ in nodes]), smooth([marks[p] for p, _ in nodes])
    fused = [x * (1 + y) / 2 for x, y in zip(a, b)]
    m = sum(fused) / len(fused)
    sd = math.sqrt(sum((f - m) ** 2 for f in fused) / len(fused))
    mean = {p: sum(f for f, (q, _) in zip(fused, nodes) if q == p) / len(fig[p]) for p in paths}
    return [True] * len(nodes) if sd < 1e-12 or len(paths) == 1 else [mean[p] >= H.LAMBDA * sd - 1e-12 for p, _ in nodes]


def test_against_plain_loops(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r for r in H.extract_pages(df).collect()}
    assert len(out) == df.count()
    for r in df.collect():
        nodes = H.text_nodes(r.html or "")
        if nodes:
            keep = slow_select(nodes)
            assert out[r.page_id].text == "\n".join(t for (_, t), k in zip(nodes, keep) if k) and out[r.page_id].n_content == sum(keep)


def test_content_is_found():
    n, paths, kept, text = H.extract(PAGE.format(links="<li><a>x</a></li>" * 20, p=P, feet="<div><a>c</a></div>" * 12))
    assert text == f"{P}\n{P}" and (n, paths, kept) == (34, 3, 2)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b", [("/p", "a"), ("/p", "b")]), ("<ul><li>a<li>b</ul>c", [("/ul/li", "a"), ("/ul/li", "b"), ("", "c")]), ("<b>x<!-- y --> z</b>", [("/b", "x z")]), ("a <![CDATA[b]]> c", [("", "a b c")]), ("<p>1 < 2 &amp; 3</p>", [("/p", "1 < 2 & 3")]),
        ("<script>x</script><style>y", []), ("<a title='>'>t</a>", [("/a", "t")]), ("</p></div>t", [("", "t")]), ("<div><br/>t<img src=x>u</div>", [("/div", "t"), ("/div", "u")]), ("<", [("", "<")]), ("<!-- open", []), ("<table><tr><td>a<td>b<tr><td>c</table>", [("/table/tr/td", "a"), ("/table/tr/td", "b"), ("/table/tr/td", "c")]),
    ],
)
def test_markup(page, want):
    assert H.text_nodes(page) == want


def test_hostile_pages_are_fast():
    import time

    t = time.time()
    for page in ("<" * 200_000, "<a " * 50_000, "<div>" * 20_000 + "x", "<script>" + "</" * 100_000, "<!--" * 50_000, "<a b='" * 30_000, "&" * 200_000):
        H.extract(page)
    assert time.time() - t < 40


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "   "), (None, "u", "<p>x</p>"), (4, "u", "<p>x</p>"), (4, "u", "<p>x</p>"), (5, "u", "<p>" + "long text. " * 100_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, n_nodes string")
    out = H.extract_pages(df)
    assert out.count() == 7 and {r.text for r in out.where("page_id < 4").collect()} == {""}
    assert out.where("page_id = 4").count() == 2 and out.where("page_id is null").first().text == "x"
    assert H.extract_pages(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>x</title><p>text", [("/html/p", "text")]), ("<html><head><meta charset=utf-8><link rel=a><title>x</title><script>y</script><div>a</div>b", [("/html/div", "a"), ("/html", "b")]), ("<head><title>x</title>only text", [("", "only text")]),
        ("<head><title>x</title><br>a<p>b", [("", "a"), ("/p", "b")]), ("<head><noscript><img src=x></noscript><title>x</title></head><body>a", [("/body", "a")]), ("<head><style>p</style>\n<template><p>x</p></template>\n</head>a", [("", "a")]), ("<head><title>x</title><body><p>a", [("/body/p", "a")]),
    ],
)
def test_an_open_head_ends(page, want):
    assert H.text_nodes(page) == want


def test_deep_and_hostile_pages_take_little_memory_and_time():
    """A child process under 400 MB more than it has after its imports reads deep pages, and scripts full of end tags."""
    import os
    import subprocess
    import sys

    code = """
import resource, sys, time
from lumitide.llm import htmltext as H
have = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
resource.setrlimit(resource.RLIMIT_AS, (have + (400 << 20),) * 2)
t = time.time()
for page in ("<div>" * 60_000 + "x", "<div>x" * 60_000, "<p><i>" * 40_000 + "<div>", "<script>" + "</x" * 100_000, "<script>" + "</script" * 30_000 + "x", "<li><ul>" * 30_000 + "<li>" * 30_000, "<td>" * 50_000, "a<!-- -->" * 100_000, "</div>" * 100_000, "<b></i>" * 50_000):
    H.extract(page)
assert time.time() - t < 60, time.time() - t
print(H.extract("<div>" * 60_000 + "x")[:3])
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": root, "OPENBLAS_NUM_THREADS": "1"})
    assert out.returncode == 0 and out.stdout.split("\n")[-2] == "(1, 1, 1)", out.stderr[-500:]


@pytest.mark.parametrize(
    ("page", "want"),
    [("<script>a</x>b</SCRIPT >c", [("", "c")]), ("<style></styles></style/>c", [("", "c")]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("/ul/li", "a"), ("/ul/li/ul/li", "b"), ("/ul/li", "c")]), ("<p>a<b>b<div>c", [("/p", "a"), ("/p/b", "b"), ("/div", "c")])],
)
def test_more_markup(page, want):
    assert H.text_nodes(page) == want
