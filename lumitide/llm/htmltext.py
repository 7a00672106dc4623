"""Main text of web pages by tag-path ratios (operator 1).

A page is read once into its text nodes, each with the path of tags from the root to it.  For
every path the lengths and the punctuation of its nodes are aggregated; each node gets its
path's mean length and mean punctuation, both are smoothed along the page with a Gaussian kernel
and scaled to the page's greatest, and fused as length * (1 + punctuation) / 2.  A path's nodes are
content if the path's mean fused value reaches ``LAMBDA`` standard deviations of all nodes'.

Markup needn't be well formed: an end tag closes up to its start tag or is ignored, block tags
end an open paragraph, list items and cells end their like, an open head ends at text or at the
first start tag that can't stand in it, unclosed comments and scripts run to the end.

Defined results: a null or empty page, and one without text nodes, gives no nodes and an empty text; an
empty table gives no rows, and each row one, also rows with a null id and repeated ones; with a single path, or all
values equal, everything is content; a path whose value equals the threshold is content.  A page of any
length and depth is read whole, in time and memory that grow with its length: paths are numbered by
parent and tag, never held as strings.  Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import text_slices

RADIUS, SIGMA, LAMBDA = 2, 1.0, 0.8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)(?:(?:[^>\"'<]+|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*>?)", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template svg math textarea select iframe object canvas head".split())
HEAD = frozenset("html head title meta link base basefont bgsound style script noscript noframes template".split())
RAW = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in ("script", "style", "textarea")}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIKE = {"li": (["li"], frozenset(("ul", "ol", "menu"))), "dt": (["dt", "dd"], frozenset(("dl",))), "dd": (["dt", "dd"], frozenset(("dl",))), "tr": (["tr", "td", "th"], frozenset(("table",))), "td": (["td", "th"], frozenset(("tr", "table"))), "th": (["td", "th"], frozenset(("tr", "table"))), "option": (["option"], frozenset(("select",)))}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SPACE = re.compile(r"\s+")


class _Paths:
    """Tag paths by number: each is its parent's number and a tag; 0 is the empty path."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parts: list[tuple[int, str]] = [(0, "")]

    def child(self, parent: int, name: str) -> int:
        k = self.number.setdefault((parent, name), len(self.parts))
        if k == len(self.parts):
            self.parts.append((parent, name))
        return k

    def text(self, k: int) -> str:
        names = []
        while k:
            k, name = self.parts[k]
            names.append(name)
        return "".join(f"/{n}" for n in reversed(names))


class _Stack:
    """Open elements, and for each tag where it is open."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths = [0]
        self.at: dict[str, list[int]] = {}
        self.known = _Paths()
        self.skipping = 0  # depth at which a skipped element began, plus 1

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.paths.append(self.known.child(self.paths[-1], name))
        if name in SKIP and not self.skipping:
            self.skipping = len(self.names)

    def pop(self, to: int) -> None:
        for name in self.names[to:]:
            self.at[name].pop()
        del self.names[to:], self.paths[to + 1 :]
        if self.skipping > to:
            self.skipping = 0

    def last(self, name: str) -> int:
        """Where the innermost one is open, or -1."""
        at = self.at.get(name)
        return at[-1] if at else -1

    def first_after(self, name: str, place: int) -> int | None:
        """Where the outermost one inside of a place is open."""
        at = self.at.get(name) or []
        k = bisect_right(at, place)
        return at[k] if k < len(at) else None


def parse(page: str) -> tuple[list[int], list[str], _Paths]:
    """Path number and text of every text node outside of scripts, heads and the like, in order."""
    of: list[int] = []
    pieces: list[list[str]] = []
    stack = _Stack()
    broke = True

    def add(text: str) -> None:
        if stack.skipping and stack.names[-1] == "head" and text.strip():
            stack.pop(stack.at["head"][0])
        if stack.skipping or not text:
            return
        text = SPACE.sub(" ", html.unescape(text)).strip()
        if text:
            if of and of[-1] == stack.paths[-1] and not broke:
                pieces[-1].append(text)
            else:
                of.append(stack.paths[-1])
                pieces.append([text])

    at = pos = 0
    while True:
        lt = page.find("<", pos)
        m = TOKEN.match(page, lt) if lt >= 0 else None
        if not m:
            if lt >= 0:
                pos = lt + 1
                continue
            add(page[at:])
            return of, [" ".join(p) for p in pieces], stack.known
        add(page[at : m.start()])
        at = pos = m.end()
        if m[1] is not None:
            broke = False
            add(m[1])
            continue
        if not m[3]:
            broke = False  # a comment doesn't part a text
            continue
        name = m[3].lower()
        broke = True
        if m[2]:
            if (i := stack.last(name)) >= 0:
                stack.pop(i)
            continue
        if name in ENDS_P and (i := stack.last("p")) >= 0:
            stack.pop(i)
        if name in LIKE:
            like, scope = LIKE[name]
            inside = max(stack.last(x) for x in scope)
            outer = [i for x in like if (i := stack.first_after(x, inside)) is not None]  # a row ends the open cell and the row around it
            if outer:
                stack.pop(min(outer))
        if stack.skipping and stack.names[-1] == "head" and name not in HEAD:
            stack.pop(stack.at["head"][0])
        if name in VOID or m[0].endswith("/>"):
            continue
        if name == "body" and stack.skipping and stack.at.get("head"):
            stack.pop(stack.at["head"][0])
        stack.push(name)
        if name in RAW:  # inside a script or the like only its own end tag counts
            end = RAW[name].search(page, at)
            if not end:
                return of, [" ".join(p) for p in pieces], stack.known
            at = pos = end.start()


def text_nodes(page: str) -> list[tuple[str, str]]:
    """(tag path, text) of every text node, in order."""
    of, texts, known = parse(page)
    return [(known.text(k), t) for k, t in zip(of, texts)]


def smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the nodes, over those there are at the ends."""
    out, weight = np.zeros(len(x)), np.zeros(len(x))
    for d in range(-RADIUS, RADIUS + 1):
        w = math.exp(-d * d / (2 * SIGMA * SIGMA))
        lo, hi = max(0, -d), min(len(x), len(x) - d)
        if lo < hi:
            out[lo:hi] += w * x[lo + d : hi + d]
            weight[lo:hi] += w
    return out / weight


def select(of: list[int], texts: list[str]) -> np.ndarray:
    """Which nodes are content; of: the number of each node's path."""
    if not of:
        return np.zeros(0, bool)
    ids, path = np.unique(np.array(of), return_inverse=True)
    length = np.array([len(t) - t.count(" ") for t in texts], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t in texts], float)
    n = np.bincount(path)
    parts = []
    for x in (length, marks):
        s = smooth((np.bincount(path, x) / n)[path])
        parts.append(s / s.max() if s.max() > 0 else s)
    fused = parts[0] * (1 + parts[1]) / 2
    of_path = np.bincount(path, fused) / n
    sd = float(fused.std())
    return np.ones(len(of), bool) if sd < 1e-12 or len(ids) == 1 else (of_path >= LAMBDA * sd)[path]


def extract(page: str | None) -> tuple[int, int, int, str]:
    """Nodes, paths, content nodes and content text of a page."""
    of, texts, _ = parse(page or "")
    keep = select(of, texts)
    return len(of), len(set(of)), int(keep.sum()), "\n".join(t for t, k in zip(texts, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, n_nodes, n_paths, n_content, text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "html"):
            got = [extract(h) for h in b.column("html").to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *cols], names=["page_id", "url", "n_nodes", "n_paths", "n_content", "text"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, n_nodes long, n_paths long, n_content long, text string")
