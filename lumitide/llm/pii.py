"""Personal data by anchor expansion (operator 8).

One Aho-Corasick pass over each text finds anchors: the at-sign, ``://`` and ``www.``, a plus
before a digit, digit pairs, a digit before a dot, colons of IPv6 addresses, and cue words of secrets,
accounts and streets.  From each anchor a deterministic local parser expands left and right to the borders
of an email, web address, IP address, telephone number, card, bank account, social security
number, secret or street address, and validates what it found (Luhn, mod 97, octets, lengths).  Letters
of all scripts count in mail addresses and host names.

Limits, all of the formats themselves: a password after its cue has 6 characters or more, in quotes any
number; other secrets have 16 or more with a digit, a token of an Authorization header 8 or more.  Telephone
numbers without a plus are found if their groups are parted: ddd ddd dddd (the first group from 200 on, or in
brackets), and groups after a trunk 0 with 10 or 11 digits in all.  A street has a number of up to 5 digits and 1 to 3
capitalised words before its kind.  An IPv6 address has two groups or more, one with a digit.

Defined results: a null or empty text has no findings, and an empty table gives no rows; overlapping findings
are resolved to the earliest, then the longest, then by kind; rows with a null id are scanned and redacted, their
findings carry the null; repeated rows are scanned each; a text of any length is scanned whole, in time that
grows with its length.  Extra columns, whatever they are called, are ignored by :func:`find` and kept by :func:`clean`.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_rows
from .tokens import text_slices

SECRET_CUES = ("token", "secret", "api_key", "apikey", "api-key", "access_key", "private_key")
PASSWORD_CUES = ("password", "passwd")
SECRET_HEADS = ("akia", "ghp_", "xoxb-", "sk-", "glpat-")
STREETS = ("street", "avenue", "boulevard", "road", "lane", "drive")

EMAIL_LOCAL = frozenset("._%+-")
_LABEL = r"[^\W_](?:[\w\u200c\u200d-]{0,61}[^\W_])?"
DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.(?:[^\W\d_]{{2,24}}|[xX][nN]--[A-Za-z0-9-]{{1,59}})(?![^\W_])")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^\x00-\x1f]+")
IPV4 = re.compile(r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\w]|\.\d)")
PHONE = re.compile(r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\d)")
DIGITS = re.compile(r"\d(?:[ -]?\d)*")
CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|3\d{3}([ -])\d{6}\2\d{5})(?!\d)")
SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: National numbers: with the area in brackets, in three groups, after a trunk 0 in pairs and in longer groups.
NATIONAL = re.compile(
    r"(?<![\w.+-])(?:1[ .-]?)?\([2-9]\d{2}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-]|\.\d)"
    r"|(?<![\w.+-])(?:1([.-]))?[2-9]\d{2}([.-])\d{3}\2\d{4}(?![\w-]|\.\d)"
    r"|(?<![\w.+-])(?<!\d )(?:1 )?[2-9]\d{2} \d{3}[ -]\d{4}(?![\w-]|[ .]\d)"
    r"|(?<![\w.+-])(?<!\d )0\d([ .-])\d{2}(?:\3\d{2}){3}(?![\w-]|[ .]\d)"
    r"|(?<![\w.+-])(?<!\d )(?=(?:[() -]*\d){10,11}(?![() -]*\d))(?:\(0\d{1,4}\) ?|0\d{1,4}[ -])\d{3,4}[ -]?\d{3,4}(?![\w-]|[ .]\d)"
)
SECRET = re.compile(r"[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-./+=]{16,})[\"']?")
#: A password in quotes, or up to a space; what was replaced before isn't one.
PASSWORD = re.compile(r"[\"']?\s*[:=]\s*(?!<[A-Z]+>)(?:\"(?!<[A-Z]+>)((?:[^\"\\\n]|\\.)+)\"|'(?!<[A-Z]+>)((?:[^'\\\n]|\\.)+)'|[\"']?(?!<[A-Z]+>)([^\s\"']{6,}))")
BEARER = re.compile(r"(?:[\"']?\s*[:=]\s*|\s+)[\"']?([A-Za-z0-9_\-.~/+=]{8,})")
HEADER = re.compile(r"authorization[\"']?\s{0,8}[:=]\s{0,8}[\"']?$", re.I)
SECRET_TAIL = re.compile(r"[A-Za-z0-9_\-]{16,}")
NUMBER, NAME = re.compile(r"\d{1,5}"), re.compile(r"[A-Z][a-z]+")
HOST = re.compile(r"[^/?#]*")
IPV6 = re.compile(r"[0-9A-Fa-f:]*:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f:]*")

#: Formats that are looked for around digits and before tokens end within so many characters.
REACH = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = ord(ch) - 48
        if i & 1:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1


def build() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("://", "scheme"), ("www.", "www"), ("bearer", "bearer"), *((w, "secret") for w in SECRET_CUES), *((w, "password") for w in PASSWORD_CUES), *((w, "head") for w in SECRET_HEADS), *((f" {w}", "street") for w in STREETS)]:
        a.add_word(word, (kind, len(word)))
    for x in range(10):
        a.add_word(f"+{x}", ("plus", 2))
        a.add_word(f"{x}.", ("dot", 2))
    for x in "0123456789abcdef:":
        a.add_word(f":{x}", ("colon", 2))
    for x in range(10):
        for y in range(10):
            a.add_word(f"{x}{y}", ("digits", 2))
    a.make_automaton()
    return a


def _email(t: str, at: int) -> tuple[str, int, int] | None:
    b = at
    while b and (t[b - 1].isalnum() or t[b - 1] in EMAIL_LOCAL or unicodedata.combining(t[b - 1])):
        b -= 1
    while b < at and (t[b] in ".-+%" or unicodedata.combining(t[b])):
        b += 1
    m = DOMAIN.match(t, at + 1)
    if not m or b == at or t[at - 1] == "." or ".." in t[b:at]:
        return None
    return "EMAIL", b, m.end()


def _url(t: str, at: int, kind: str, ends: list[int]) -> tuple[str, int, int] | None:
    """ends: where the last run of characters of web addresses ended, and where it did without its last punctuation."""
    b = at
    if kind == "scheme":
        while b and b > at - 8 and t[b - 1].isascii() and (t[b - 1].isalnum() or t[b - 1] in "+.-"):
            b -= 1
        if b == at or t[b:at].lower() not in ("http", "https", "ftp", "ftps", "ws", "wss", "ssh", "git", "s3"):
            return None
        at += 3
    elif b and t[b - 1].isalnum() or t[max(0, b - 3) : b] == "://":
        return None
    if at >= ends[0]:
        m = URL_REST.match(t, at)
        if not m:
            return None
        ends[:] = m.end(), m.end()
        while ends[1] > at and t[ends[1] - 1] in ".,;:!?)]*$%#&":
            ends[1] -= 1
    e = ends[1]
    if e <= at:
        return None
    host = HOST.match(t, at, e).group().rsplit("@", 1)[-1]
    if host[:1] == "[":
        return ("URL", b, e) if _is_ipv6(host[1:].split("]", 1)[0]) else None
    host = host.split(":", 1)[0]
    return ("URL", b, e) if DOMAIN.match(host) or IPV4.fullmatch(host) or host == "localhost" else None


def _is_ipv6(x: str) -> bool:
    try:
        ipaddress.IPv6Address(x)
    except ValueError:
        return False
    return True


def _ipv6(t: str, at: int) -> tuple[tuple[str, int, int] | None, int]:
    """The address around a colon, and where its run ends; a run is looked at once."""
    b = at
    while b and (t[b - 1] == ":" or t[b - 1] in "0123456789abcdefABCDEF"):
        b -= 1
    e = IPV6.match(t, b).end()
    if e - b > 45 or b and (t[b - 1].isalnum() or t[b - 1] in "._") or t[e : e + 1].isalnum() or t[e : e + 1] == "_":
        return None, e
    if t[e - 1] == ":" and t[e - 2] != ":":
        e -= 1
    x = t[b:e]
    groups = [g for g in x.split(":") if g]
    ok = len(groups) > 1 and any(c.isdigit() for c in x) and _is_ipv6(x)
    return (("IP", b, e) if ok else None), e


def _street(t: str, at: int) -> int:
    """Where the address begins whose kind of street follows the space at ``at``, or -1."""
    e = at
    for _ in range(3):
        b = t.rfind(" ", 0, e) + 1
        if not NAME.fullmatch(t, b, e):
            return -1
        e = b - 1
        n = e
        while n > 0 and t[n - 1].isdigit() and e - n < 6:
            n -= 1
        if e > n and NUMBER.fullmatch(t, n, e) and not (n and (t[n - 1].isalnum() or t[n - 1] in "_.")):
            return n
        if e <= 0:
            break
    return -1


def _phone(t: str, at: int) -> tuple[str, int, int] | None:
    m = PHONE.match(t, at)
    e = m.end() if m else at
    while e > at:  # the longest run of whole groups with a valid number of digits
        n = sum(c.isdigit() for c in t[at:e])
        after = t[e : e + 2]
        if n < 8:
            return None
        if n <= (11 if t[at + 1] == "1" else 15) and not (after[:1] == "." and after[1:].isdigit()):
            return "PHONE", at, e
        while e > at and t[e - 1].isdigit():
            e -= 1
        while e > at and not t[e - 1].isdigit() and t[e - 1] != ")":
            e -= 1
    return None


def _numbers(t: str, at: int) -> tuple[list[tuple[str, int, int]], int]:
    """What is in the run of digits around ``at``, and the run's end; a run is looked at once."""
    b = at
    while b and (t[b - 1].isdigit() or t[b - 1] in " -" and b > 1 and t[b - 2].isdigit()):
        b -= 1
    m = DIGITS.match(t, b)
    e = max(m.end() if m else 0, at + 2)
    found = []
    for x in CARD.finditer(t, b, e):
        digits = re.sub(r"\D", "", x.group())
        if luhn(digits) and digits.strip("0") and not (x.start() and t[x.start() - 1].isalnum()) and not t[x.end() : x.end() + 1].isalnum():
            found.append(("CARD", x.start(), x.end()))
    found += [("SSN", x.start(), x.end()) for x in SSN.finditer(t, b, e)]
    s = b - 1 if b and t[b - 1] == "(" else b
    if s < b and s > 1 and t[s - 1] in " .-" and t[s - 2] == "1":
        s -= 2
    elif s < b and s and t[s - 1] == "1":
        s -= 1
    found += [("PHONE", x.start(), x.end()) for x in NATIONAL.finditer(t, s, e + REACH) if x.start() < e]
    x = IBAN.match(t, at - 2) if at > 1 else None  # the run may begin with the check digits of a bank account
    if x:
        value = x.group().replace(" ", "")
        if 15 <= len(value) <= 34 and mod97(value):
            found.append(("ACCOUNT", x.start(), x.end()))
    return found, e


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Findings (kind, begin, end) of a text, in order, not overlapping."""
    t = text
    low = t.lower()
    if len(low) != len(t):  # a few capitals grow when lowered: fold only ASCII then
        low = "".join(c.lower() if c.isascii() else c for c in t)
    found: list[tuple[str, int, int]] = []
    passed = 0  # end of the last run of digits
    colon = 0  # end of the last run of hexadecimal digits and colons
    ends, secret, password, bearer, tail = [0, 0], 0, 0, 0, 0  # of the last runs of other kinds: an anchor inside finds no more than they did
    for end, (kind, n) in automaton.iter(low):
        at = end - n + 1
        hit = None
        if kind == "digits":
            if at >= passed:
                more, passed = _numbers(t, at)
                found += more
        elif kind == "dot":
            b = at
            while b and t[b - 1].isdigit() and at - b < 3:
                b -= 1
            m = IPV4.match(t, b)
            if m and all(int(g) < 256 for g in m.groups()):
                hit = ("IP", b, m.end())
        elif kind == "colon":
            if at >= colon:
                hit, colon = _ipv6(t, at)
        elif kind == "at":
            hit = _email(t, at)
        elif kind in ("scheme", "www"):
            hit = _url(t, at, kind, ends)
        elif kind == "plus":
            hit = _phone(t, at)
        elif kind == "secret":
            if end + 1 >= secret and not (at and t[at - 1].isalpha()) and (m := SECRET.match(t, end + 1)):
                secret = m.end(1)
                if any(c.isdigit() for c in m.group(1)):
                    hit = ("SECRET", m.start(1), m.end(1))
        elif kind == "password":
            if end + 1 >= password and not (at and t[at - 1].isalpha()) and (m := PASSWORD.match(t, end + 1)):
                b, password = m.span(m.lastindex)
                e = password
                while m.lastindex == 3 and e > b and t[e - 1] in ".,;:)]}>":
                    e -= 1
                if m.lastindex < 3 or e - b >= 6:
                    hit = ("SECRET", b, e)
        elif kind == "bearer":
            if end + 1 >= bearer and not (at and t[at - 1].isalpha()) and (m := BEARER.match(t, end + 1)):
                bearer = m.end(1)
                if HEADER.search(t, max(0, at - REACH), at) or len(m.group(1)) >= 16 and any(c.isdigit() for c in m.group(1)):
                    hit = ("SECRET", m.start(1), m.end(1))
        elif kind == "head":
            if end + 1 >= tail and not (at and (t[at - 1].isalnum() or t[at - 1] in "-_")) and (m := SECRET_TAIL.match(t, end + 1)):
                tail = m.end()
                if any(c.isdigit() for c in m.group()):
                    hit = ("SECRET", at, m.end())
        elif not t[end + 1 : end + 2].isalnum():
            if t[at + 1].isupper() and (b := _street(t, at)) >= 0:
                hit = ("ADDRESS", b, end + 1)
        if hit:
            found.append(hit)
    if len(found) < 2:
        return found
    out: list[tuple[str, int, int]] = []
    for hit in sorted(set(found), key=lambda h: (h[1], -h[2], h[0])):
        if not out or hit[1] >= out[-1][2]:
            out.append(hit)
    return out


def redact(text: str, findings: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, b, e in findings:
        parts += [text[at:b], f"<{kind}>"]
        at = e
    return "".join([*parts, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, start, stop, value``: every finding; offsets in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = build()
        for b in text_slices(batches):
            rows = [(d, k, s, e, t[s:e]) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if t for k, s, e in scan(t, a)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "kind", "start", "stop", "value"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, kind string, start long, stop long, value string")


def clean(docs: DataFrame) -> DataFrame:
    """docs with every finding replaced by its kind in angle brackets, and ``n_chars`` to match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = build()
        for b in text_slices(batches):
            texts = b.column("text").to_pylist()
            new = [redact(t, hits) if t and (hits := scan(t, a)) else t for t in texts]
            out = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(new, b.schema.field("text").type))
            i = b.schema.get_field_index("n_chars")
            if i >= 0:
                was = b.column(i).to_pylist()
                lengths = [len(n) if n != t else w for n, t, w in zip(new, texts, was)]
                out = out.set_column(i, b.schema.field(i), pa.array(lengths, b.schema.field(i).type))
            yield out

    return map_rows(docs, run)
