"""Subtitle documents as columns: a text becomes ``array<struct<start, end, text>>``, times in seconds.

Line ends are normalised first, so files with carriage returns parse like others.  A block or line
that isn't a cue is passed over; a document without cues gives an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CUES = "array<struct<start: double, end: double, text: string>>"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it; within a lambda Spark shares nothing."""
    return F.get(F.transform(F.array(value), f), 0)


def lines_of(text: Column) -> Column:
    """With plain line ends and without a byte order mark."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def seconds(stamp: Column) -> Column:
    """``[[h:]m:]s`` with a point or comma; null where it doesn't parse."""

    def value(parts: Column) -> Column:
        return F.when(F.size(parts).between(2, 3), F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + F.trim(p).try_cast("double")))

    return once(F.split(F.replace(F.trim(stamp), F.lit(","), F.lit(".")), ":"), value)


def strip_tags(text: Column) -> Column:
    """Without ``<...>``; an unclosed one swallows the rest."""
    return F.regexp_replace(text, "<[^>]*(>|$)", "")


def strip_overrides(text: Column) -> Column:
    """Without ``{...}``, with line breaks and hard spaces made plain."""
    t = F.regexp_replace(text, r"\{[^}]*(\}|$)", "")
    t = F.replace(F.replace(t, F.lit(r"\N"), F.lit("\n")), F.lit(r"\n"), F.lit("\n"))
    return F.trim(F.replace(t, F.lit(r"\h"), F.lit(" ")))


def _cue(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))


def _whole(cues: Column) -> Column:
    ok = F.filter(cues, lambda c: c["start"].isNotNull() & c["end"].isNotNull() & (F.length(F.trim(c["text"])) > 0))
    return F.coalesce(ok, F.expr(f"cast(array() as {CUES})"))


def _block(block: Column, tags: bool) -> Column:
    """One cue of a block whose timing line is the first with an arrow."""

    def found(x: Column) -> Column:
        lines, at = x["lines"], x["at"]
        rest = F.array_join(F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1))), "\n")
        text = F.trim(strip_tags(rest) if tags else rest)
        stop = lambda t: F.get(F.split(F.trim(F.split_part(t, F.lit("-->"), F.lit(2))), r"\s+"), 0)
        return F.when(at > 0, once(F.get(lines, at - 1), lambda t: _cue(seconds(F.split_part(t, F.lit("-->"), F.lit(1))), seconds(stop(t)), text)))

    place = lambda lines: F.coalesce(F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), True), F.lit(0)).cast("int")
    return once(once(F.split(F.trim(block), "\n"), lambda lines: F.struct(lines.alias("lines"), place(lines).alias("at"))), found)


def parse_srt(text: Column) -> Column:
    blocks = F.split(lines_of(text), "\n[ \t]*\n")
    return _whole(F.filter(F.transform(blocks, lambda b: _block(b, False)), lambda c: c.isNotNull()))


def parse_vtt(text: Column) -> Column:
    """Cue settings and tags are dropped; blocks without a timing line (headers, notes) give nothing."""
    blocks = F.split(lines_of(text), "\n[ \t]*\n")
    return _whole(F.filter(F.transform(blocks, lambda b: _block(b, True)), lambda c: c.isNotNull()))


DEFAULT_FORMAT = "layer,start,end,style,name,marginl,marginr,marginv,effect,text"


def parse_ass(text: Column) -> Column:
    """Dialogue lines by the document's last usable format line, or the usual ten fields."""
    low = lambda x, head: F.startswith(F.lower(x), F.lit(head))

    def names(lines: Column) -> Column:
        formats = F.transform(F.filter(lines, lambda x: low(x, "format:")), lambda x: F.split(F.regexp_replace(F.lower(F.substring(x, 8, 1 << 20)), r"\s+", ""), ","))
        usable = F.filter(formats, lambda f: F.array_contains(f, "start") & F.array_contains(f, "end") & F.array_contains(f, "text"))
        return F.element_at(F.concat(F.array(F.split(F.lit(DEFAULT_FORMAT), ",")), usable), -1)

    def places(lines: Column) -> Column:
        """The lines, and each field's place, found once for the document and not for each line."""
        return once(names(lines), lambda n: F.struct(lines.alias("lines"), *[F.array_position(n, k).cast("int").alias(k) for k in ("start", "end", "text")]))

    def cue(line: Column, at: Column) -> Column:
        field = lambda fields, name: F.get(fields, at[name] - 1)
        return once(F.split(F.trim(F.substring(line, 10, 1 << 20)), ",", at["text"]), lambda x: F.when(F.size(x) == at["text"], _cue(seconds(field(x, "start")), seconds(field(x, "end")), strip_overrides(field(x, "text")))))

    found = once(once(F.transform(F.split(lines_of(text), "\n"), F.trim), places), lambda d: F.transform(F.filter(d["lines"], lambda x: low(x, "dialogue:")), lambda x: cue(x, d)))
    return _whole(F.filter(found, lambda c: c.isNotNull()))


def parse(text: Column) -> Column:
    """By what the document looks like: its first 64 characters, or a dialogue line anywhere."""
    t = F.regexp_replace(text, "^﻿", "")
    head = F.lower(F.substring(F.ltrim(t), 1, 64))
    ass = F.contains(head, F.lit("[script info]")) | F.contains(head, F.lit("[events]")) | F.regexp_like(t, F.lit("(?im)^\\s*dialogue:"))
    return F.when(F.startswith(head, F.lit("webvtt")), parse_vtt(t)).when(ass, parse_ass(t)).otherwise(parse_srt(t))
