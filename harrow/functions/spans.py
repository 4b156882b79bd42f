"""Places of matches in a text, and what stands around them (JVM side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_SPANS = "array<struct<start:int,end:int>>"


def spans(t: Column, pattern: str) -> Column:
    """struct(start, end) of each match of a pattern that matches no empty text, in order: characters from 0, end
    exclusive. Matches don't overlap. The parts between matches and the matches themselves give their lengths, whose
    running sums are the places. Null gives null."""
    between, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["b"])
        end = start + F.length(part["m"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def walk(p: Column) -> Column:
        parts = F.zip_with(p["between"], p["found"], lambda b, m: F.struct(b.alias("b"), m.alias("m")))
        return F.aggregate(F.filter(parts, lambda x: x["m"].isNotNull()), begin, step, lambda s: s["out"])

    return F.when(t.isNotNull(), let(F.struct(between.alias("between"), found.alias("found")), walk))


def before(t: Column, span: Column, breaks: str) -> Column:
    """What stands before a span, from the last break on."""
    return F.element_at(F.split(F.substring(t, F.lit(1), span["start"]), breaks, -1), -1)


def behind(t: Column, span: Column, breaks: str) -> Column:
    """What stands behind a span, up to the next break."""
    return F.get(F.split(F.substring(t, span["end"] + 1, F.length(t)), breaks, -1), 0)


def kept(t: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """The spans of a pattern for which wanted(span) holds."""
    return F.filter(spans(t, pattern), wanted)
