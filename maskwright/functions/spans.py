"""Spans as columns: all matches of a regex with their offsets, and overlap resolution.

Spark has no function for all matches with offsets. Matches are fenced with two control characters by one
regexp_replace, the text is split at the opening one, and a fold adds up the pieces' lengths. Offsets are
0-based code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, PLACEHOLDER = "\u0001", "\u0002", "��"
#: Unicode classes, and a line ends with \n alone.
FLAGS = "(?U)(?d)"
RANGE = "array<struct<start:int,end:int>>"
SPAN = "array<struct<start:int,end:int,label:string,priority:int>>"


def fenceable(text: Column) -> Column:
    """The text with the two control characters replaced, one for one."""
    return F.translate(text, OPEN + CLOSE, PLACEHOLDER)


def let(value: Column, use) -> Column:
    """use(value), with the value written and computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Pieces that are folded at a time where there may be many: a fold copies what it has found at every step.
_RUN = 64


def matches(text: Column, body: str, before: str = "", guard: Column | None = None, many: bool = False, after: str = "", doubled: bool = False, flags: str = FLAGS) -> Column:
    """All matches: ranges of what ``body`` matches right after ``before`` and right before ``after``, which are both part of a match.

    guard: a condition that any text with a match fulfils. many: for bodies with hundreds of matches in a text.
    doubled: each white space counts twice, so it can end one match and begin the next; for bodies without any.
    """
    searched = F.regexp_replace(text, r"([\t\n\f\r ])", "$1$1") if doubled else text
    fenced = F.regexp_replace(searched, flags + f"({before})({body})" + (f"({after})" if after else ""), f"$1{OPEN}$2{CLOSE}" + ("$3" if after else ""))
    fenced = F.regexp_replace(fenced, r"([\t\n\f\r ])[\t\n\f\r ]", "$1") if doubled else fenced

    def step(past: Column, piece: Column) -> Column:
        size = F.length(F.substring_index(piece, CLOSE, 1))
        one = F.struct(past["at"].alias("start"), (past["at"] + size).alias("end"))
        first = F.struct(F.length(piece).alias("at"), past["found"].alias("found"))
        return F.when(past["at"] < 0, first).otherwise(F.struct((past["at"] + F.length(piece) - 1).alias("at"), F.concat(past["found"], F.array(one)).alias("found")))

    def fold(pieces: Column, at: Column) -> Column:
        return F.aggregate(pieces, F.struct(at.alias("at"), F.array().cast(RANGE).alias("found")), step, lambda past: past["found"])

    def in_runs(pieces: Column) -> Column:
        run = lambda k: F.slice(pieces, k * _RUN + 1, F.lit(_RUN))
        runs = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _RUN).cast("int"))
        # without the closing marks; the first piece of all has none
        sizes = F.transform(runs, lambda k: F.aggregate(run(k), F.when(k == 0, 1).otherwise(0), lambda a, p: a + F.length(p) - 1))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return let(begins, lambda b: F.flatten(F.transform(runs, lambda k: fold(run(k), F.when(k == 0, -1).otherwise(F.element_at(b, k + 1))))))

    pieces = F.split(fenced, OPEN, -1)
    found = let(pieces, in_runs) if many else fold(pieces, F.lit(-1))
    none = F.array().cast(RANGE)
    return F.when(text.isNull() | (text == ""), none).otherwise(found if guard is None else F.when(guard, found).otherwise(none))


def part(text: Column, span: Column) -> Column:
    """The text of a range."""
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def before(text: Column, span: Column, n: int) -> Column:
    """At most n characters left of a range."""
    return F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - n), F.least(span["start"], F.lit(n)))


def label(ranges: Column, name: str, priority: int) -> Column:
    return F.transform(ranges, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("label"), F.lit(priority).alias("priority")))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(spans: Column) -> Column:
    """Of overlapping spans the one of higher priority, then the longer, then the left one; in order of start."""

    def compare(a: Column, b: Column) -> Column:
        longer = (b["end"] - b["start"]) - (a["end"] - a["start"])
        return F.when(a["priority"] != b["priority"], b["priority"] - a["priority"]).when(longer != 0, longer).otherwise(a["start"] - b["start"])

    def step(kept: Column, s: Column) -> Column:
        return F.when(F.exists(kept, lambda k: overlap(k, s)), kept).otherwise(F.concat(kept, F.array(s)))

    greedy = lambda all_: F.array_sort(F.aggregate(F.array_sort(all_, compare), F.array().cast(SPAN), step))
    return let(spans, lambda s: F.when(F.size(s) < 2, s).otherwise(greedy(s)))
