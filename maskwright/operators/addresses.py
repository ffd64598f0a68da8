"""Addresses: an anchor (PIN or ZIP) widened to the left up to a boundary and to the right by state and country."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import spans as S

PRIORITY = 50
_J = S.FLAGS


def _around(text: Column, kind: str, anchor: Column) -> Column:
    """A struct of the address about an anchor: start, end and whether it is one."""
    # what lies between the last boundary in the window (or its begin) and the anchor, without its leading marks
    head = F.regexp_replace(S.before(text, anchor, X.ADDRESS_LOOKBACK), f"{_J}(?s)^.*{X.ADDRESS_BOUNDARY}", "")
    return S.let(F.ltrim(head, F.lit(X.ADDRESS_LEAD)), lambda chunk: _judged(text, kind, anchor, chunk))


def _judged(text: Column, kind: str, anchor: Column, chunk: Column) -> Column:
    start = anchor["start"] - F.length(chunk)
    tail = F.length(F.regexp_extract(F.substring(text, anchor["end"] + 1, F.length(text)), f"{_J}(?i)^{X.ADDRESS_TAIL}", 0))
    good = F.regexp_count(chunk, F.lit("[A-Za-z]{3,}")) >= 2
    if kind != "us":
        city = F.regexp_extract(F.substring(text, F.lit(1), anchor["start"]), rf"{_J}([A-Za-z]{{3,}})\s*[\-–—,]?\s*$", 1)
        good = good & (city != "") & ~((F.upper(city) == city) & (F.length(city) < 4))
    good = good & chunk.rlike(f"{_J}[,\\d]")
    if kind == "bare":
        good = good & chunk.contains(",")
    return F.struct(start.alias("start"), (anchor["end"] + tail).alias("end"), good.alias("good"))


def address_spans(text: Column) -> Column:
    """A whole line that is a state; else the addresses about PINs, ZIPs and bare PINs after a city."""
    found = []
    for kind, pattern, needs in (("pin", X.PIN, r"\d{3} ?\d{3}"), ("us", X.US_ZIP, r", [A-Z]{2} \d{5}"), ("bare", X.PIN_BARE, r"[A-Za-z]{3} \d{6}")):
        anchors = S.matches(text, pattern, guard=text.rlike(needs))
        around = F.transform(anchors, partial(_around, text, kind))
        found.append(S.label(F.filter(around, lambda a: a["good"]), "ADDRESS", PRIORITY))
    white = F.length(F.regexp_extract(text, rf"{_J}^\s*", 0))
    end = F.length(F.rtrim(text, F.lit(" .;")))
    line = F.array(F.struct(white.alias("start"), end.alias("end"), F.lit("ADDRESS").alias("label"), F.lit(PRIORITY).alias("priority")))
    return F.when(text.rlike(f"{_J}(?i){X.STATE_LINE}"), line).otherwise(F.concat(*found)).cast(S.SPAN)
