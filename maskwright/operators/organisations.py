"""Organisations by legal suffix or head noun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import spans as S

PRIORITY = 40
_J = S.FLAGS


def _clipped(text: Column, span: Column) -> Column:
    """The span without leading words that don't belong to the name."""

    def clip(name: Column) -> Column:
        def start(words: Column) -> Column:
            plain = lambda w: F.lower(F.trim(F.trim(S.part(name, w), F.lit("()&,")), F.lit(".")))
            kept = F.filter(words, lambda w: ~plain(w).isin(*X.TRIM))
            # the first word that belongs to a name, at the latest the last word
            return F.coalesce(F.try_element_at(kept, F.lit(1)), F.try_element_at(words, F.lit(-1)))["start"]

        return S.let(S.matches(name, r"\S+"), start)

    begin = S.let(S.part(text, span), clip)
    return F.when(begin.isNotNull(), F.struct((span["start"] + begin).cast("int").alias("start"), span["end"].alias("end")))


def organisation_spans(text: Column) -> Column:
    """Names with a legal suffix, a head noun, or "Bank of ...", but for public bodies; "X Limited and Y Limited" are two."""
    whole = S.matches(text, X.ORG, guard=text.rlike(f"{_J}(?i){X.LEGAL}|{X.HEAD}"))

    def cut(span: Column) -> Column:
        name = S.part(text, span)
        lead = F.regexp_extract(name, rf"{_J}(?s)^(.*?{X.ORG_CONJUNCTION})", 1)
        link = F.length(F.regexp_extract(name, rf"{_J}(?s)^.*?{X.ORG_CONJUNCTION}", 1))
        at = span["start"] + F.length(lead)
        two = F.array(F.struct(span["start"].alias("start"), (at - link).alias("end")), F.struct(at.alias("start"), span["end"].alias("end")))
        return F.when(lead != "", two).otherwise(F.array(span))

    names = F.transform(F.flatten(F.transform(whole, cut)), lambda s: _clipped(text, s))
    real = lambda s: (F.regexp_count(F.trim(S.part(text, s)), F.lit(r"(?U)\S+")) >= 2) & ~S.part(text, s).rlike(f"{_J}(?i){X.PUBLIC_BODIES}")
    return S.label(F.filter(names, lambda s: s.isNotNull() & real(s)), "ORG", PRIORITY)
