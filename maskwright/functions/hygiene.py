"""Text hygiene: invisible characters, non-breaking and repeated spaces, with counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width space, non-joiner, joiner, word joiner, byte order mark, soft hyphen.
INVISIBLE = "​‌‍⁠﻿­"
NBSP = "  "


def clean(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, NBSP + INVISIBLE, "  "), " {2,}", " ")


def counts(text: Column) -> dict[str, Column]:
    """What clean() removes, replaces and how many runs it collapses."""
    size = lambda c: F.length(c).cast("bigint")
    spaced = F.translate(text, NBSP + INVISIBLE, "  ")
    return {
        "invisible_chars_removed": size(text) - size(F.translate(text, INVISIBLE, "")),
        "non_breaking_spaces_fixed": size(text) - size(F.translate(text, NBSP, "")),
        "repeated_spaces_collapsed": F.regexp_count(spaced, F.lit(" {2,}")).cast("bigint"),
    }


def norm(token: Column) -> Column:
    """A token for look-ups: without points at its ends, lower-cased."""
    return F.lower(F.trim(token, F.lit(".")))


def is_roman(token: Column) -> Column:
    return token.rlike("^[ivxlc]{1,4}$")


def mostly_caps(text: Column) -> Column:
    """More than seven in ten letters are upper case."""
    letters = F.length(F.regexp_replace(text, r"(?U)[\W\d_]", ""))
    return (letters > 0) & (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) > 0.7 * letters)


def for_entities(text: Column) -> Column:
    """The text as an entity model reads it best: a line mostly in capitals is put in title case, if that keeps its length."""
    letter = lambda c: c.rlike(r"(?U)^\p{L}$")
    chars = F.split(text, "")
    titled = F.array_join(F.transform(chars, lambda c, i: F.when((i > 0) & letter(F.get(chars, i - 1)), F.lower(c)).otherwise(F.upper(c))), "")
    return F.when(mostly_caps(text) & (F.length(titled) == F.length(text)), titled).otherwise(text)


def keep_case(like: Column, word: Column) -> Column:
    """The word in the case of another: upper (of two characters or more), lower, or as it is."""
    up = (F.upper(like) == like) & (F.lower(like) != like)
    return F.when(up & (F.length(like) > 1), F.upper(word)).when((F.lower(like) == like) & (F.upper(like) != like), F.lower(word)).otherwise(word)
