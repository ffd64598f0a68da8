"""Checksums and shapes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import VERHOEFF_PERMUTATION


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _places(number: Column) -> Column:
    """The digits from the right, with their place from 0."""
    reverse = F.split(F.reverse(number), "")
    return F.transform(F.filter(reverse, lambda c: c != ""), lambda c, i: F.struct(F.try_to_number(c, F.lit("9")).cast("int").alias("d"), i.alias("i")))


def luhn_sum(number: Column) -> Column:
    """Luhn's sum modulo 10 of a string of digits."""

    def worth(p: Column) -> Column:
        twice = p["d"] * 2
        return F.when(p["i"] % 2 == 0, p["d"]).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(_places(number), F.lit(0), lambda a, p: a + worth(p)) % 10


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits that are not all alike, of a card scheme's first digits, with a valid check digit."""
    n = digits(value)
    shape = F.length(n).between(13, 19) & ~n.rlike(r"^(\d)\1*$") & n.rlike("^(?:[2-6]|1800)")
    return F.when(shape, luhn_sum(n) == 0).otherwise(False)


def _dihedral() -> list[list[int]]:
    """Multiplication in the dihedral group of order 10: 0-4 rotations, 5-9 reflections."""
    out = []
    for a in range(10):
        row = []
        for b in range(10):
            turn = a % 5 + b % 5 if a < 5 else a % 5 - b % 5
            row.append(turn % 5 + 5 * ((a >= 5) != (b >= 5)))
        out.append(row)
    return out


def _permutations() -> list[list[int]]:
    """Powers of Verhoeff's permutation for the places 0 to 7."""
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([VERHOEFF_PERMUTATION[d] for d in rows[-1]])
    return rows


def verhoeff_ok(value: Column) -> Column:
    """The check digit by the dihedral group is right."""
    product = F.lit([x for row in _dihedral() for x in row])
    moved = F.lit([x for row in _permutations() for x in row])

    def step(c: Column, p: Column) -> Column:
        return F.element_at(product, c * 10 + F.element_at(moved, (p["i"] % 8) * 10 + p["d"] + 1) + 1)

    return F.aggregate(_places(digits(value)), F.lit(0), step) == 0


def aadhaar_ok(value: Column) -> Column:
    n = digits(value)
    return F.when(n.rlike(r"^[2-9]\d{11}$"), verhoeff_ok(n)).otherwise(False)


def phone_ok(value: Column) -> Column:
    return F.length(digits(value)).between(8, 15)


def verhoeff_digit(number: str) -> int:
    """The digit that makes a number valid when it is added at the end."""
    product, moved, c = _dihedral(), _permutations(), 0
    for i, d in enumerate(reversed(number), 1):
        c = product[c][moved[i % 8][int(d)]]
    return next(d for d in range(10) if product[c][d] == 0)
