"""Check digits as folds over characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _dihedral(a: int, b: int) -> int:
    """The product in the dihedral group of order 10."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def _powers() -> str:
    """Rows 0 to 7 of the position permutation, from its first row."""
    first = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    row, out = list(range(10)), []
    for _ in range(8):
        out += row
        row = [first[x] for x in row]
    return "".join(map(str, out))


_D = "".join(str(_dihedral(a, b)) for a in range(10) for b in range(10))
_P = _powers()
_INVERSE = "".join(str(next(b for b in range(10) if _dihedral(a, b) == 0)) for a in range(10))


def _at(table: str, i: Column) -> Column:
    return F.substr(F.lit(table), i + 1, F.lit(1)).cast("int")


def _verhoeff(digits: Column, shift: int) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _at(_P, ((i + shift) % 8) * 10 + d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda c, p: _at(_D, c * 10 + p))


def verhoeff_valid(text: Column) -> Column:
    """Whether digits (spaces and dashes aside) end in their Verhoeff digit; other characters or none: false."""
    d = F.regexp_replace(text, "[ -]", "")
    return F.when(d.rlike("^[0-9]+$"), _verhoeff(d, 0) == 0).otherwise(False)


def verhoeff_digit(digits: Column) -> Column:
    return _at(_INVERSE, _verhoeff(digits, 1))


def gstin_check(first14: Column) -> Column:
    """The check character of the first 14 characters: base 36, weights 1 and 2, digit sums."""
    def value(c, i):
        p = (F.position(c, F.lit(_ALPHABET)) - 1) * (i % 2 + 1)
        return F.floor(p / 36).cast("int") + p % 36

    values = F.transform(F.split(first14, ""), value)
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return F.substr(F.lit(_ALPHABET), (36 - total % 36) % 36 + 1, F.lit(1))
