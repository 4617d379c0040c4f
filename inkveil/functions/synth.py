"""Identifiers made from a key by hashes: valid by their rules, the same for the same seed and key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import gstin_check, verhoeff_digit

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _draw(seed: int, key: Column, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(salt)), F.lit(n))


def _digits(seed: int, key: Column, salt: str, n: int) -> Column:
    return F.lpad(_draw(seed, key, salt, 10**n).cast("string"), n, "0")


def _letters(seed: int, key: Column, salt: str, n: int, of: str = LETTERS) -> Column:
    return F.concat(*(F.substr(F.lit(of), _draw(seed, key, f"{salt}{i}", len(of)).cast("int") + 1, F.lit(1)) for i in range(n)))


def aadhaar(key: Column, seed: int = 42) -> Column:
    first = F.concat((_draw(seed, key, "a0", 8) + 2).cast("string"), _digits(seed, key, "a", 10))
    whole = F.concat(first, verhoeff_digit(first).cast("string"))
    return F.regexp_replace(whole, r"^(.{4})(.{4})(.{4})$", "$1 $2 $3")


def pan(key: Column, seed: int = 42) -> Column:
    return F.concat(_letters(seed, key, "p", 3), F.lit("P"), _letters(seed, key, "q", 1), _digits(seed, key, "p", 4), _letters(seed, key, "r", 1))


def gstin(key: Column, seed: int = 42) -> Column:
    first = F.concat(F.lpad((_draw(seed, key, "g", 37) + 1).cast("string"), 2, "0"), F.regexp_replace(pan(key, seed), "^(.{10}).*", "$1"), F.lit("1Z"))
    return F.concat(first, gstin_check(first))


def ifsc(key: Column, seed: int = 42) -> Column:
    return F.concat(_letters(seed, key, "i", 4), F.lit("0"), _digits(seed, key, "i", 6))


def phone(key: Column, seed: int = 42) -> Column:
    a, b = F.concat((_draw(seed, key, "t", 4) + 6).cast("string"), _digits(seed, key, "t1", 4)), _digits(seed, key, "t2", 5)
    style = _draw(seed, key, "style", 4)
    return F.when(style == 0, F.concat(a, b)).when(style == 1, F.concat(a, F.lit(" "), b)).when(style == 2, F.concat(F.lit("+91 "), a, F.lit(" "), b)).otherwise(F.concat(F.lit("+91-"), a, b))


def upi(key: Column, seed: int = 42) -> Column:
    return F.concat(F.lower(_letters(seed, key, "u", 6)), F.lit("@ok"), F.lower(_letters(seed, key, "v", 4)))


def email(key: Column, seed: int = 42) -> Column:
    return F.concat(F.lower(_letters(seed, key, "e", 7)), _digits(seed, key, "e", 2), F.lit("@example.com"))


def voter_id(key: Column, seed: int = 42) -> Column:
    return F.concat(_letters(seed, key, "w", 3), _digits(seed, key, "w", 7))


def passport(key: Column, seed: int = 42) -> Column:
    return F.concat(_letters(seed, key, "s", 1, "ABCDEFGHIJKLMNOPRSTUVWYZ"), (_draw(seed, key, "s1", 9) + 1).cast("string"), _digits(seed, key, "s2", 6))


def vehicle(key: Column, seed: int = 42) -> Column:
    return F.concat(_letters(seed, key, "c", 2), F.lit(" "), _digits(seed, key, "c", 2), F.lit(" "), _letters(seed, key, "d", 2), F.lit(" "), _digits(seed, key, "d", 4))


def uan(key: Column, seed: int = 42) -> Column:
    return F.concat(F.lit("10"), _digits(seed, key, "n", 10))


def abha(key: Column, seed: int = 42) -> Column:
    return F.concat_ws("-", _digits(seed, key, "b1", 2), *(_digits(seed, key, f"b{i}", 4) for i in (2, 3, 4)))


MAKERS = {"AADHAAR": aadhaar, "PAN": pan, "GSTIN": gstin, "IFSC": ifsc, "PHONE": phone, "UPI_ID": upi, "EMAIL": email, "VOTER_ID": voter_id, "PASSPORT": passport, "VEHICLE_REG": vehicle, "UAN": uan, "ABHA": abha}
