"""Check digits and entropy as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _at(text: Column, place: Column) -> Column:
    return F.substring(text, place, F.lit(1))


def _places(first: int, last: int) -> Column:
    return F.sequence(F.lit(first), F.lit(last))


def _rank(char: Column) -> Column:
    """0 to 35 for 0-9 and A-Z."""
    return F.position(char, F.lit(fixed.ALPHABET)) - 1


def fiscal_code_valid(code: Column) -> Column:
    """16 letters and digits, the last one the check letter of the others."""
    up = F.upper(code)
    odd = F.array(*map(F.lit, fixed.FISCAL_ODD))
    total = F.aggregate(
        _places(1, 15),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.element_at(odd, _rank(_at(up, i)) + 1)).otherwise(
            F.when(_rank(_at(up, i)) < 10, _rank(_at(up, i))).otherwise(_rank(_at(up, i)) - 10)
        ),
    )
    return F.when(up.rlike("^[A-Z0-9]{16}$"), F.char(total % 26 + 65) == _at(up, F.lit(16))).otherwise(False)


def _doubled(digit: Column) -> Column:
    return F.when(digit * 2 > 9, digit * 2 - 9).otherwise(digit * 2)


def vat_valid(code: Column) -> Column:
    """11 digits, the last one the check digit."""
    total = F.aggregate(_places(1, 10), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, _doubled(_at(code, i).cast("int"))).otherwise(_at(code, i).cast("int")))
    return F.when(code.rlike("^[0-9]{11}$"), (10 - total % 10) % 10 == _at(code, F.lit(11)).cast("int")).otherwise(False)


def iban_valid(code: Column) -> Column:
    """Country, check digits and 10 to 30 characters; 1 modulo 97."""
    bare = F.upper(F.regexp_replace(code, "\\s+", ""))
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))),
        F.lit(0),
        lambda acc, i: (acc * F.when(_rank(_at(moved, i)) > 9, 100).otherwise(10) + _rank(_at(moved, i))) % 97,
    )
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), rest == 1).otherwise(False)


def luhn_valid(number: Column) -> Column:
    """12 to 19 digits, whatever stands between them, that pass the Luhn check."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a byte, of a text as Latin-1 bytes or ASCII; 0 for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    kinds = F.array_sort(F.array_distinct(chars))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(n > 0, F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))
