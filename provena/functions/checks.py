"""Check digits (I12, I13) and patterns of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
PHONE = r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}\b"
ACCOUNT = r"\b[0-9]{4}[ ]?[0-9]{4}[ ]?[0-9]{11}[ ]?[0-9]{2}\b"
CARD = r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _digits(x: Column) -> Column:
    return F.transform(F.split(x, ""), lambda c: c.cast("int"))


def luhn_ok(x: Column | str) -> Column:
    """Whether the digits pass the Luhn check; anything but digits fails."""
    x = _col(x)
    digits = F.reverse(_digits(x))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.when(x.rlike("^[0-9]+$"), F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0).otherwise(F.lit(False))


def mod97(x: Column | str) -> Column:
    """The remainder by 97 of a text of digits and capital letters (A=10 ... Z=35), of any length."""
    letters = F.transform(F.split(_col(x), ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(letters, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))


def iban_ok(x: Column | str) -> Column:
    """Whether a text (blanks ignored) is an IBAN whose check digits are right."""
    x = F.upper(F.regexp_replace(_col(x), r"\s+", ""))
    moved = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
    return F.when(x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), mod97(moved) == 1).otherwise(F.lit(False))


def weighted_tax_id_ok(x: Column | str, weights: tuple[int, ...] = (9, 8, 7, 6, 5, 4, 3, 2)) -> Column:
    """A nine-digit tax number whose last digit is 11 - (weighted sum % 11), or 0 from 10 on."""
    x = _col(x)
    d = _digits(x)
    total = sum((d[i] * w for i, w in enumerate(weights)), F.lit(0))
    check = F.when(11 - total % 11 >= 10, 0).otherwise(11 - total % 11)
    return F.when(x.rlike("^[0-9]{9}$"), check == d[len(weights)]).otherwise(F.lit(False))


def count_matches(x: Column | str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(_col(x), F.lit(pattern)), F.lit(0)).cast("bigint")


def count_cards(x: Column | str) -> Column:
    """Sixteen-digit groups that pass the Luhn check."""
    found = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(f"({CARD})"), 1)
    plain = F.transform(found, lambda f: F.regexp_replace(f, "[^0-9]", ""))
    return F.size(F.filter(plain, luhn_ok)).cast("bigint")
