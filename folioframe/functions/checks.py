"""Validators of personal numbers, as column expressions over the matched text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.text import digits_of

# Weights of the individual number, left to right.
MY_NUMBER_WEIGHTS = [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]
FREE_PREFIXES = ["070", "080", "090", "050", "0120", "0800"]


def _figures(digits: Column) -> Column:
    return F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)


def my_number_ok(match: Column) -> Column:
    digits = digits_of(match)
    figures = _figures(digits)
    weights = F.array(*[F.lit(w) for w in MY_NUMBER_WEIGHTS])
    rest = _total(F.zip_with(F.slice(figures, 1, 11), weights, lambda a, b: F.coalesce(a * b, F.lit(0)))) % 11
    return (F.length(digits) == 12) & (
        F.try_element_at(figures, F.lit(12)) == F.when(rest <= 1, 0).otherwise(11 - rest))


def luhn_ok(match: Column) -> Column:
    digits = digits_of(match)
    doubled = F.transform(F.reverse(_figures(digits)), lambda d, i: F.when(i % 2 == 0, d).otherwise(
        F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.length(digits).between(13, 16) & (_total(doubled) % 10 == 0)


def phone_ok(match: Column) -> Column:
    digits = digits_of(match)
    size = F.length(digits)
    free = digits.rlike("^(?:" + "|".join(FREE_PREFIXES) + ")")
    return F.when(match.startswith("+81"), size.between(11, 12)).otherwise(
        size.between(10, 11) & (match.rlike(r"[-() ]") | free))
