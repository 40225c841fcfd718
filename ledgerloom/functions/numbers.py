"""Amounts: rounding, parsing and formatting (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, f) -> Column:
    """``f(x)``, with x worked out once however often f uses it. (A column that an expression names twice is worked out twice within
    branches, and code that grows with it is too long to be compiled.)"""
    return F.element_at(F.transform(F.array(x), f), 1)


def whole_number(digits: Column) -> Column:
    """Digits as int; null if there are none (casting an empty text throws and catches, ten times the work)."""
    return bound(digits, lambda x: F.when(x != "", x.try_cast("int")))


def round2(x: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor(x * 100 + 0.5) / 100


def parse_number(text: Column) -> Column:
    """Money as people write it, as double; null if it is no number.

    Letters, ``$`` and white space go; parentheses and a minus at either end negate. With both
    separators the last is the decimal point; commas alone are one unless there are several
    groups of three; dots alone that part groups of three are thousands.
    """
    return bound(F.regexp_replace(text, r"[\s\u00a0A-Za-z$]", ""), _number)


def _number(s: Column) -> Column:
    shape = s.rlike(r"^(\(-?[\d.,]+-?\)|-?[\d.,]+-?)$")
    signs = F.length(s) - F.length(F.translate(s, "(-", ""))  # an opening bracket and each minus turn the sign

    def read(p: Column) -> Column:
        parts, marks = p["parts"], p["marks"]
        last, n = F.right(marks, F.lit(1)), F.length(marks)
        same = n - F.length(F.replace(marks, last, F.lit("")))  # how often the last separator occurs
        head = F.slice(parts, 1, F.size(parts) - 1)
        triples = F.length(parts[0]).between(1, 3) & F.forall(F.slice(parts, 2, F.size(parts)), lambda x: F.length(x) == 3)
        thousands = (same == n) & triples & ((last == ".") | (n > 1))
        whole = F.when((n == 0) | thousands, F.array_join(parts, "")).when(same == 1, F.concat(F.array_join(head, ""), F.lit("."), F.element_at(parts, -1)))
        return F.when((n == 0) | (F.element_at(parts, -1) != ""), whole.try_cast("double"))

    body = F.regexp_replace(s, "[()-]", "")
    cut = F.struct(F.split(body, "[.,]").alias("parts"), F.regexp_replace(body, r"\d", "").alias("marks"))
    return bound(bound(F.when(shape, cut), read), lambda value: F.when(F.pmod(signs, F.lit(2)) == 1, -value).otherwise(value))


def format_money(x: Column) -> Column:
    """1.234,50: dots part thousands, two decimals after a comma; null gives an empty text."""
    return F.coalesce(F.translate(F.format_number(x, 2), ",.", ".,"), F.lit(""))
