"""Scalar functions that predicates and canonical forms may use, as Columns.

They keep the semantics that contract authors know: floor modulo, half-even
rounding, Unicode white space, truth by type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(c: Column, kind: str) -> Column:
    """Truth by type: numbers are not zero; texts, arrays and maps are not empty; null is false."""
    if kind == "bool":
        t = c
    elif kind == "number":
        t = c != 0
    elif kind == "string":
        t = F.length(c) > 0
    else:
        t = F.size(c) > 0
    return F.coalesce(t, F.lit(False))


def all_of(a: Column, test) -> Column:
    return F.forall(a, lambda x: F.coalesce(test(x), F.lit(False)))


def any_of(a: Column, test) -> Column:
    return F.exists(a, lambda x: F.coalesce(test(x), F.lit(False)))


def enumerated(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def zipped(a: Column, b: Column) -> Column:
    """Pairs up to the shorter array."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


def counted(stop: Column, start: int = 0) -> Column:
    """start, start + 1, ... below stop."""
    return F.when(stop > start, F.sequence(F.lit(start), (stop - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def rounded(c: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(c, digits)


def modulo(c: Column, divisor: int) -> Column:
    """Floor modulo for a positive divisor."""
    return F.pmod(c, F.lit(divisor))


def has(json: Column, path: str) -> Column:
    return F.variant_get(F.parse_json(json), path, "variant").isNotNull()


def get(json: Column, path: str, kind: str, default) -> Column:
    return F.coalesce(F.try_variant_get(F.parse_json(json), path, kind), F.lit(default))
