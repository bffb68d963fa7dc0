"""Expressions over arrays of neighbours: intersections, filters and counts without expansion.

Arrays are sets in ascending order, as neighbour lists are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(arrays: list[Column]) -> Column:
    """What all arrays have, shortest first, so that the larger one is hashed once and the smaller one walked."""
    if len(arrays) == 2:
        a, b = arrays
        return F.when(F.size(a) <= F.size(b), F.array_intersect(a, b)).otherwise(F.array_intersect(b, a))
    by_size = F.array_sort(F.array(*arrays), lambda x, y: F.size(x) - F.size(y))
    return F.aggregate(by_size, F.lit(None).cast("array<bigint>"), lambda out, x: F.when(out.isNull(), x).otherwise(F.array_intersect(out, x)))


def kept(array: Column, conditions: list[tuple[str, Column]]) -> Column:
    """The elements x for which x op value holds for every (op, value)."""
    if not conditions:
        return array
    return F.filter(array, lambda x: reduce(lambda a, b: a & b, (holds(x, op, v) for op, v in conditions)))


def holds(x: Column, op: str, y: Column) -> Column:
    """op is '<', '>' or '<>', or '%k' for ids with equal remainders by k."""
    if op[0] == "%":
        return F.pmod(x, F.lit(int(op[1:]))) == F.pmod(y, F.lit(int(op[1:])))
    return x < y if op == "<" else x > y if op == ">" else x != y


def length(array: Column) -> Column:
    """As bigint, before anything is multiplied."""
    return F.size(array).cast("long")


def pairs(a: Column, b: Column, op: str) -> Column:
    """How many pairs (x of a, y of b) have x op y.

    Unequal pairs follow from sizes. For an order both arrays are sorted into one, in which each y counts the x before it; for
    equal arrays it is n (n - 1) / 2. Elements are below 2^62.
    """
    if op == "<>":
        return length(a) * length(b) - length(F.array_intersect(a, b))
    if op == ">":
        a, b = b, a
    n = length(a)
    # an odd number is an x; a y comes before the x that equals it
    both = F.array_sort(F.concat(F.transform(a, lambda x: 2 * x + 1), F.transform(b, lambda y: 2 * y)))
    none = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("sum"))
    step = lambda s, m: F.struct((s["seen"] + F.abs(m % 2)).alias("seen"), (s["sum"] + F.when(m % 2 == 0, s["seen"]).otherwise(0)).alias("sum"))
    return F.when(a == b, n * (n - 1) / 2).otherwise(F.aggregate(both, none, step, lambda s: s["sum"])).cast("long")


def triples(a: Column, b: Column, c: Column) -> Column:
    """How many (x of a, y of b, z of c) are all different, by inclusion and exclusion over what the arrays share."""
    ab, ac, bc = F.array_intersect(a, b), F.array_intersect(a, c), F.array_intersect(b, c)
    n = length
    return n(a) * n(b) * n(c) - n(ab) * n(c) - n(ac) * n(b) - n(bc) * n(a) + 2 * n(F.array_intersect(ab, c))
