"""Four-valued logic: none, true, false and both as codes 0 to 3 (bit 0: evidence for, bit 1: evidence against)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE, TRUE, FALSE, BOTH = 0, 1, 2, 3
NAMES = ("none", "true", "false", "both")


def negate(a: int) -> int:
    return (a >> 1) | (a & 1) << 1


def k_join(a: int, b: int) -> int:
    return a | b


def k_meet(a: int, b: int) -> int:
    return a & b


def t_join(a: int, b: int) -> int:
    return ((a | b) & 1) | (a & b & 2)


def t_meet(a: int, b: int) -> int:
    return (a & b & 1) | ((a | b) & 2)


def below_k(a: int, b: int) -> bool:
    """a carries no more information than b."""
    return a & b == a


def below_t(a: int, b: int) -> bool:
    """a is no truer than b."""
    return (a & 1) <= (b & 1) and (a & 2) >= (b & 2)


def k_monotone(fn: Callable[..., int], arity: int) -> bool:
    """Whether more information in never means less out, over all values."""
    points = list(product(range(4), repeat=arity))
    return all(below_k(fn(*x), fn(*y)) for x in points for y in points if all(map(below_k, x, y)))


# ---------------------------------------------------------------- Columns


def of(for_: Column, against: Column) -> Column:
    """Code from two booleans; null evidence is no evidence."""
    yes, no = F.coalesce(for_, F.lit(False)).cast("int"), F.coalesce(against, F.lit(False)).cast("int")
    return (yes + no * 2).cast("int")


def col_negate(a: Column) -> Column:
    return F.shiftright(a, 1).bitwiseOR(F.shiftleft(a.bitwiseAND(F.lit(1)), 1))


def col_k_join(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def col_k_meet(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def col_t_join(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b).bitwiseAND(F.lit(1)).bitwiseOR(a.bitwiseAND(b).bitwiseAND(F.lit(2)))


def col_t_meet(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b).bitwiseAND(F.lit(1)).bitwiseOR(a.bitwiseOR(b).bitwiseAND(F.lit(2)))


def name_of(a: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), a.cast("int") + 1)


def agg_k_join(a: Column) -> Column:
    return F.coalesce(F.bit_or(a), F.lit(NONE))


def agg_k_meet(a: Column) -> Column:
    return F.coalesce(F.bit_and(a), F.lit(BOTH))


def agg_t_join(a: Column) -> Column:
    """Nothing at all is false."""
    return F.coalesce(F.bit_or(a).bitwiseAND(F.lit(1)).bitwiseOR(F.bit_and(a).bitwiseAND(F.lit(2))), F.lit(FALSE))


def agg_t_meet(a: Column) -> Column:
    """Nothing at all is true."""
    return F.coalesce(F.bit_and(a).bitwiseAND(F.lit(1)).bitwiseOR(F.bit_or(a).bitwiseAND(F.lit(2))), F.lit(TRUE))


def fold(fn: Callable[[int, int], int], values: Iterable[int], start: int) -> int:
    for v in values:
        start = fn(start, v)
    return start
