"""Comparison of property values with literals.

One rule for every plan: a missing key, a null (but for null = null), NaN, and values of different kinds compare false
under every operator, != included; integers and floats compare as floats; = and != of floats are within and beyond
an absolute 2.220446049250313e-16; text compares bytewise.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
OPS: dict[str, Callable] = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
Literal = None | bool | int | float | str


def kind_of(value: Literal) -> str:
    """The kind of a literal; bool before int, as Python's bool is an int."""
    if value is None:
        return "null"
    return {bool: "bool", int: "int", float: "float", str: "text"}[type(value)]


def compare_float(left: Column, op: str, right: float) -> Column:
    """Rules for floats; the plain comparisons beside the guards reach the file scan."""
    if math.isnan(right):
        return F.lit(False)
    if op in ("=", "!="):
        if math.isinf(right):
            return F.lit(False) if op == "=" else ~F.isnan(left) & (left != right)
        if op == "=":
            return (left >= right - EPSILON) & (left <= right + EPSILON) & (F.abs(left - right) < EPSILON)
        return ~F.isnan(left) & (F.abs(left - right) >= EPSILON)
    return OPS[op](left, F.lit(right)) & ~F.isnan(left)


def compare_typed(left: Column, kind: str, op: str, value: Literal, filters: bool = False) -> Column:
    """A column of one kind (bool, int, float or text; null where the key is missing) against a literal; never null.

    As a filter, null where false is as good, and the plain comparison reaches the file scan.
    """
    other = kind_of(value)
    if kind == other and kind in ("bool", "int", "text"):
        found = OPS[op](left, F.lit(value))
    elif kind in ("int", "float") and other in ("int", "float"):
        found = compare_float(left.cast("double"), op, float(value))
    else:
        return F.lit(False)
    return found if filters else F.coalesce(found, F.lit(False))


def compare_value(left: Column, op: str, value: Literal) -> Column:
    """A tagged value (null where the key is missing) against a literal; never null."""
    other = kind_of(value)
    tag = left["t"]
    if other == "null":
        found = (tag == "null") if op == "=" else F.lit(False)
    elif other == "bool":
        found = (tag == "bool") & OPS[op](left["b"], F.lit(value))
    elif other == "text":
        found = (tag == "text") & OPS[op](left["s"], F.lit(value))
    elif other == "int":
        found = ((tag == "int") & OPS[op](left["i"], F.lit(value))) | ((tag == "float") & compare_float(left["d"], op, float(value)))
    else:
        number = F.when(tag == "int", left["i"].cast("double")).when(tag == "float", left["d"])
        found = compare_float(number, op, value)
    return F.coalesce(found, F.lit(False))
