"""Metadata filter trees as Column predicates, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, functions as F

COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def filter_expr(tree: tuple) -> Column:
    """Build a predicate from `("and"|"or", t1, t2, ...)`, `("not", t)`, `("in", column, values)`
    or `(comparison, column, value)`; unknown operators are rejected."""
    op = tree[0].lower()
    if op in ("and", "or"):
        result = filter_expr(tree[1])
        for branch in tree[2:]:
            result = result & filter_expr(branch) if op == "and" else result | filter_expr(branch)
        return result
    if op == "not":
        return ~filter_expr(tree[1])
    column = F.col(tree[1])
    if op == "in":
        values: Iterable[Any] = tree[2]
        return column.isin(list(values))
    if op not in COMPARE:
        raise ValueError(f"unknown filter operator: {tree[0]}")
    return COMPARE[op](column, F.lit(tree[2]))
