"""Small combinators over array columns.

They keep per-document work inside one row: nothing here shuffles, and each
combinator is linear in the array it reads.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

R = TypeVar("R")


def remembered(build: Callable[..., R]) -> Callable[..., R]:
    """Build an expression once per JVM and reuse it in every plan.

    Columns are immutable, but each call that makes one is a round trip to the
    JVM, and a deep expression takes thousands of them.
    """
    cache: dict = {}

    @functools.wraps(build)
    def wrapper(*args, **kwargs):
        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = build(*args, **kwargs)
        return cache[key]

    return wrapper


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often it is used.

    A lambda variable is never inlined by the optimizer, so an array that a
    lambda reads by position is not rebuilt for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(items: Column, starts: Callable[[Column], Column]) -> Column:
    """Split an array in front of every element for which ``starts`` holds.

    Gives ``array<struct<head, body, stop, last>>``: the splitting element (null
    for the piece before the first one), the elements up to the next split, the
    element that ends the piece, and whether the piece runs to the end.
    """

    def pieces(items: Column, marks: Column) -> Column:
        return F.transform(
            marks,
            lambda at, k: bind(
                F.coalesce(F.get(marks, k + 1), F.size(items)),
                lambda end: F.struct(
                    F.get(items, at).alias("head"),
                    F.slice(items, at + 2, end - at - 1).alias("body"),
                    F.get(items, end).alias("stop"),
                    F.get(marks, k + 1).isNull().alias("last"),
                ),
            ),
        )

    def positions(items: Column) -> Column:
        marked = F.transform(items, lambda x, i: F.when(starts(x), i))
        return F.concat(F.array(F.lit(-1)), F.filter(marked, lambda i: i.isNotNull()))

    return bind(items, lambda xs: bind(positions(xs), lambda marks: pieces(xs, marks)))

