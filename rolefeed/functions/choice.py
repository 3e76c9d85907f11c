"""Small expression helpers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(cases: Iterable[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first condition that holds, as one flat CASE."""
    (condition, value), *rest = cases
    chain = functools.reduce(lambda c, case: c.when(*case), rest, F.when(condition, value))
    return chain if default is None else chain.otherwise(default)


def holds(value: Column, test: Callable[[Column], Column]) -> Column:
    """``test(value)`` with ``value`` evaluated once, however often the test uses it. In a filter
    Spark would repeat it for every use."""
    return F.exists(F.array(value), test)


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """Any of the words is a substring; false for no words. Stops at the first hit."""
    return holds(lowered, lambda text: functools.reduce(
        Column.__or__, (text.contains(word) for word in words), F.lit(False)
    ))
