"""Small Column builders shared by the function modules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0."""
    return F.when(condition, 1).otherwise(0)


def one() -> Column:
    """A bigint 1: the input of running counts."""
    return F.lit(1).cast("bigint")


def contains_any(text: Column, patterns: list[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in patterns])


def lookup(key: Column, mapping: dict, default: Column | None = None) -> Column:
    """Value of a small fixed mapping; ``default`` where the key is absent."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def one_hot(col: Column, values: list[str], prefix: str) -> list[Column]:
    """One 0/1 column ``prefix_value`` per value, in order."""
    return [flag(col == v).alias(f"{prefix}_{v}") for v in values]
