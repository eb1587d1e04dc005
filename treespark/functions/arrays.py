"""Array helpers that Spark's built-ins leave to the user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column | int) -> Column:
    """1..n as an array, empty for n < 1 (``sequence(1, 0)`` would count down)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def item(values: Column, position: Column) -> Column:
    """The 1-based element, null outside the array."""
    return F.get(values, position - 1)


def running_sum(values: Column, kind: str = "int") -> Column:
    """Sums of the prefixes, starting with 0: one element more than ``values``."""
    return F.aggregate(
        values,
        F.array(F.lit(0).cast(kind)),
        lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)),
    )


def padded(values: Column, length: Column, pad: Column) -> Column:
    """``values`` filled up with ``pad`` to ``length``."""
    return F.concat(values, F.array_repeat(pad, F.greatest(length - F.size(values), F.lit(0))))


def smallest(values: Column, key: Callable[[Column], Column], count: int) -> Column:
    """The ``count`` elements with the smallest keys, in key order."""
    keyed = F.sort_array(F.transform(values, lambda x: F.struct(key(x).alias("k"), x.alias("v"))))
    return F.transform(F.slice(keyed, 1, count), lambda s: s["v"])


def exploded(values: Column) -> Column:
    """``explode`` of a computed array column.

    The slice keeps the optimizer from inferring a filter on the bare column, which it would push
    below the projection and so compute the array several times.
    """
    return F.explode(F.slice(values, 1, F.size(values)))


def posexploded(values: Column) -> Column:
    """``posexplode`` with the same guard; positions start at 0."""
    return F.posexplode(F.slice(values, 1, F.size(values)))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once per row.

    The one-row generator is a barrier: the optimizer neither inlines the expressions into later lambdas
    nor repeats them in pushed-down filters, as it does with the columns of a plain projection.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
