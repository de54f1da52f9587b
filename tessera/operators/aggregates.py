"""Aggregates with the reference semantics where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """A sum that is always a double, 0.0 over no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def array_agg(x: Column) -> Column:
    """An array that keeps nulls; null over no rows."""
    kept = F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"])
    return F.when(F.count(F.lit(1)) > 0, kept)


def group_concat(x: Column, by: Column, sep: str = ",") -> Column:
    """Non-null values joined in the order of `by`; null if there are none."""
    parts = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(by.alias("o"), x.cast("string").alias("v")))))
    return F.when(F.count(x) > 0, F.array_join(F.transform(parts, lambda s: s["v"]), sep))


def percentile_floor(x: Column, p: float) -> Column:
    """The element at floor(p * (n - 1)) of the sorted values."""
    # percentile() interpolates between neighbours, so it is exact at a whole position
    n = F.count(x)
    at = F.floor((n - 1) * F.lit(p)) + 1
    return F.get(F.sort_array(F.collect_list(x)), (at - 1).cast("int"))
