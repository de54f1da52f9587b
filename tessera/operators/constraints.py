"""Constraints as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    broken = F.lit(False)
    for c in columns:
        broken |= F.col(c).isNull()
    return df.filter(broken)


def check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; null passes."""
    return df.filter(~condition)


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with n. A key with a null never clashes."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def foreign_key(df: DataFrame, key: list[str], parent: DataFrame, parent_key: list[str]) -> DataFrame:
    """Rows whose key has no null and no parent."""
    keys = parent.select(*[F.col(p).alias(k) for k, p in zip(key, parent_key, strict=True)])
    return df.dropna(subset=key).join(keys, key, "left_anti")
