"""Weighted change sets (weight -1 or +1 for each row) and views kept by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "_weight"


def consolidate(delta: DataFrame) -> DataFrame:
    """One row for each distinct row with its summed weight; what cancels out goes."""
    rows = [c for c in delta.columns if c != WEIGHT]
    return delta.groupBy(*rows).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)


def apply(table: DataFrame, delta: DataFrame) -> DataFrame:
    """The table after the changes, as a multiset."""
    both = consolidate(table.withColumn(WEIGHT, F.lit(1)).unionByName(delta)).filter(F.col(WEIGHT) > 0)
    return both.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(WEIGHT).cast("int")))).drop("_i", WEIGHT)


def filter_delta(delta: DataFrame, where: Column) -> DataFrame:
    """Changes of a filtered view: those of the rows that pass."""
    return delta.filter(where)


def project_delta(delta: DataFrame, *columns: Column) -> DataFrame:
    """Changes of a projected view; rows that become alike add up."""
    return consolidate(delta.select(*columns, WEIGHT))


def union_delta(*deltas: DataFrame) -> DataFrame:
    """Changes of a UNION ALL of views."""
    return consolidate(reduce(DataFrame.unionByName, deltas))


def join_delta(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: list[str]) -> DataFrame:
    """Changes of an inner join: dL x R, L x dR and dL x dR, with weights multiplied. Null keys never match."""
    one = lambda df: df.withColumn(WEIGHT, F.lit(1)) if WEIGHT not in df.columns else df

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        b = one(b).withColumnRenamed(WEIGHT, "_other")
        return one(a).join(b, on).withColumn(WEIGHT, F.col(WEIGHT) * F.col("_other")).drop("_other")

    return consolidate(product(d_left, right).unionByName(product(left, d_right)).unionByName(product(d_left, d_right)))


def aggregate_delta(state: DataFrame, delta: DataFrame, key: list[str], value: Column) -> DataFrame:
    """COUNT and SUM per key after the changes; state has the key, n and total. A key without rows goes."""
    change = delta.groupBy(*key).agg(F.sum(WEIGHT).alias("n"), F.sum(F.col(WEIGHT) * value).alias("total"))
    return state.unionByName(change).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")
