"""Fix points, row changes and change capture as DataFrame compositions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; cached where the session names no such folder, as in a shell."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.cache()
    path = f"{folder.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000, fold: int = 16) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows that `step` makes of new rows, until no row is new.

    Each round's new rows are written to the shared folder once, which cuts the
    lineage; only rows that no round had before go into the next one. Every
    `fold` rounds the tables so far become one, so that plans stay small.
    """
    new = written(seed.distinct())
    parts = [new]
    for turn in range(rounds):
        seen = reduce(DataFrame.union, parts)
        made = step(new).distinct()
        same = [made[c].eqNullSafe(seen[c]) for c in seen.columns]
        new = written(made.join(seen, same, "left_anti"))
        if new.isEmpty():
            return seen
        parts = [written(seen), new] if turn % fold == fold - 1 else [*parts, new]
    raise RuntimeError(f"no fix point after {rounds} rounds")


def one_per_key(rows: DataFrame, key: list[str], order: Column | None = None, last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) by `order`, or any where none is given. Rows with a null in the key all stay."""
    rest = [c for c in rows.columns if c not in key]
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in key])
    if not rest:
        return rows.filter(whole).distinct().unionByName(rows.filter(~whole))
    found = F.struct(*rest)
    pick = F.first(found) if order is None else (F.max_by if last else F.min_by)(found, order)
    return rows.filter(whole).groupBy(*key).agg(pick.alias("_row")).select(*key, "_row.*").select(*rows.columns).unionByName(rows.filter(~whole))


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """New rows whose key isn't there yet; of several new rows with one key the first by `order`. A null key never conflicts."""
    return target.unionByName(one_per_key(rows, key, order).join(target, key, "left_anti"))


def insert_or_replace(target: DataFrame, rows: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """New rows take the place of those with their key; of several new rows with one key the last by `order` stays."""
    return target.join(rows, key, "left_anti").unionByName(one_per_key(rows, key, order, last=True))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], update: dict[str, Callable[[Column, Column], Column]], order: Column | None = None) -> DataFrame:
    """ON CONFLICT(key) DO UPDATE: update maps a column to an expression of its old and its `excluded` value.

    Of several new rows with one key the last by `order` counts.
    """
    new = one_per_key(rows, key, order, last=True).select(*key, *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c not in key], F.lit(True).alias("_new"))
    old = target.withColumn("_old", F.lit(True))
    both = old.join(new, key, "full")

    def value(c: str) -> Column:
        excluded = F.col(f"_new_{c}")
        changed = update[c](F.col(c), excluded) if c in update else F.col(c)
        return F.when(F.col("_old").isNull(), excluded).when(F.col("_new").isNull(), F.col(c)).otherwise(changed).alias(c)

    return both.select(*[F.col(c) if c in key else value(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, key: list[str], changes: dict[str, Column], order: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: rows with a match take the changes, which may read the source's columns.

    A target row is changed once: of several matches the first by `order` counts.
    """
    both = target.join(one_per_key(source, key, order).withColumn("_hit", F.lit(True)), key, "left")
    return both.select(*[F.when(F.col("_hit"), changes[c]).otherwise(target[c]).alias(c) if c in changes else target[c] if c not in key else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is true go; those where it is null stay."""
    return target.filter(~F.coalesce(where, F.lit(False)))


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Change rows between two snapshots, whose keys may be null: the key, change (-1 delete, 0 update, 1 insert), and both images as JSON."""
    rest = [c for c in before.columns if c not in key]
    a = before.select(F.struct(*key).alias("_key"), F.struct(*rest).alias("_a"))
    b = after.select(F.struct(*key).alias("_other"), F.struct(*rest).alias("_b"))
    both = a.join(b, F.col("_key").eqNullSafe(F.col("_other")), "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    both = both.select(F.coalesce("_key", "_other").alias("_key"), "_a", "_b").select("_key.*", "_a", "_b")
    kind = F.when(F.col("_a").isNull(), 1).when(F.col("_b").isNull(), -1).otherwise(0)
    return both.select(*key, kind.alias("change"), F.to_json("_a").alias("before"), F.to_json("_b").alias("after"))


def left_to_right(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """A chain of set operations with equal precedence."""
    out = first
    for kind, df in rest:
        out = {"union": lambda a, b: a.union(b).distinct(), "union all": DataFrame.union, "intersect": DataFrame.intersect, "except": lambda a, b: a.subtract(b)}[kind](out, df)
    return out
