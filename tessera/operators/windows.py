"""Window frames that Spark's own syntax lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[str], before: int, after: int, aggregates: dict[str, Callable[[], Column]]) -> DataFrame:
    """Aggregates over `before` peer groups before to `after` behind the current one (GROUPS frame).

    dense_rank() numbers the peer groups; a RANGE frame over that number is the
    GROUPS frame. Both windows have the same partitioning, so one shuffle serves.
    """
    number = F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))
    frame = Window.partitionBy(*partition).orderBy("_group").rangeBetween(-before, after)
    df = df.withColumn("_group", number)
    return df.withColumns({name: make().over(frame) for name, make in aggregates.items()}).drop("_group")


def excluding_sum(df: DataFrame, value: str, partition: list[str], order: list[str], unique: list[str], rows: tuple[int, int], exclude: str, into: str) -> DataFrame:
    """sum(value) over a ROWS frame with EXCLUDE `current row`, `group` or `ties`.

    The frame's total less what is excluded: peers within the frame are counted
    by a second frame over the peer group, cut to the rows that the first frame
    reaches. Nothing is gathered, so a wide frame costs no memory. An empty
    frame gives null. `unique` pins the order of peers.
    """
    low, high = rows
    spec = Window.partitionBy(*partition).orderBy(*order, *unique)
    peers = Window.partitionBy(*partition, *order).orderBy(*unique).rowsBetween(low, high)
    total, count = F.sum(value).over(spec.rowsBetween(low, high)), F.count(value).over(spec.rowsBetween(low, high))
    here = low <= 0 <= high
    own, one = (F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("int")) if here else (F.lit(0), F.lit(0))
    peer_sum, peer_count = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    gone, n = {"current row": (own, one), "group": (peer_sum, peer_count), "ties": (peer_sum - own, peer_count - one)}[exclude]
    return df.withColumn(into, F.when(count - n > 0, total - gone))


def filtered(aggregate: Callable[[Column], Column], value: Column, where: Column) -> Column:
    """An aggregate of the rows that meet a condition, for use over a window (FILTER)."""
    return aggregate(F.when(where, value))
