"""Streaming views against the same aggregates over the files at once."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.streaming import views

EVENTS = [(0, "a", 1.0), (30, "b", 2.0), (50, "a", None), (70, "a", 4.0), (130, None, 5.0), (600, "b", 6.0)]


@pytest.fixture()
def folder(tmp_path):
    """Three files of two events each."""
    where = tmp_path / "events"
    where.mkdir()
    for i in range(3):
        minutes, kinds, values = zip(*EVENTS[2 * i : 2 * i + 2])
        ts = pa.array([m * 60_000_000 for m in minutes], pa.timestamp("us"))
        pq.write_table(pa.table({"ts": ts, "event_type": pa.array(kinds, pa.string()), "value": pa.array(values, pa.float64())}), where / f"{i}.parquet")
    return str(where)


def test_totals(spark, folder, tmp_path):
    views.run_to_table(views.totals(views.events_stream(spark, folder)), "stream_totals", str(tmp_path / "at"))
    found = {tuple(r) for r in spark.table("stream_totals").collect()}
    assert found == {("a", 3, 5.0), ("b", 2, 8.0), (None, 1, 5.0)}


def test_hourly(spark, folder, tmp_path):
    """In append mode an hour is given out only once it is closed; the last one stays open."""
    views.run_to_table(views.hourly(views.events_stream(spark, folder)), "stream_hourly", str(tmp_path / "at"), "append")
    hour = F.unix_seconds("window.start") / 3600
    found = {tuple(r) for r in spark.table("stream_hourly").select(hour.cast("int"), "event_type", "n").collect()}
    assert found == {(0, "a", 2), (0, "b", 1), (1, "a", 1), (2, None, 1)}
