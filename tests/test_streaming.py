"""Batch result = streaming result on the same data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from loanlens.plans.stream_queries import TB

from .conftest import SF


def test_stream_band_counts_equal_batch(spark):
    q = E.queries()
    stream = {r["band"]: r["borrowers"] for r in q["stream_band_counts"](spark, SF).collect()}
    batch = {r["band"]: r["borrowers"] for r in q["band_distribution"](spark, SF).collect() if r["borrowers"]}
    assert stream == batch


def test_stream_dedup_drops_only_redeliveries(spark):
    q = E.queries()
    out = q["stream_dedup"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert out.count() == events.count() == out.select("event_id").distinct().count()


def test_stream_event_windows_equal_batch(spark):
    q = E.queries()
    stream = {(r["day"], r["event_type"]): r["n"] for r in q["stream_event_windows"](spark, SF).collect()}
    ev = spark.read.parquet(f"{SF}/events.parquet")
    batch = {(r["day"], r["event_type"]): r["n"]
             for r in ev.groupBy(F.to_date("ts").alias("day"), "event_type").count().withColumnRenamed("count", "n").collect()}
    assert stream == batch


@pytest.fixture
def many_files(spark, monkeypatch):
    """Events as 24 parts without order in time, some without a time: each slice of a stream is 24 files."""
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # one task a file
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    ev = ev.withColumn("ts", F.when(F.crc32(F.col("event_id").cast("string")) % 50 > 0, F.col("ts")))
    ev = ev.repartition(24, "event_id").cache()
    monkeypatch.setattr(TB, "read_table", lambda *_: ev)
    yield ev
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stream_event_windows_of_many_files_keep_every_row(spark, many_files):
    ev = many_files
    out = E.queries()["stream_event_windows"](spark, SF).collect()
    batch = ev.groupBy(F.to_date("ts").alias("day"), "event_type").count().collect()
    assert any(r["day"] is None for r in batch)
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, (tuple(r) for r in batch)))


def test_stream_dedup_of_many_files_keeps_every_event(spark, many_files):
    ev = many_files
    out = E.queries()["stream_dedup"](spark, SF)
    assert out.count() == ev.count() and out.exceptAll(ev).isEmpty()
