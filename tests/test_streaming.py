"""Streams give the same rows however their table is cut into files."""

import pytest
from pyspark.sql import functions as F

from rivulet.plans import catalog


@pytest.fixture(scope="module")
def many_files(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("many"))
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(200, F.xxhash64("event_id")).write.parquet(f"{path}/events.parquet")
    assert len(spark.read.parquet(f"{path}/events.parquet").inputFiles()) > 150
    return path


@pytest.mark.parametrize("name", ["t5_stream_segments", "t6_stream_sessions", "t3_stream_reorder"])
def test_one_file_or_many(spark, sf_dir, many_files, name):
    rows = lambda path: sorted(map(tuple, catalog.QUERIES[name](spark, path).collect()))
    want = rows(sf_dir)
    assert want and rows(many_files) == want


@pytest.mark.parametrize("name, place", [("t3_stream_reorder", lambda n: n ^ 1), ("t3_reorder_by_delay", lambda n: n)])
def test_reordering_goes_by_arrival_over_wraps(spark, sf_dir, tmp_path, name, place):
    """Numbers that wrap seven times, in files that are in no order: packets come in order of event_id all the same."""
    numbers = [5000 * k for k in range(100)]
    e = spark.createDataFrame([(16 * n + p, p) for n in numbers for p in (0, 7)], "event_id long, user_id long")
    e = e.withColumn("ts", F.timestamp_micros(F.col("event_id") * 1_000_000)).withColumns({"event_type": F.lit("view"), "value": F.lit(1.0), "props": F.lit("x")})
    e = e.select(*spark.read.parquet(f"{sf_dir}/events.parquet").columns)
    e.repartition(20, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted((p, place(n) % 65536, place(n)) for n in numbers for p in (0, 7))


def test_waiting_numbers_may_span_more_than_half_a_turn(spark, tmp_path):
    """What waits behind a gap is counted on from the highest number so far, not from the one that is due."""
    from rivulet.streaming import operators as streaming

    numbers = [0, *range(2, 120_000, 5000)]
    rows = spark.createDataFrame([(1, n % 65536, i) for i, n in enumerate(numbers)], "pid long, seq long, i long")
    rows.select("pid", "seq", F.timestamp_micros("i").alias("ts")).write.parquet(f"{tmp_path}/p.parquet")
    got = streaming.drain_reordered(streaming.read(spark, f"{tmp_path}/p.parquet"), 1 << 30, "span", 86_400_000)
    assert [(r["place"], r["ts"].microsecond) for r in got.orderBy("place").collect()] == [(n, i) for i, n in enumerate(numbers)]
