"""Chunks of hot keys are small, consecutive and complete."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.operators.hotkeys import split_hot_keys
from flowloom.plans.flow_plan import DST_KEY
from flowloom.sources.tables import packets_from_lineitem


@pytest.mark.parametrize("squash", ["ts_us", "ts_us div 200000000 * 200000000", "1704067200000000"])
def test_chunks(spark, sf_small, squash):
    packets = packets_from_lineitem(spark, sf_small).withColumn("ts_us", F.expr(squash))
    split = split_hot_keys(packets, DST_KEY, chunk_rows=100)
    assert split.hot is not None
    assert split.cold.count() + split.hot.count() == packets.count()
    sizes = split.hot.groupBy(*DST_KEY, "chunk").agg(
        F.count("*").alias("n"), F.min(F.struct("ts_us", "frame_no")).alias("lo"), F.max(F.struct("ts_us", "frame_no")).alias("hi"))
    # a chunk may exceed the target by one slice, which itself is at most the target
    assert sizes.agg(F.max("n")).first()[0] <= 200
    assert sizes.count() == split.n_chunks
    w = Window.partitionBy(*DST_KEY).orderBy("chunk")
    overlaps = sizes.withColumn("before", F.lag("hi").over(w)).filter("before >= lo")
    assert overlaps.count() == 0


def test_usual_keys_are_not_split(spark, sf_small):
    assert split_hot_keys(packets_from_lineitem(spark, sf_small), DST_KEY).hot is None


def test_small_chunks_share_tasks(spark, sf_small):
    """Tasks follow the packets: thousands of chunks are no thousands of tasks and files."""
    split = split_hot_keys(packets_from_lineitem(spark, sf_small), DST_KEY, chunk_rows=20)
    assert split.n_chunks > 200 and split.n_tasks <= max(spark.sparkContext.defaultParallelism, 1)


def test_default_chunks_fit_a_core(spark):
    """A window partition is held by each of the stacked windows: a key of 700,000 packets is not one partition."""
    packets = spark.range(700_000).selectExpr(
        "1704067200000000 + id * 1000 as ts_us", "id as frame_no", "0L as capture_no", "1L as dst_ip_int", "80 as dst_port", "6 as protocol",
        "if(id % 4 = 0, 2, 16) as tcp_flags")
    split = split_hot_keys(packets, DST_KEY)
    sizes = [row["count"] for row in split.hot.groupBy("chunk").count().collect()]
    assert sum(sizes) == 700_000 and max(sizes) <= 300_000
