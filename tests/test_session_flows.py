"""Session records from one-second slices: live ones and those closed out are the records of the batch plan."""

import pytest
from pyspark.sql import functions as F

from flowloom.plans.flow_plan import flow_features
from flowloom.schemas import PACKETS
from flowloom.streaming.flows import with_event_time
from flowloom.streaming.run import drain
from flowloom.streaming.sessions import close_out_session_flows, second_slices, session_flows
from test_flow_rules import random_packets
from test_streaming import batches_on_disk, keyed


def same(got, want):
    assert got.keys() == want.keys()
    for label, row in want.items():
        for name, value in row.asDict().items():
            mine = got[label][name]
            if isinstance(value, float):
                assert mine == pytest.approx(value, rel=1e-9, abs=1e-6), (name, label)
            else:
                assert mine == value, (name, label)


def table_of(spark, packets):
    return spark.createDataFrame([tuple(p[c] for c in PACKETS.names) for p in packets], PACKETS).withColumn("ts", F.timestamp_micros("ts_us"))


@pytest.mark.parametrize("mode", ["ties", "dense", "sparse", "flood"])
def test_table(spark, mode):
    table = table_of(spark, random_packets(31, 700, mode))
    newest = table.select(F.max("ts_us")).scalar()
    same(keyed(session_flows(table, as_of_us=newest)), keyed(flow_features(table, syn_cut=False)))


def test_stream_and_close_out(spark, tmp_path):
    table = batches_on_disk(spark, random_packets(32, 600, "sparse"), str(tmp_path / "in"), 4, 3_000_000)
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(session_flows(with_event_time(stream)))
    rest = close_out_session_flows(table, out)
    live, late = keyed(out), keyed(rest)
    assert len(live) > 20 and late and not live.keys() & late.keys()
    same(live | late, keyed(flow_features(table, syn_cut=False)))


def test_gaps_at_the_idle_time(spark):
    """Slices 60 seconds apart: one session up to 60 s exactly, two beyond, however Spark's window sees them."""
    start = 1_704_067_200_000_000
    first = random_packets(33, 1, "ties")[0]
    times = [0, 60_000_000, 120_000_001, 180_999_999, 240_000_000, 400_000_000]
    packets = [{**first, "frame_no": i, "ts_us": start + t} for i, t in enumerate(times)]
    got = session_flows(table_of(spark, packets)).select("flow_start_frame", "tot_fwd_pkts").orderBy("flow_start_frame").collect()
    assert [tuple(r) for r in got] == [(0, 2), (2, 1), (3, 2), (5, 1)]


def test_slices_are_bounded_by_time(spark):
    """Copies of a microsecond are counted, not kept: a slice is one row of fixed width."""
    packets = [{**p, "frame_no": i} for i, p in enumerate(random_packets(34, 20, "ties") * 50)]
    slices = second_slices(table_of(spark, packets))
    assert not [c for c, t in slices.dtypes if t.startswith("array")]
    assert slices.agg(F.sum("n")).first()[0] == 1000 and slices.count() <= 8


def test_empty(spark):
    assert session_flows(table_of(spark, [])).count() == 0
