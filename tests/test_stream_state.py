"""State of a live flow stream: what it costs, runs again, restarts and closes."""

import os

import pytest
from pyspark.sql import functions as F

from flowloom.operators.orient import bidirectional_features
from flowloom.plans.flow_plan import flow_features
from flowloom.schemas import FLOW_NAMES, PACKETS
from flowloom.session import durable, scratch
from flowloom.streaming.assemble import FlowAssembler
from test_flow_rules import random_packets
from test_streaming import keyed

SECOND = 1_000_000


def table(spark, packets):
    return spark.createDataFrame([tuple(p[c] for c in PACKETS.names) for p in packets], PACKETS)


def files_under(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_")))


def steady(spark, n):
    """Batch ``n`` of a stream: a second of packets to a few of many destinations, and one that never pauses; or nothing."""
    rows = [] if n % 3 == 2 else [(n * 100 + k, 10**15 + n * SECOND + k * 40_000, 1, 1000 + (n * 7 + k) % 40 if k else 7, 1, 80, 6, 40, k, 16, True) for k in range(20)]
    return spark.createDataFrame(rows, PACKETS)


def test_files_stay_constant(spark, tmp_path):
    live = FlowAssembler(spark, str(tmp_path / "state"), str(tmp_path / "out"), 2 * SECOND, idle_us=3 * SECOND, buckets=4)
    with scratch(spark) as folder:
        counts = []
        for n in range(20):
            live(steady(spark, n), n)
            counts.append(len(files_under(tmp_path / "state")))
        assert max(counts[12:]) <= max(counts[4:12])
        assert not files_under(folder)  # nothing left of the batches' own tables
    out = live.emitted().count()
    rest = live.close_out().count()
    want = flow_features(steady(spark, 0).limit(0).unionByName(spark.createDataFrame(
        [r for n in range(20) for r in steady(spark, n).collect()], PACKETS)), idle_us=3 * SECOND).count()
    assert out > 0 and rest > 0 and out + rest == want
    assert len(files_under(tmp_path / "state")) <= 4


def test_scope_keeps_what_is_outside(spark):
    outer = durable(spark.range(3))
    with scratch(spark) as folder:
        inner = durable(spark.range(5))
        with scratch(spark):
            deeper = durable(inner)
            assert deeper.count() == 5
        assert inner.count() == 5
    assert outer.count() == 3 and not os.path.exists(folder)


def batches(packets, n):
    rows = sorted(packets, key=lambda p: (p["ts_us"], p["frame_no"]))
    size = -(-len(rows) // n)
    return [rows[i * size:(i + 1) * size] for i in range(n)]


def test_batch_run_again_restart_and_close(spark, tmp_path):
    packets = random_packets(8, 500, "sparse")
    parts = [table(spark, p) for p in batches(packets, 4)]
    make = lambda: FlowAssembler(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    live = make()
    for n in range(2):
        live(parts[n], n)
    before = keyed(live.emitted())
    again = make()  # died after the batch, before the stream had noted it
    assert again.last_batch() == 1
    again(parts[1], 1)
    assert keyed(again.emitted()) == before
    again(parts[2], 2)
    with pytest.raises(RuntimeError, match="ahead"):
        again(parts[1], 1)

    third = make()
    closed = keyed(third.close_out())
    assert keyed(make().close_out()) == closed and third.closed_after() == 2  # once, by whomever
    third(parts[2], 2)  # run again after the close: out already
    live(parts[2], 2)  # by a run that knows nothing of it
    upto = flow_features(table(spark, [p for b in batches(packets, 4)[:3] for p in b]))
    got = third.emitted(closed_out=True)
    assert got.count() == upto.count() and keyed(got).keys() == keyed(upto).keys()

    fourth = make()  # started again: new flows from the rest of the packets
    fourth(parts[3], 3)
    fourth.close_out()
    rest = flow_features(parts[3])
    assert fourth.emitted(closed_out=True).count() == upto.count() + rest.count()
    assert keyed(fourth.emitted(closed_out=True)).keys() == keyed(upto).keys() | keyed(rest).keys()


def test_no_state_and_other_buckets(spark, tmp_path):
    live = FlowAssembler(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    assert live.last_batch() == -1 and live.late_packets() is None
    with pytest.raises(RuntimeError, match="no batch"):
        live.close_out()
    with pytest.raises(RuntimeError, match="no state"):
        live(steady(spark, 0), 3)
    live(steady(spark, 0).limit(0), 0)
    assert live.emitted().count() == 0 and live.close_out().count() == 0
    with pytest.raises(ValueError, match="buckets"):
        FlowAssembler(spark, live.state, live.target, buckets=3)(steady(spark, 1), 1)


@pytest.mark.parametrize("chunk_rows", [None, 40])
def test_two_way_stream_equals_batch(spark, tmp_path, chunk_rows):
    """Ties and both directions; the side that opens a flow is often not the lower one."""
    packets = random_packets(12, 400, "sparse")
    rows = table(spark, packets).withColumns({
        "dst_ip_int": F.when(F.col("is_fwd"), F.lit(9)).otherwise(F.lit(3)).cast("bigint"), "src_ip_int": F.when(F.col("is_fwd"), F.lit(3)).otherwise(F.lit(9)).cast("bigint"),
        "src_port": F.when(F.col("is_fwd"), F.col("dst_port")).otherwise(F.lit(7)).cast("int"),
        "dst_port": F.when(F.col("is_fwd"), F.lit(7)).otherwise(F.col("dst_port")).cast("int")}).drop("is_fwd")
    rows = durable(rows)
    live = FlowAssembler(spark, str(tmp_path / "state"), str(tmp_path / "out"), chunk_rows=chunk_rows, two_way=True)
    edges = [None, *[b[-1]["ts_us"] for b in batches(packets, 3)]]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        live(rows.filter((F.col("ts_us") <= high) & (F.lit(True) if low is None else F.col("ts_us") > low)), n)
    live.close_out()
    names = [*FLOW_NAMES, "flow_start_us", "flow_start_frame", "flow_end_us", "end_reason", "sf_count"]
    order = lambda df: sorted(df.select(*names).collect(), key=lambda r: (r.flow_id, r.flow_start_us))
    got, want = order(live.emitted(closed_out=True)), order(bidirectional_features(rows))
    assert len(got) == len(want) > 5
    for a, b in zip(got, want):
        assert all(
            x == pytest.approx(y, rel=1e-9, abs=1e-6) if isinstance(y, float) else x == y for x, y in zip(a, b))
