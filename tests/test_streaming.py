import random

import pytest
from pyspark.sql import functions as F

from flowloom.plans.flow_plan import flow_features
from flowloom.schemas import FLOW_NAMES, FLOW_TYPES, PACKETS
from flowloom.streaming.assemble import FlowAssembler, run_flow_stream
from flowloom.streaming.flows import close_out, rate_windows, stream_flows_keyed, stream_sessions, with_event_time
from flowloom.streaming.run import drain
from test_flow_rules import random_packets


def batches_on_disk(spark, packets, path, n_files, jitter_us):
    """Packets in files by shuffled arrival: order is wrong by less than ``jitter_us``."""
    rng = random.Random(3)
    rows = sorted(packets, key=lambda p: p["ts_us"] + rng.randrange(jitter_us))
    size = -(-len(rows) // n_files)
    for i in range(n_files):
        part = [tuple(p[c] for c in PACKETS.names) for p in rows[i * size:(i + 1) * size]]
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame([tuple(p[c] for c in PACKETS.names) for p in packets], PACKETS)


def keyed(df):
    names = FLOW_NAMES + ["flow_start_us", "flow_start_frame", "flow_end_us", "end_reason", "sf_count"]
    rows = df.select(*names).collect()
    return {(r.dst_ip, r.dst_port, r.protocol, r.flow_start_us, r.flow_start_frame): r for r in rows}


@pytest.mark.parametrize("mode, jitter_us, delay", [("sparse", 3_000_000, "10 seconds"), ("flood", 400_000, "500 milliseconds")])
def test_stream_and_close_out_equal_batch(spark, tmp_path, mode, jitter_us, delay):
    packets = random_packets(21, 600, mode)
    table = batches_on_disk(spark, packets, str(tmp_path / "in"), 4, jitter_us)
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closed = drain(stream_flows_keyed(with_event_time(stream, delay)), str(tmp_path / "out"), str(tmp_path / "state"))
    want = flow_features(table)
    rest = close_out(table, closed)
    got, expected = keyed(closed.unionByName(rest)), keyed(want)
    assert got.keys() == expected.keys()
    for k, row in expected.items():
        for name in FLOW_NAMES:
            if FLOW_TYPES[name] == "double":
                assert got[k][name] == pytest.approx(row[name], rel=1e-9, abs=1e-6), name
            else:
                assert got[k][name] == row[name], name
    # the stream itself closed whatever was cut or idle well before the end
    reasons = {r.end_reason for r in closed.select("end_reason").distinct().collect()}
    assert reasons <= {"[SYN-FLOOD]", "[Timeout]"} and closed.count() > 0
    early = want.filter("end_reason = '[Timeout]'").filter(
        F.col("flow_end_us") < max(p["ts_us"] for p in packets) - 75_000_000)
    assert early.count() <= closed.count()


def test_sessions_and_rates_equal_batch(spark, tmp_path):
    packets = random_packets(4, 400, "sparse")
    table = batches_on_disk(spark, packets, str(tmp_path / "in"), 3, 2_000_000)
    stream = with_event_time(spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    sessions = drain(stream_sessions(stream))
    batch = flow_features(table, syn_cut=False).select("dst_port", "protocol", "flow_start_us", "flow_end_us", "tot_fwd_pkts")
    assert sessions.count() > 0
    assert sessions.select(*batch.columns).exceptAll(batch).count() == 0
    rates = drain(rate_windows(stream))
    full = rate_windows(table.withColumn("ts", F.timestamp_micros("ts_us")))
    assert rates.count() > 0 and rates.exceptAll(full).count() == 0


@pytest.mark.parametrize("mode, jitter_us, chunk_rows", [("sparse", 3_000_000, None), ("flood", 400_000, 60)])
def test_assembler_equals_batch(spark, tmp_path, mode, jitter_us, chunk_rows):
    """Several batches, one destination with most packets; what comes out live and at the end is the batch result."""
    packets = random_packets(31, 600, mode)
    table = batches_on_disk(spark, packets, str(tmp_path / "in"), 4, jitter_us)
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    delay = 10_000_000 if mode == "sparse" else 500_000
    live = FlowAssembler(spark, str(tmp_path / "state"), str(tmp_path / "out"), delay, chunk_rows=chunk_rows)
    run_flow_stream(stream, live, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    assert live.late_rows(3) == 0
    closed, rest = live.emitted(), live.close_out()
    newest = max(p["ts_us"] for p in packets)
    mark = (newest - delay) // 1000 * 1000
    want = flow_features(table)
    out = want.filter(F.expr(f"flow_end_us + 60000000 <= {mark} or (end_reason = '[SYN-FLOOD]' and flow_end_us <= {mark})"))
    assert keyed(closed).keys() == keyed(out).keys() and closed.count() > 0
    got, expected = keyed(closed.unionByName(rest)), keyed(want)
    assert got.keys() == expected.keys()
    for k, row in expected.items():
        for name in [*FLOW_NAMES, "end_reason", "sf_count"]:
            if FLOW_TYPES.get(name) == "double":
                assert got[k][name] == pytest.approx(row[name], rel=1e-9, abs=1e-6), name
            else:
                assert got[k][name] == row[name], name
    live(spark.createDataFrame([tuple(packets[0][c] for c in PACKETS.names)], PACKETS), 4)  # far behind the close
    late = live.late_packets().collect()
    assert live.late_rows() == len(late) == 1 and late[0].frame_no == packets[0]["frame_no"]
    assert late[0].behind_us == newest - packets[0]["ts_us"] and late[0].reason == "behind_watermark"


def test_keyed_state_puts_out_few_columns(spark, tmp_path):
    """pandas and Arrow take a fixed time a column for each key that closes a flow: a flow is two lists and a flag, not sixty columns."""
    stream = spark.readStream.schema(PACKETS).parquet(str(tmp_path))
    node = stream_flows_keyed(with_event_time(stream))._jdf.queryExecution().analyzed()
    while "WithState" not in node.nodeName():
        node = node.children().head()
    assert node.output().size() <= 3
