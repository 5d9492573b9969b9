"""Features that a user declares: names, kinds, whole keys, chunks, two-way flows, live batches."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators.custom import FlowFeature
from flowloom.operators.orient import bidirectional_features
from flowloom.plans.flow_plan import flow_features
from flowloom.schemas import PACKETS
from flowloom.streaming.assemble import FlowAssembler

SECOND = 1_000_000
FEATURES = [FlowFeature("ports", "src_port", "distinct", "int"), FlowFeature("big", "if(payload_len > 5, 1, null)", "count", "int"),
            FlowFeature("least_big", "if(payload_len > 5, payload_len, null)", "min", "int"), FlowFeature("most", "payload_len", "max", "int"),
            FlowFeature("mean_len", "payload_len", "sum", record="{value} / {packets}")]
NAMES = [f.name for f in FEATURES]
LABEL = ["dst_port", "flow_start_us"]


def packets(spark):
    """Port 80: ten packets, a pause, two packets; port 53: one empty packet."""
    rows = [(k, 10**15 + k * SECOND, 1, 7, 1000 + k % 3, 80, 6, 40, k, 16, True) for k in range(10)]
    rows += [(20 + k, 10**15 + (100 + k) * SECOND, 1, 7, 2000, 80, 6, 40, 3, 16, True) for k in range(2)]
    rows += [(30, 10**15 + 102 * SECOND, 1, 7, 5, 53, 17, 28, 0, 0, True)]
    return spark.createDataFrame(rows, PACKETS)


WANT = [(53, 10**15 + 102 * SECOND, 1, 0, None, 0, 0.0), (80, 10**15, 3, 4, 6, 9, 4.5), (80, 10**15 + 100 * SECOND, 1, 0, None, 3, 3.0)]


def rows_of(flows):
    return sorted((tuple(r) for r in flows.select(*LABEL, *NAMES).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("chunk_rows", [None, 4])
def test_batch(spark, chunk_rows):
    assert rows_of(flow_features(packets(spark), chunk_rows=chunk_rows, features=FEATURES)) == WANT


def test_two_way(spark):
    back = F.col("frame_no") % 2 == 1
    swapped = {a: F.when(back, F.col(b)).otherwise(F.col(a)) for a, b in (("src_ip_int", "dst_ip_int"), ("dst_ip_int", "src_ip_int"))}
    ports = {"src_port": F.when(back, 80).otherwise(9), "dst_port": F.when(back, 9).otherwise(80)}
    talk = packets(spark).filter("protocol = 6").withColumns(swapped).withColumns(ports)
    got = bidirectional_features(talk, features=FEATURES).select("tot_fwd_pkts", "tot_bwd_pkts", *NAMES).orderBy("flow_start_us").collect()
    assert [tuple(r) for r in got] == [(5, 5, 2, 4, 6, 9, 4.5), (1, 1, 2, 0, None, 3, 3.0)]


@pytest.mark.parametrize("two_batches", [False, True])
def test_live(spark, tmp_path, two_batches):
    live = FlowAssembler(spark, str(tmp_path / "state"), str(tmp_path / "out"), SECOND, buckets=2, features=FEATURES)
    if two_batches:
        live(packets(spark).filter("frame_no < 6"), 0)  # the first flow goes on
        live(packets(spark).filter("frame_no >= 6"), 1)
    else:
        live(packets(spark), 0)
    live.close_out()
    assert rows_of(live.emitted(closed_out=True)) == WANT


def test_declarations(spark):
    for name, how in (("dst_port", "sum"), ("two words", "sum"), ("flow_end_us", "max"), ("fine", "median")):
        with pytest.raises(ValueError):
            FlowFeature(name, "payload_len", how)
    with pytest.raises(ValueError):
        flow_features(packets(spark), features=[FEATURES[0], FEATURES[0]])
