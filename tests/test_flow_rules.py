"""Window features against the packet-at-a-time restatement, whole keys and chunked keys."""

import random

import pytest

from flowloom.functions.net import int_to_ip
from flowloom.plans.flow_plan import DST_KEY, flow_features, packet_deltas
from flowloom.schemas import PACKETS
from sequential import all_features, cut_into_flows


def random_packets(seed, n, mode):
    rng = random.Random(seed)
    step = {"ties": [0, 0, 0, 1], "dense": [0, 1, 200_000, 400_000, 1_000_001],
            "sparse": [0, 10, 900_000, 1_000_000, 1_000_001, 5_000_000, 59_999_999, 60_000_000, 60_000_001],
            "flood": [0, 5, 1000, 30_000]}[mode]
    clock, out = {}, []
    for i in range(n):
        k = 0 if rng.random() < 0.7 else rng.randrange(1, 4)
        clock[k] = clock.get(k, 0) + rng.choice(step)
        syn = rng.random() < (0.8 if mode == "flood" else 0.3)
        out.append((i, 1_704_067_200_000_000 + clock[k], 167772160 + rng.randrange(9), 3232235776 + k,
                    1024 + rng.randrange(50), 80, 17 if k == 3 else 6, 40, rng.choice([0, 0, 10, 100, 1460]),
                    2 if syn else rng.choice([16, 24, 17, 20, 18, 255]), rng.random() < 0.5))
    return [dict(zip(PACKETS.names, row)) for row in out]


def compare(spark, packets, directional, **options):
    df = spark.createDataFrame([tuple(p[c] for c in PACKETS.names) for p in packets], PACKETS)
    got = flow_features(df, directional=directional, **options).collect()
    want = all_features(packets, DST_KEY, directional)
    assert len(got) == len(want)
    ip = {}
    for p in packets:
        v = p["dst_ip_int"]
        ip[".".join(str(v >> s & 255) for s in (24, 16, 8, 0))] = v
    index = {(ip[r.dst_ip], r.dst_port, r.protocol, r.flow_start_us, r.flow_start_frame): r.asDict() for r in got}
    for w in want:
        g = index[tuple(w[c] for c in DST_KEY) + (w["flow_start_us"], w["flow_start_frame"])]
        for name, value in w.items():
            if name == "dst_ip_int":
                continue
            if isinstance(g[name], float):
                assert g[name] == pytest.approx(value, rel=1e-9, abs=1e-6), (name, w)
            else:
                assert g[name] == value, (name, w)


@pytest.mark.parametrize("mode", ["ties", "dense", "sparse", "flood"])
@pytest.mark.parametrize("directional", [False, True])
def test_random_packets(spark, mode, directional):
    packets = random_packets({"ties": 101, "dense": 202, "sparse": 303, "flood": 404}[mode], 900, mode)
    compare(spark, packets, directional)
    compare(spark, packets, directional, chunk_rows=40)


def test_one_instant_holds_a_hot_key(spark):
    packets = random_packets(5, 600, "flood")
    for p in packets:
        p["ts_us"] = 1_704_067_200_000_000 + p["frame_no"] // 400
    compare(spark, packets, True, chunk_rows=30)


def test_tiny_chunks(spark):
    compare(spark, random_packets(11, 400, "ties"), True, chunk_rows=3)
    compare(spark, random_packets(12, 400, "dense"), True, chunk_rows=5)


@pytest.mark.parametrize("chunk_rows", [None, 30])
def test_two_captures_with_the_same_frame_numbers(spark, chunk_rows):
    """Pairs of packets that share time and frame number are told apart by their capture: the cut is at 50."""
    start = 1_704_067_200_000_000
    rows = [(i // 2, start + i // 2, i % 2, 1, 2, 1024, 80, 6, 40, 0, 2, True) for i in range(121)]
    names = "frame_no long, ts_us long, capture_no long, src_ip_int long, dst_ip_int long, src_port int, dst_port int, protocol int, header_len int, payload_len int, tcp_flags int, is_fwd boolean"
    got = flow_features(spark.createDataFrame(rows, names), chunk_rows=chunk_rows)
    flows = [(r.flow_start_frame, r.flow_start_capture, r.tot_fwd_pkts, r.end_reason) for r in got.orderBy("flow_start_frame").collect()]
    assert flows == [(0, 0, 50, "[SYN-FLOOD]"), (25, 0, 50, "[SYN-FLOOD]"), (50, 0, 21, "[Shutdown]")]


@pytest.mark.parametrize("chunk_rows", [None, 7])
def test_subflow_numbers(spark, chunk_rows):
    packets = random_packets(77, 500, "sparse")
    df = spark.createDataFrame([tuple(p[c] for c in PACKETS.names) for p in packets], PACKETS)
    parts = packet_deltas(df, syn_cut=False, chunk_rows=chunk_rows)
    got = {r.frame_no: r.subflow_no for part in parts for r in part.collect()}
    for flow, _ in cut_into_flows(packets, DST_KEY, False, syn_cut=False):
        number, before = 1, flow[0]["ts_us"]
        for p in flow:
            number += p["ts_us"] - before > 1_000_000
            before = p["ts_us"]
            assert got[p["frame_no"]] == number
