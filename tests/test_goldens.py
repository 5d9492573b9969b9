"""Hand-computed flows (G1-G8 of FIXTURES.md)."""

import pytest

from flowloom.plans.flow_plan import flow_features
from flowloom.schemas import PACKETS

T0 = 1_704_067_200_000_000
SYN, ACK = 2, 16


def flows(spark, rows, directional=False, **options):
    """rows: (offset us, payload, flags, is_fwd[, protocol])"""
    data = [(i, T0 + r[0], 167772161, 3232235778, 1234, 80, r[4] if len(r) > 4 else 6, 40, r[1], r[2], r[3])
            for i, r in enumerate(rows)]
    df = flow_features(spark.createDataFrame(data, PACKETS), directional=directional, **options)
    return df.orderBy("flow_start_us", "flow_start_frame").collect()


def check(row, **expected):
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-4), name


def test_g1_two_directions(spark):
    row, = flows(spark, [(0, 100, 0, True), (1000, 200, 0, False)], directional=True)
    check(row, flow_duration=1000, flow_byts_s=300000, flow_pkts_s=2000, flow_iat_mean=500, flow_iat_std=707.1068,
          flow_iat_max=1000, flow_iat_min=0, fwd_iat_tot=0, bwd_iat_tot=0, bwd_iat_mean=0, pkt_len_mean=150,
          pkt_len_var=5000, pkt_len_std=70.7107, down_up_ratio=2, active_mean=1000, active_max=1000, active_min=1000,
          active_std=0, idle_mean=0, fwd_seg_size_min=100, fwd_act_data_pkts=1, total_tcp_flow_time=1000)


def test_g2_single_syn(spark):
    row, = flows(spark, [(0, 0, SYN, True)])
    check(row, flow_duration=-1, flow_byts_s=0, flow_pkts_s=0, flow_iat_mean=0, flow_iat_std=0, flow_iat_max=0,
          fwd_iat_tot=0, fwd_iat_mean=0, bwd_iat_tot=-1, bwd_iat_mean=-1, bwd_iat_max=-1, bwd_iat_min=-1,
          bwd_iat_std=0, active_mean=0, idle_mean=0, syn_flag_cnt=1, total_tcp_flow_time=-1, fwd_seg_size_min=0)


def test_g3_subflows_bulk_active_idle(spark):
    row, = flows(spark, [(t, 100, ACK, True) for t in (0, 100_000, 200_000, 300_000, 2_000_000)])
    check(row, sf_count=2, subflow_fwd_pkts=2, subflow_fwd_byts=250, fwd_byts_b_avg=400, fwd_pkts_b_avg=4,
          fwd_blk_rate_avg=1333, flow_iat_mean=400000, active_mean=1150000, active_std=1202081.5281,
          active_max=2000000, active_min=300000, idle_mean=1700000, idle_std=0)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 33}])
def test_g4_syn_flood(spark, options):
    rows = flows(spark, [(i * 10_000, 0, SYN, True) for i in range(120)], **options)
    assert [r.tot_fwd_pkts for r in rows] == [50, 50, 20]
    assert [r.end_reason for r in rows] == ["[SYN-FLOOD]", "[SYN-FLOOD]", "[Shutdown]"]


def test_g5_idle_boundary(spark):
    assert len(flows(spark, [(0, 1, ACK, True), (60_000_000, 1, ACK, True)])) == 1
    two = flows(spark, [(0, 1, ACK, True), (60_000_001, 1, ACK, True)])
    assert [r.end_reason for r in two] == ["[Timeout]", "[Shutdown]"]


def test_g6_syn_after_acks(spark):
    rows = flows(spark, [(i, 0, ACK, True) for i in range(60)] + [(60, 0, SYN, True), (61, 0, ACK, True)])
    assert [(r.tot_fwd_pkts, r.end_reason) for r in rows] == [(61, "[SYN-FLOOD]"), (1, "[Shutdown]")]


def test_g7_trailing_idle(spark):
    row, = flows(spark, [(i * 50_000_000, 0, ACK, True) for i in range(5)])
    check(row, active_mean=0, active_max=0, idle_max=200_000_000, idle_min=50_000_000, idle_mean=80_000_000)


def test_g8_udp_has_no_flags(spark):
    row, = flows(spark, [(0, 10, 255, True, 17), (5, 10, 255, True, 17)])
    names = ("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece")
    assert all(row[f"{n}_flag_cnt"] == 0 for n in names) and row.fwd_psh_flags == 0
    assert row.total_tcp_flow_time == 0 and row.flow_duration == 5


def test_as_of_closes_old_flows(spark):
    row, = flows(spark, [(0, 1, ACK, True)], as_of_us=T0 + 60_000_001)
    assert row.end_reason == "[Timeout]"
