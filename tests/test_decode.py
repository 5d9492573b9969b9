from pyspark.sql import functions as F

from flowloom.operators.decode import PACKET_COLUMNS, decode_packets, parse_frames, quarantine_bad_frames
from flowloom.plans.flow_plan import flow_features
from flowloom.schemas import FRAMES
from flowloom.sources.files import read_frames
from flowloom.sources.tables import frames_from_packets, packets_from_events

IP_TCP = bytes.fromhex("4500003200000000400600000a000001c0a80102" "04d2005000000000000000005018200000000000")
IP_UDP = bytes.fromhex("4500002400000000401100000a000001c0a80102" "04d20035" "00100000")
ETH = bytes.fromhex("0200000000010200000000020800")


def put(data, at, *values):
    out = bytearray(data)
    out[at:at + len(values)] = bytes(values)
    return bytes(out)


BAD = {
    "ethernet_short": (1, ETH[:13]),
    "vlan_short": (1, ETH[:12] + bytes.fromhex("8100000a08")),
    "ethertype_not_ipv4": (1, ETH[:12] + bytes.fromhex("86dd") + IP_TCP),
    "sll_short": (113, bytes(15)),
    "sll_not_ipv4": (113, bytes(14) + bytes.fromhex("86dd") + IP_TCP),
    "loopback_short": (0, bytes(3)),
    "ip_short": (12, IP_TCP[:19]),
    "ihl_invalid": (12, put(IP_TCP, 0, 0x44)),
    "ip_options_short": (12, put(IP_TCP, 0, 0x4F)[:20]),
    "tcp_short": (12, IP_TCP[:39]),
    "tcp_offset_invalid": (12, put(IP_TCP, 32, 0x40)),
    "udp_short": (12, IP_UDP[:27]),
    "protocol_unsupported": (12, put(IP_TCP, 9, 1)),
    "total_len_too_small": (12, put(IP_TCP, 2, 0, 30)),
}


def frames(spark, rows):
    data = [(i, 1_704_067_200_000_000 + i, link, len(raw), raw) for i, (link, raw) in enumerate(rows)]
    return spark.createDataFrame(data, FRAMES)


def test_round_trip_over_all_link_types(spark, sf_small):
    packets = packets_from_events(spark, sf_small)
    back = decode_packets(frames_from_packets(packets)).drop("is_fwd")
    want = packets.drop("is_fwd").select(back.columns)
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0


def test_each_error_class(spark):
    rows = quarantine_bad_frames(frames(spark, BAD.values())).orderBy("frame_no").collect()
    assert [r.parse_error for r in rows] == list(BAD)


def test_accepted_oddities(spark):
    cases = [
        (12, put(IP_TCP, 2, 0, 0)),           # total_len 0: buffer length counts
        (12, put(IP_TCP, 0, 0x65)),           # version nibble is not looked at
        (12, put(IP_TCP, 6, 0x20, 0x10)),     # nor is the fragment offset
        (None, bytes(4) + IP_TCP),            # no link type means loopback
        (999, IP_TCP),                        # unknown link type is read as IP
        (12, IP_UDP),
        (1, ETH + IP_TCP + bytes(10)),        # padding after the datagram is not payload
        (12, put(IP_TCP, 0, 0x46) + bytes(8)),  # four bytes of IP options
    ]
    rows = parse_frames(frames(spark, cases)).orderBy("frame_no").collect()
    assert [r.parse_error for r in rows[:7]] == [None] * 7
    assert [r.payload_len for r in rows[:7]] == [0, 10, 10, 10, 10, 8, 10]
    assert rows[0].src_ip_int == 0x0A000001 and rows[0].dst_ip_int == 0xC0A80102
    assert (rows[0].src_port, rows[0].dst_port, rows[0].tcp_flags, rows[5].tcp_flags) == (1234, 80, 24, 0)
    assert rows[7].parse_error == "tcp_offset_invalid"  # options shift the TCP header


def test_empty_frames_are_skipped_and_values_are_null_on_error(spark, tmp_path):
    frames(spark, [(12, b""), (12, IP_TCP), BAD["tcp_short"]]).write.parquet(str(tmp_path / "f"))
    table = read_frames(spark, str(tmp_path / "f"))
    assert table.count() == 2
    parsed = parse_frames(table)
    assert parsed.filter("parse_error is not null and coalesce(" + ",".join(PACKET_COLUMNS) + ") is not null").count() == 0
    assert decode_packets(table).select(F.min("payload_len")).first()[0] == 10


def test_flows_read_decoded_packets_only_once(spark, sf_small):
    """The decode runs while the narrow packets are stored; the plan of the flow record no longer holds it."""
    packets = decode_packets(frames_from_packets(packets_from_events(spark, sf_small)))
    assert "inline" in packets._jdf.queryExecution().toString()
    plan = flow_features(packets)._jdf.queryExecution().toString()
    assert "inline" not in plan and "raw" not in plan
