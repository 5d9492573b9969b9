"""Frame bytes to packets, as column expressions over a ``frames`` table.

Every frame gets either packet columns or a ``parse_error`` code. Header fields are read from one
hex rendering of the first bytes: at most 18 link bytes, 60 IP and 20 TCP bytes are ever looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.net import TCP, UDP

# Link types and the ethertypes they may carry.
ETHERNET, RAW_IP, LINUX_SLL, LOOPBACK = 1, 12, 113, 0
IPV4_ETHERTYPE, VLAN_ETHERTYPE = 0x0800, 0x8100

HEAD_BYTES = 18 + 60 + 20
PACKET_COLUMNS = ["src_ip_int", "dst_ip_int", "src_port", "dst_port", "protocol",
                  "header_len", "payload_len", "tcp_flags"]


def _u(start: str, width: int) -> str:
    """SQL: unsigned integer of ``width`` bytes at 0-based byte ``start`` of the hex head."""
    return f"cast(conv(substring(head, 2 * ({start}) + 1, {2 * width}), 16, 10) as bigint)"


def _stage(df: DataFrame, exprs: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns computed once per row.

    The fields of a header depend on each other several levels deep. Written as nested projections the
    optimiser would inline every level into the next and into each filter. A one-element ``inline``
    keeps the levels apart while all of them stay in generated code.
    """
    kept = [F.col(c) for c in df.columns if c not in drop]
    return df.select(*kept, F.inline(F.array(F.struct(*[F.expr(e).alias(n) for n, e in exprs.items()]))))


def strip_l2(frames: DataFrame) -> DataFrame:
    """Add ``ip_at`` (offset of the IPv4 header) or ``l2_error``.

    A NULL link type means loopback; an unknown one is read as bare IP.
    """
    df = _stage(frames, {
        "head": f"hex(substring(raw, 1, {HEAD_BYTES}))",
        "captured": "length(raw)",
        "link": f"coalesce(linktype, {LOOPBACK})",
    })
    df = _stage(df, {"tagged": f"link = {ETHERNET} and captured >= 14 and {_u('12', 2)} = {VLAN_ETHERTYPE}"})
    return _stage(df, {
        "ip_at": f"""case link when {ETHERNET} then if(tagged, 18, 14) when {LINUX_SLL} then 16
                               when {LOOPBACK} then 4 else 0 end""",
        "l2_error": f"""case
            when link = {ETHERNET} and captured < 14 then 'ethernet_short'
            when link = {ETHERNET} and tagged and captured < 18 then 'vlan_short'
            when link = {ETHERNET} and {_u('if(tagged, 16, 12)', 2)} <> {IPV4_ETHERTYPE} then 'ethertype_not_ipv4'
            when link = {LINUX_SLL} and captured < 16 then 'sll_short'
            when link = {LINUX_SLL} and {_u('14', 2)} <> {IPV4_ETHERTYPE} then 'sll_not_ipv4'
            when link = {LOOPBACK} and captured < 4 then 'loopback_short' end""",
    }, drop=("tagged", "link"))


def parse_frames(frames: DataFrame) -> DataFrame:
    """All input columns but ``raw``, the packet columns, and ``parse_error`` (NULL if decoded)."""
    kept = [c for c in frames.columns if c != "raw"]
    df = strip_l2(frames.filter("length(raw) > 0")).drop("raw")
    df = _stage(df, {"ip_len": "if(l2_error is null, captured - ip_at, 0)"})
    df = _stage(df, {
        "word0": f"if(ip_len >= 20, {_u('ip_at', 4)}, null)",
        "proto": f"if(ip_len >= 20, {_u('ip_at + 9', 1)}, null)",
    })
    df = _stage(df, {"ihl": "((word0 >> 24) & 15) * 4", "total_len": "word0 & 65535"}, drop=("word0",))
    # TCP data offset and flags are the two bytes of one word
    df = _stage(df, {
        "l4_at": "ip_at + ihl",
        "tcp_word": f"if(proto = {TCP} and ip_len >= ihl + 20, {_u('ip_at + ihl + 12', 2)}, null)",
        "wire_len": "if(total_len > 0, total_len, ip_len)",
    })
    df = _stage(df, {
        "l4_len": f"if(proto = {UDP}, 8, (tcp_word >> 12) * 4)",
        "ports": f"if(ip_len >= ihl + 8, {_u('l4_at', 4)}, null)",
    })
    df = _stage(df, {"parse_error": f"""case
        when l2_error is not null then l2_error
        when ip_len < 20 then 'ip_short'
        when ihl < 20 then 'ihl_invalid'
        when ip_len < ihl then 'ip_options_short'
        when proto = {TCP} and ip_len < ihl + 20 then 'tcp_short'
        when proto = {TCP} and l4_len < 20 then 'tcp_offset_invalid'
        when proto = {UDP} and ip_len < ihl + 8 then 'udp_short'
        when proto not in ({TCP}, {UDP}) then 'protocol_unsupported'
        when wire_len < ihl + l4_len then 'total_len_too_small' end"""})
    values = {
        "src_ip_int": _u("ip_at + 12", 4), "dst_ip_int": _u("ip_at + 16", 4),
        "src_port": "cast(ports >> 16 as int)", "dst_port": "cast(ports & 65535 as int)",
        "protocol": "cast(proto as int)", "header_len": "cast(ihl + l4_len as int)",
        "payload_len": "cast(wire_len - ihl - l4_len as int)",
        "tcp_flags": "cast(coalesce(tcp_word & 255, 0) as int)",
    }
    return df.selectExpr(
        *kept, *[f"if(parse_error is null, {values[c]}, null) as {c}" for c in PACKET_COLUMNS], "parse_error")


def decode_packets(frames: DataFrame) -> DataFrame:
    """The ``packets`` table of all frames that decode; every packet counts as forward. ``capture_no`` passes where there is one."""
    good = parse_frames(frames).filter("parse_error is null")
    capture = [c for c in frames.columns if c == "capture_no"]
    return good.select("frame_no", "ts_us", *PACKET_COLUMNS, F.lit(True).alias("is_fwd"), *capture)


def quarantine_bad_frames(frames: DataFrame) -> DataFrame:
    """Frames that do not decode, with the reason."""
    return parse_frames(frames).filter("parse_error is not null").drop(*PACKET_COLUMNS)
