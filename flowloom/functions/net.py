"""Column functions over addresses, TCP flags and packet times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TCP, UDP = 6, 17

# Flag bits, and the order in which names are listed.
FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}
FLAG_NAME_ORDER = ["SYN", "ACK", "FIN", "RST", "PSH", "URG", "ECE", "CWR"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bytes_to_int(raw, start, width: int) -> Column:
    """Big-endian unsigned integer of ``width`` bytes at 0-based ``start``; NULL if absent."""
    raw = _col(raw)
    start = start if isinstance(start, Column) else F.lit(start)
    piece = F.substring(raw, start + 1, F.lit(width))
    return F.when(F.length(raw) >= start + width, F.conv(F.hex(piece), 16, 10).cast("bigint"))


def ip_to_int(four_bytes) -> Column:
    """Unsigned 32-bit value of a 4-byte address."""
    return bytes_to_int(four_bytes, 0, 4)


def int_to_ip(ip_int) -> Column:
    """Dotted quad of an unsigned 32-bit value held in a BIGINT."""
    ip_int = _col(ip_int)
    octets = [F.shiftright(ip_int, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def has_flag(flags, name: str) -> Column:
    return _col(flags).bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def is_syn_only(protocol="protocol", flags="tcp_flags") -> Column:
    """TCP packet that opens a connection: SYN without ACK."""
    return (_col(protocol) == TCP) & has_flag(flags, "SYN") & ~has_flag(flags, "ACK")


def tcp_flag_names(flags) -> Column:
    """ARRAY<STRING> of the names of the set bits."""
    names = F.array(*[F.when(has_flag(flags, n), F.lit(n)) for n in FLAG_NAME_ORDER])
    return F.array_compact(names)


def format_hhmmss_us(ts_us) -> Column:
    """``HH:mm:ss.ffffff`` in the session time zone."""
    return F.date_format(F.timestamp_micros(_col(ts_us)), "HH:mm:ss.SSSSSS")


def _pad(text: Column, width: int, left: bool = False) -> Column:
    # lpad/rpad cut longer text, so pad only what is shorter
    padded = F.lpad(text, width, " ") if left else F.rpad(text, width, " ")
    return F.when(F.length(text) < width, padded).otherwise(text)


def endpoint(ip_int, port) -> Column:
    return F.concat_ws(":", int_to_ip(ip_int), _col(port).cast("string"))


def packet_summary(no="frame_no", ts_us="ts_us", src="src_ip_int", sport="src_port", dst="dst_ip_int",
                   dport="dst_port", protocol="protocol", payload="payload_len", flags="tcp_flags") -> Column:
    """One fixed-width line per packet: number, time, endpoints, protocol, length, flags."""
    proto, flag = _col(protocol), _col(flags)
    names = F.array_join(tcp_flag_names(flags), ", ")
    tcp_info = F.when(names == "", "[.]").otherwise(F.concat(F.lit("["), names, F.lit("]")))
    hex_digits = F.lower(F.hex(flag))
    hex_info = F.concat(F.lit("[0x"), F.when(F.length(hex_digits) < 2, F.lpad(hex_digits, 2, "0"))
                        .otherwise(hex_digits), F.lit("]"))
    info = F.when(proto == TCP, tcp_info).when(flag == 0, "[.]").otherwise(hex_info)
    proto_name = F.when(proto == TCP, "TCP").when(proto == UDP, "UDP").otherwise(proto.cast("string"))
    route = F.concat(endpoint(src, sport), F.lit(" -> "), endpoint(dst, dport))
    return F.concat_ws(
        " ",
        _pad(_col(no).cast("string"), 6, left=True),
        _pad(format_hhmmss_us(ts_us), 15),
        _pad(route, 45),
        _pad(proto_name, 4),
        _pad(_col(payload).cast("string"), 5, left=True),
        info,
    )


def packet_debug_line(src="src_ip_int", sport="src_port", dst="dst_ip_int", dport="dst_port",
                      protocol="protocol", payload="payload_len", flags="tcp_flags") -> Column:
    """Compact trace line of one packet."""
    return F.format_string(
        "[PKT] %s → %s proto=%d len=%d flags=%d",
        endpoint(src, sport), endpoint(dst, dport), _col(protocol), _col(payload), _col(flags))
