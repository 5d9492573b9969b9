"""Row filters and address checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.net import TCP, UDP


def host_filter(packets: DataFrame, ip: str) -> DataFrame:
    """Packets sent from or to one address (integer compare, pushed into the scan)."""
    octets = ip.split(".")
    if len(octets) != 4 or not all(o.isdigit() and int(o) < 256 for o in octets):
        raise ValueError(f"not an IPv4 address: {ip!r}")
    value = sum(int(o) << s for o, s in zip(octets, (24, 16, 8, 0)))
    return packets.filter((F.col("src_ip_int") == value) | (F.col("dst_ip_int") == value))


def ipv4_tcp_udp_only(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("protocol").isin(TCP, UDP))


def is_ipv4(text: Column) -> Column:
    """Four decimal octets without leading zeros."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return text.rlike(rf"^{octet}(\.{octet}){{3}}$")


def validate_ip(df: DataFrame, col: str, allowed: DataFrame, allowed_col: str = "ip") -> DataFrame:
    """Add ``status``: empty, malformed, wildcard, not_allowed or ok.

    The allowed set is matched by a left join on distinct addresses; adaptive execution broadcasts
    it if its measured size is small.
    """
    wanted = allowed.select(F.trim(F.col(allowed_col)).alias("_allowed")).distinct()
    text = F.trim(F.coalesce(F.col(col), F.lit("")))
    joined = df.withColumn("_ip", text).join(wanted, F.col("_ip") == F.col("_allowed"), "left")
    status = (F.when(F.col("_ip") == "", "empty")
              .when(~is_ipv4(F.col("_ip")), "malformed")
              .when(F.col("_ip") == "0.0.0.0", "wildcard")
              .when(F.col("_allowed").isNull(), "not_allowed")
              .otherwise("ok"))
    return joined.withColumn("status", status).drop("_ip", "_allowed")
