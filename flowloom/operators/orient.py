"""Two-way flows: one key for both directions, forward meaning "as the flow's first packet".

Every sum of a flow is kept for either side of the pair, and all rules treat both sides alike. So records need no
look ahead at the first packet: packets are keyed by the unordered pair, and the finished sums are turned by the side that
sent the first one. This holds in chunks of a hot pair and across the batches of a stream as well.

Where packets themselves are wanted with their flow's orientation, the first packet of a session is found from
one-minute buckets: two packets of a bucket are less than the idle timeout apart, so a session never begins inside a
bucket that already holds packets. Buckets come from a mergeable aggregate, however many packets a conversation has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.syncut import IDLE_US
from flowloom.plans.flow_plan import flow_features
from flowloom.session import durable

PAIR = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]
FLOW_KEY = ["flow_src_ip_int", "flow_src_port", "dst_ip_int", "dst_port", "protocol"]


_FROM_A = "src_ip_int < dst_ip_int or (src_ip_int = dst_ip_int and src_port <= dst_port)"


def as_pairs(packets: DataFrame) -> DataFrame:
    """Packets under the unordered pair of their endpoints; ``is_fwd`` tells those that the lower endpoint sent."""
    return packets.withColumn("is_fwd", F.expr(_FROM_A)).withColumns({
        "ip_a": F.expr("if(is_fwd, src_ip_int, dst_ip_int)"), "port_a": F.expr("if(is_fwd, src_port, dst_port)"),
        "ip_b": F.expr("if(is_fwd, dst_ip_int, src_ip_int)"), "port_b": F.expr("if(is_fwd, dst_port, src_port)")})


def turn_flows(flows: DataFrame) -> DataFrame:
    """Sums of flows of unordered pairs (``aggregate_flows`` with ``opener``) as seen by the sender of the first packet."""
    def side(mine: str, other: str) -> str:
        return f"if(first_fwd, {mine}, {other})"

    out = {"flow_src_ip_int": side("ip_a", "ip_b"), "flow_src_port": side("port_a", "port_b"),
           "dst_ip_int": side("ip_b", "ip_a"), "dst_port": side("port_b", "port_a")}
    for c in flows.columns:
        other = {"f_": "b_", "b_": "f_"}.get(c[:2], "") + c[2:]
        if c not in PAIR[:4]:
            out[c] = side(c, other) if other != c[2:] else c
    return flows.selectExpr(*[f"{e} as {c}" for c, e in out.items()])


def bidirectional_flow_key(packets: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """Packets with the 5-tuple of their flow's first packet and ``is_fwd`` relative to it."""
    from_a = F.expr(_FROM_A)
    if "capture_no" not in packets.columns:
        packets = packets.withColumn("capture_no", F.lit(0).cast("bigint"))
    rows = packets.withColumns({"from_a": from_a, "bucket": F.expr(f"ts_us div {idle_us}")}).withColumns({
        "ip_a": F.expr("if(from_a, src_ip_int, dst_ip_int)"), "port_a": F.expr("if(from_a, src_port, dst_port)"),
        "ip_b": F.expr("if(from_a, dst_ip_int, src_ip_int)"), "port_b": F.expr("if(from_a, dst_port, src_port)"),
    })
    rows = durable(rows)
    # first times of both ways are fixed-width minima, so this is a hash aggregate; frames decide only equal times
    first = {w: F.min(F.when(way, F.col("ts_us"))) for w, way in (("a", F.col("from_a")), ("b", ~F.col("from_a")))}
    buckets = durable(rows.groupBy(*PAIR, "bucket").agg(
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), first["a"].alias("at_a"), first["b"].alias("at_b")))
    tied = rows.join(buckets.filter("at_a = at_b").select(*PAIR, "bucket", F.col("lo").alias("ts_us")), [*PAIR, "bucket", "ts_us"])
    frames = tied.groupBy(*PAIR, "bucket").agg(F.min_by("from_a", F.struct("frame_no", "capture_no")).alias("tie_from_a"))
    buckets = buckets.join(frames, [*PAIR, "bucket"], "left").withColumn(
        "first_from_a", F.coalesce("tie_from_a", (F.col("at_b").isNull() | (F.col("at_a") < F.col("at_b")))))
    buckets = buckets.withColumn("first_from_a", F.coalesce("first_from_a", F.lit(False)))
    w = Window.partitionBy(*PAIR).orderBy("bucket")
    gap = F.col("lo") - F.lag("hi").over(w)
    sessions = buckets.withColumn("opens", F.coalesce(gap > idle_us, F.lit(True)))
    opener = F.last(F.when(F.col("opens"), F.col("first_from_a")), ignorenulls=True)
    sessions = sessions.select(*PAIR, "bucket", opener.over(w).alias("a_first"))
    ahead = F.col("a_first")
    return rows.join(sessions, [*PAIR, "bucket"]).select(
        "frame_no", "ts_us", "capture_no",
        F.when(ahead, F.col("ip_a")).otherwise(F.col("ip_b")).alias("flow_src_ip_int"),
        F.when(ahead, F.col("port_a")).otherwise(F.col("port_b")).alias("flow_src_port"),
        F.when(ahead, F.col("ip_b")).otherwise(F.col("ip_a")).alias("dst_ip_int"),
        F.when(ahead, F.col("port_b")).otherwise(F.col("port_a")).alias("dst_port"),
        "protocol", "header_len", "payload_len", "tcp_flags", (F.col("from_a") == ahead).alias("is_fwd"))


def bidirectional_features(packets: DataFrame, **options) -> DataFrame:
    """Flow records of two-way conversations, closed by the idle timeout only."""
    return flow_features(as_pairs(packets), PAIR, directional=True, syn_cut=False, turn=turn_flows, **options)
