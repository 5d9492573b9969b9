"""Whole flow records of idle-timeout sessions from built-in functions: live, without keyed Python state.

Gaps, active and idle periods and bulk runs depend on the order of packets. The packets of a key are first added up by
slices of one second. Inside a slice no gap reaches a second, so neither a pause nor the end of a bulk run lies in it: a slice is one
row, and of its packets only the distinct microseconds have to be sorted (a million at most, however many packets came).
The slices of a session are then sorted and folded. A task thus holds a row a second of a session, whatever the packet rate.

Spark's session window sees slices, not packets, so it may hold two sessions that lie less than a slice further apart than the idle
time; the fold cuts them exactly. Sums of squares are exact integers, so spreads don't depend on the order of merging.

SYN cuts are no part of this rule (see ``assemble``); the records are those of ``flow_features(..., syn_cut=False)``. Every packet counts
as forward. Null keys or times are not packets; an empty input gives no rows. Packets that agree in time, frame and capture number
are counted each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.net import FLAG_BITS, TCP
from flowloom.operators.deltas import ACTIVITY_US, BULK_MIN_PACKETS
from flowloom.operators.features import DIRECTIONAL_FLAGS, flow_record
from flowloom.operators.syncut import IDLE_US
from flowloom.plans.flow_plan import DST_KEY

_SECOND = 1_000_000
_FLAGS = {f"f_{n.lower()}" if n in DIRECTIONAL_FLAGS else f"all_{n.lower()}": bit for n, bit in FLAG_BITS.items()}
_TOTALS = ["n", "header", "len_sum", "data", *_FLAGS]
_EXACT = "decimal(38,0)"


def second_slices(packets: DataFrame) -> DataFrame:
    """One row a key and second (``at`` is its event time): sums, first and last packets, gaps between its packets."""
    if "capture_no" not in packets.columns:
        packets = packets.withColumn("capture_no", F.lit(0).cast("bigint"))
    size = F.col("payload_len").cast("bigint")
    data = F.when(size > 0, F.col("ts_us"))
    flags = [F.count_if((F.col("protocol") == TCP) & (F.col("tcp_flags").bitwiseAND(bit) != 0)).alias(c) for c, bit in _FLAGS.items()]
    rows = packets.groupBy(F.window("ts", "1 second"), *DST_KEY).agg(
        F.min(F.struct("ts_us", "frame_no", "capture_no")).alias("first"), F.max("ts_us").alias("last"),
        F.collect_set("ts_us").alias("times"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("header_len").cast("bigint")).alias("header"),
        F.sum(size).alias("len_sum"), F.sum(size * size).alias("len_sq"), F.min(size).alias("len_min"), F.max(size).alias("len_max"),
        F.count(data).alias("data"), F.min(F.when(size > 0, size)).alias("data_min"),
        F.min(data).alias("data_first"), F.max(data).alias("data_last"), *flags)
    rows = rows.withColumn("times", F.sort_array("times"))
    others = F.size("times") - 1
    rows = rows.withColumn("gaps", F.zip_with(F.slice("times", 2, others), F.slice("times", 1, others), lambda b, a: b - a))
    same = F.col("n") > F.size("times")  # packets of one microsecond follow each other with no gap
    return rows.select(
        F.window_time("window").alias("at"), *DST_KEY, *[c for c in rows.columns if c not in ("window", "times", "gaps", *DST_KEY)],
        F.aggregate("gaps", F.lit(0).cast("bigint"), lambda t, g: t + g * g).alias("gap_sq"),
        F.when(same, F.lit(0)).otherwise(F.array_min("gaps")).cast("bigint").alias("gap_min"),
        F.coalesce(F.array_max("gaps"), F.when(same, F.lit(0))).cast("bigint").alias("gap_max"))


def _total(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda t, x: (t + x).cast(kind))


def _squares(values: Column) -> Column:
    return _total(F.transform(values, lambda x: x.cast(_EXACT) * x.cast(_EXACT)), _EXACT)


def _measure(name: str, n: Column, total: Column, squares: Column, low: Column, high: Column) -> list[Column]:
    """The raw sums that ``flow_record`` reads, from exact totals."""
    count, whole = n.cast("decimal(18,0)"), total.cast("decimal(19,0)")
    spread = (count * squares - whole * whole).cast("double") / (n.cast("double") * (n - 1))
    return [n.alias(f"{name}_n"), F.when(n > 0, total).alias(f"{name}_sum"), F.when(n > 1, spread).alias(f"{name}_var"),
            low.alias(f"{name}_min"), high.alias(f"{name}_max")]


def _sampled(name: str, values: str) -> list[Column]:
    x = F.col(values)
    return _measure(name, F.size(x).cast("bigint"), _total(x), _squares(x), F.array_min(x), F.array_max(x))


def _bulk(slices: Column) -> Column:
    """Totals of the runs of payload packets: ``n`` runs, their ``pkts``, ``bytes`` and ``us``."""
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")

    def totals(run: Column) -> list[Column]:
        long = run["now_pkts"] >= BULK_MIN_PACKETS
        more = {"n": F.lit(1).cast("bigint"), "pkts": run["now_pkts"], "bytes": run["now_bytes"], "us": run["last"] - run["begun"]}
        return [(run[c] + F.when(long, v).otherwise(zero)).alias(c) for c, v in more.items()]

    def follow(run: Column, x: Column) -> Column:
        own = [x["data_first"].alias("begun"), x["data_last"].alias("last"), x["data"].alias("now_pkts"), x["len_sum"].alias("now_bytes")]
        joined = [run["begun"].alias("begun"), x["data_last"].alias("last"), (run["now_pkts"] + x["data"]).alias("now_pkts"),
                  (run["now_bytes"] + x["len_sum"]).alias("now_bytes"), *[run[c].alias(c) for c in ("n", "pkts", "bytes", "us")]]
        joins = F.coalesce(x["data_first"] - run["last"] <= ACTIVITY_US, F.lit(False))
        return F.when(joins, F.struct(*joined)).otherwise(F.struct(*own, *totals(run)))

    start = F.struct(*[none.alias(c) for c in ("begun", "last")], *[zero.alias(c) for c in ("now_pkts", "now_bytes", "n", "pkts", "bytes", "us")])
    return F.aggregate(F.filter(slices, lambda x: x["data"] > 0), start, follow, lambda run: F.struct(*totals(run)))


def _cut_exactly(sessions: DataFrame, idle_us: int) -> DataFrame:
    """A row a session from rows whose sorted ``slices`` may hold several."""
    s, k = F.col("slices"), F.size("slices")
    cuts = F.filter(F.sequence(F.lit(1), k), lambda i: F.get(s, i)["first"]["ts_us"] - F.get(s, i - 1)["last"] > idle_us)
    cut = sessions.withColumn("cuts", cuts)
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), "cuts"), F.concat("cuts", F.array(k)), lambda a, b: F.slice(s, a + 1, b - a))
    return cut.select(*DST_KEY, F.explode(pieces).alias("s"))


def _raw_sums(sessions: DataFrame) -> DataFrame:
    """What ``aggregate_flows`` gives for a flow, from a session's sorted slices ``s``."""
    others = F.size("s") - 1
    steps = F.zip_with(F.slice("s", 1, others), F.slice("s", 2, others), lambda a, b: F.struct(
        a["last"].alias("before"), b["first"]["ts_us"].alias("resume"), (b["first"]["ts_us"] - a["last"]).alias("gap")))
    rows = sessions.select(*DST_KEY, "s", steps.alias("steps"), _bulk(F.col("s")).alias("bulk"), *[
        _total(F.col("s")[c]).alias(c) for c in _TOTALS])
    rows = rows.withColumns({
        "first": F.col("s")[0]["first"], "flow_end_us": F.get("s", F.size("s") - 1)["last"],
        "paused": F.filter("steps", lambda x: x["gap"] > ACTIVITY_US), "step_gaps": F.col("steps")["gap"]})
    begun = F.concat(F.array(F.col("first")["ts_us"]), F.col("paused")["resume"])
    rows = rows.withColumns({
        "active": F.filter(F.zip_with("paused", begun, lambda p, b: p["before"] - b), lambda x: x > 0), "idle": F.col("paused")["gap"],
        "gap_sq": (_total(F.col("s")["gap_sq"], _EXACT) + _squares(F.col("step_gaps"))).cast(_EXACT),
        "gap_min": F.least(F.array_min(F.col("s")["gap_min"]), F.array_min("step_gaps")),
        "gap_max": F.greatest(F.array_max(F.col("s")["gap_max"]), F.array_max("step_gaps"))})
    n, span, zero = F.col("n"), F.col("flow_end_us") - F.col("first")["ts_us"], F.lit(0).cast("bigint")
    slices = F.col("s")
    return rows.select(
        *DST_KEY, F.col("first")["ts_us"].alias("fs_us"), F.col("first")["frame_no"].alias("fs_frame"),
        F.col("first")["capture_no"].alias("fs_capture"), "flow_end_us", F.lit(False).alias("was_cut"),
        F.size("paused").cast("bigint").alias("pauses"), F.col("data").alias("f_data"),
        F.array_min(slices["data_min"]).alias("f_data_min"), F.col("header").alias("f_header"), *_FLAGS,
        *[F.col("bulk")[c].alias(f"f_bulk_{c}") for c in ("n", "pkts", "bytes", "us")],
        *_measure("len", n, F.col("len_sum"), _total(slices["len_sq"], _EXACT), F.array_min(slices["len_min"]), F.array_max(slices["len_max"])),
        # the first packet counts as a gap of 0 among those of the flow, not among those of its direction
        *_measure("iat", n, span, F.col("gap_sq"), zero, F.coalesce("gap_max", zero)),
        *_measure("f_iat", n - 1, span, F.col("gap_sq"), F.col("gap_min"), F.col("gap_max")),
        *_sampled("active", "active"), *_sampled("idle", "idle"))


def session_flows(packets: DataFrame, idle_us: int = IDLE_US, as_of_us: Column | None = None) -> DataFrame:
    """The 88 columns of every idle-timeout session, of a watermarked stream (``with_event_time``) in append mode or of a table with ``ts``.

    ``as_of_us`` is the newest time of a table, for the reasons; whatever leaves a stream has timed out.
    """
    slices = second_slices(packets)
    body = [c for c in slices.columns if c not in ("at", *DST_KEY)]
    gap = f"{-(-idle_us // _SECOND)} seconds"  # packets within the idle time lie in slices so far apart at most
    sessions = slices.groupBy(F.session_window("at", gap), *DST_KEY).agg(
        F.sort_array(F.collect_list(F.struct("first", *[c for c in body if c != "first"]))).alias("slices"))
    raw = _raw_sums(_cut_exactly(sessions, idle_us))
    return flow_record(raw, False, F.lit(2**62) if as_of_us is None else as_of_us, idle_us, False)


def close_out_session_flows(packets: DataFrame, emitted: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """Sessions still open when the stream stopped, from the packets after each key's last emitted session."""
    octets = F.split("dst_ip", r"\.")
    ip = sum(octets[i].cast("bigint") * (1 << s) for i, s in enumerate((24, 16, 8, 0)))
    last = emitted.select(ip.alias("dst_ip_int"), "dst_port", "protocol", "flow_end_us").groupBy(*DST_KEY).agg(F.max("flow_end_us").alias("done_us"))
    newest = packets.select(F.max("ts_us")).scalar()
    tail = packets.join(last, DST_KEY, "left").filter(F.col("done_us").isNull() | (F.col("ts_us") > F.col("done_us"))).drop("done_us")
    return session_flows(tail.withColumn("ts", F.timestamp_micros("ts_us")), idle_us, newest)
