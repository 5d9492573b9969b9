"""Live flows: keyed state over an event-time packet stream.

Packets wait in the state until the watermark passes them, so they are folded in final order
whatever the arrival order. The state of an open flow is a fixed set of running sums; a flow is
emitted on a SYN cut, on an idle gap, or when the watermark passes its idle timeout. The output
carries the same raw sums as the batch aggregate and goes through the same record arithmetic.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.net import FLAG_BITS, TCP, is_syn_only
from flowloom.operators.deltas import ACTIVITY_US, BULK_MIN_PACKETS
from flowloom.operators.features import DIRECTIONAL_FLAGS, flow_record
from flowloom.operators.syncut import IDLE_US, SYN_THRESHOLD
from flowloom.plans.flow_plan import DST_KEY, flow_features

_MEASURES = ("len", "iat", "active", "idle", "f_iat")
_FLAG_COLUMNS = {f"f_{n.lower()}" if n in DIRECTIONAL_FLAGS else f"all_{n.lower()}": b for n, b in FLAG_BITS.items()}
_INPUT = ["ts_us", "frame_no", "capture_no", "header_len", "payload_len", "tcp_flags"]


def with_event_time(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Add ``ts`` for the watermark; packets later than ``delay`` behind the newest are dropped, and counted by the run."""
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


def _raw_schema() -> T.StructType:
    fields = [("dst_ip_int", "bigint"), ("dst_port", "int"), ("protocol", "int"), ("fs_us", "bigint"),
              ("fs_frame", "bigint"), ("fs_capture", "bigint"), ("flow_end_us", "bigint"), ("was_cut", "boolean"), ("pauses", "bigint"),
              ("f_data", "bigint"), ("f_data_min", "bigint"), ("f_header", "bigint")]
    for m in _MEASURES:
        fields += [(f"{m}_n", "bigint"), (f"{m}_sum", "bigint"), (f"{m}_var", "double"),
                   (f"{m}_min", "bigint"), (f"{m}_max", "bigint")]
    fields += [(c, "bigint") for c in _FLAG_COLUMNS]
    fields += [(f"f_bulk_{p}", "bigint") for p in ("n", "pkts", "bytes", "us")]
    return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields))


def _new_flow(ts: int, frame: int, capture: int) -> dict:
    flow = {"fs_us": ts, "fs_frame": frame, "fs_capture": capture, "flow_end_us": None, "pauses": 0, "f_data": 0, "f_data_min": None,
            "f_header": 0, "run": ts, "bulk": [0, 0, 0, 0], "open_bulk": None}
    flow.update({c: 0 for c in _FLAG_COLUMNS})
    flow.update({m: [0, 0, 0.0, None, None] for m in _MEASURES})
    return flow


def _add(acc: list, x: np.ndarray) -> None:
    """Merge samples into [count, sum, squared deviations, min, max]."""
    if not len(x):
        return
    n, total, dev, lo, hi = acc
    m, s = len(x), int(x.sum())
    spread = float(((x - s / m) ** 2).sum())
    if n:
        shift = s / m - total / n
        spread += dev + shift * shift * n * m / (n + m)
    low, high = int(x.min()), int(x.max())
    acc[:] = [n + m, total + s, spread, low if lo is None else min(lo, low), high if hi is None else max(hi, high)]


def _bulk_value(run: list) -> np.ndarray:
    n, size, first, last = run
    return np.array([1, n, size, last - first] if n >= BULK_MIN_PACKETS else [0, 0, 0, 0])


def _extend(flow: dict, rows: dict[str, np.ndarray], protocol: int) -> None:
    """Fold a block of consecutive packets of one flow."""
    ts, size = rows["ts_us"], rows["payload_len"]
    last = flow["flow_end_us"]
    gaps = np.diff(ts if last is None else np.concatenate([[last], ts]))
    before = ts[:-1] if last is None else np.concatenate([[last], ts[:-1]])
    _add(flow["iat"], gaps if last is not None else np.concatenate([[0], gaps]))
    _add(flow["f_iat"], gaps)
    _add(flow["len"], size)
    paused = gaps > ACTIVITY_US
    if paused.any():
        resumes = (before + gaps)[paused]
        begins = np.concatenate([[flow["run"]], resumes[:-1]])
        lengths = before[paused] - begins
        _add(flow["active"], lengths[lengths > 0])
        _add(flow["idle"], gaps[paused])
        flow["pauses"] += int(paused.sum())
        flow["run"] = int(resumes[-1])
    flow["f_header"] += int(rows["header_len"].sum())
    if protocol == TCP:
        for column, bit in _FLAG_COLUMNS.items():
            flow[column] += int(((rows["tcp_flags"] & bit) != 0).sum())
    data = size > 0
    if data.any():
        t, s = ts[data], size[data]
        flow["f_data"] += len(t)
        smallest = int(s.min())
        flow["f_data_min"] = smallest if flow["f_data_min"] is None else min(flow["f_data_min"], smallest)
        run = flow["open_bulk"]
        joins = run is not None and t[0] - run[3] <= ACTIVITY_US
        starts = [0, *(np.flatnonzero(np.diff(t) > ACTIVITY_US) + 1).tolist(), len(t)]
        total = np.array(flow["bulk"])
        for lo, hi in zip(starts, starts[1:]):
            block = [hi - lo, int(s[lo:hi].sum()), int(t[lo]), int(t[hi - 1])]
            if lo == 0 and joins:
                total = total - _bulk_value(run)
                block = [run[0] + block[0], run[1] + block[1], run[2], block[3]]
            total = total + _bulk_value(block)
            run = block
        flow["open_bulk"], flow["bulk"] = run, [int(v) for v in total]
    flow["flow_end_us"] = int(ts[-1])


def _raw_row(key: tuple, flow: dict, cut: bool) -> dict:
    row = dict(zip(DST_KEY, key), was_cut=cut)
    for c in ("fs_us", "fs_frame", "fs_capture", "flow_end_us", "pauses", "f_data", "f_data_min", "f_header", *_FLAG_COLUMNS):
        row[c] = flow[c]
    for m in _MEASURES:
        n, total, dev, lo, hi = flow[m]
        row.update({f"{m}_n": n, f"{m}_sum": total if n else None, f"{m}_var": dev / (n - 1) if n > 1 else None,
                    f"{m}_min": lo, f"{m}_max": hi})
    row.update(zip((f"f_bulk_{p}" for p in ("n", "pkts", "bytes", "us")), flow["bulk"]))
    return row


def _fold(key: tuple, flow: dict | None, rows: dict[str, np.ndarray], threshold: int, idle_us: int):
    """Advance over ordered packets; returns the open flow and the flows that closed."""
    protocol, closed = key[2], []
    ts, n = rows["ts_us"], len(rows["ts_us"])
    syn = np.flatnonzero(rows["is_syn"])
    breaks = np.flatnonzero(np.diff(ts) > idle_us) + 1
    at = 0
    if n and flow and ts[0] - flow["flow_end_us"] > idle_us:
        closed.append(_raw_row(key, flow, False))
        flow = None
    while at < n:
        flow = flow or _new_flow(int(ts[at]), int(rows["frame_no"][at]), int(rows["capture_no"][at]))
        k = np.searchsorted(breaks, at, side="right")
        end, cut = (int(breaks[k]) if k < len(breaks) else n), False
        k = np.searchsorted(syn, max(at, at + threshold - flow["len"][0] - 1))
        if k < len(syn) and syn[k] < end:
            end, cut = int(syn[k]) + 1, True
        _extend(flow, {c: v[at:end] for c, v in rows.items()}, protocol)
        if cut or end < n:
            closed.append(_raw_row(key, flow, cut))
            flow = None
        at = end
    return flow, closed


def stream_flows_keyed(packets: DataFrame, threshold: int = SYN_THRESHOLD, idle_us: int = IDLE_US) -> DataFrame:
    """Flow records of a watermarked packet stream (see ``with_event_time``), in append mode.

    One key is one task a trigger; ``streaming.assemble`` has the form without that limit. A closed flow leaves the state as two
    lists, its whole numbers and its spreads: pandas and Arrow take a fixed time a column for each key, and keys are many.
    """
    if "capture_no" not in packets.columns:
        packets = packets.withColumn("capture_no", F.lit(0).cast("bigint"))
    schema = _raw_schema()
    names = [*_INPUT, "is_syn"]
    whole = [f for f in schema if f.dataType.typeName() in ("long", "integer")]
    spread = [f for f in schema if f.dataType.typeName() == "double"]

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"flow": None, "wait": {c: [] for c in names}}
        waiting = {c: np.asarray(saved["wait"][c], dtype=bool if c == "is_syn" else np.int64) for c in names}
        fresh = [] if state.hasTimedOut else list(batches)
        if fresh:
            waiting = {c: np.concatenate([waiting[c], *(b[c].to_numpy() for b in fresh)]) for c in names}
        order = np.lexsort((waiting["capture_no"], waiting["frame_no"], waiting["ts_us"]))
        waiting = {c: v[order] for c, v in waiting.items()}
        now_ms = state.getCurrentWatermarkMs()
        passed = int(np.searchsorted(waiting["ts_us"], now_ms * 1000, side="right"))
        flow, closed = _fold(key, saved["flow"], {c: v[:passed] for c, v in waiting.items()}, threshold, idle_us)
        # any packet still to come is later than the watermark
        if flow and now_ms * 1000 - flow["flow_end_us"] >= idle_us:
            closed.append(_raw_row(key, flow, False))
            flow = None
        wait = {c: v[passed:].tolist() for c, v in waiting.items()}
        if flow or wait["ts_us"]:
            state.update((json.dumps({"flow": flow, "wait": wait}),))
            due = [wait["ts_us"][0]] if wait["ts_us"] else []
            due += [flow["flow_end_us"] + idle_us] if flow else []
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), now_ms + 1))
        elif state.exists:
            state.remove()
        if closed:
            lists = {n: [[row[f.name] for f in fields] for row in closed] for n, fields in (("whole", whole), ("spread", spread))}
            yield pd.DataFrame(lists | {"was_cut": [row["was_cut"] for row in closed]})

    rows = packets.select(*DST_KEY, *[F.col(c).cast("bigint") for c in _INPUT], is_syn_only().alias("is_syn"), "ts")
    packed = rows.groupBy(*DST_KEY).applyInPandasWithState(
        handle, "whole array<bigint>, spread array<double>, was_cut boolean", "state string", "append", "EventTimeTimeout")
    raw = packed.select("was_cut", *[F.col(n)[i].cast(f.dataType).alias(f.name)
                                     for n, fields in (("whole", whole), ("spread", spread)) for i, f in enumerate(fields)])
    # whatever leaves the state was cut or idle, never shut down
    return flow_record(raw, False, F.lit(2**62), idle_us, False)


def stream_sessions(packets: DataFrame, idle: str = "60 seconds") -> DataFrame:
    """Idle-timeout sessions with order-free features: built-in window and mergeable aggregates only."""
    size = F.col("payload_len")
    span = F.col("flow_end_us") - F.col("flow_start_us")
    return (
        packets.groupBy(F.session_window("ts", idle), *DST_KEY)
        .agg(F.min("ts_us").alias("flow_start_us"), F.max("ts_us").alias("flow_end_us"),
             F.count(F.lit(1)).alias("tot_fwd_pkts"), F.sum(size.cast("bigint")).alias("totlen_fwd_pkts"),
             F.sum(F.col("header_len").cast("bigint")).alias("fwd_header_len"),
             F.min(size).alias("pkt_len_min"), F.max(size).alias("pkt_len_max"),
             F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("pkt_len_std"),
             F.count_if(is_syn_only()).alias("syn_only_pkts"))
        .withColumn("flow_pkts_s", F.when(span > 0, F.col("tot_fwd_pkts") * 1e6 / span).otherwise(0.0))
        .drop("session_window")
    )


def rate_windows(packets: DataFrame, width: str = "5 seconds") -> DataFrame:
    """Packets and SYNs per destination and tumbling window, on a batch or a watermarked stream."""
    return (
        packets.groupBy(F.window("ts", width), *DST_KEY)
        .agg(F.count(F.lit(1)).alias("packets"), F.count_if(is_syn_only()).alias("syn_packets"),
             F.sum(F.col("payload_len").cast("bigint")).alias("payload_bytes"))
        .select(F.unix_micros(F.col("window.start")).alias("window_start_us"), *DST_KEY,
                "packets", "syn_packets", "payload_bytes")
    )


def close_out(packets: DataFrame, emitted: DataFrame, **options) -> DataFrame:
    """Flows the stream has not emitted when it stops, from the tail of the input.

    A key's flows are fixed from any flow start on, so only packets from the start of its last emitted flow
    are read again. Reasons are those of the batch rule: open flows are shut down.
    """
    last = emitted.select(*[F.col(c) for c in ("dst_port", "protocol")], _ip_of("dst_ip").alias("dst_ip_int"),
                          F.struct("flow_start_us", "flow_start_frame").alias("at"))
    last = last.groupBy(*DST_KEY).agg(F.max("at").alias("at"))
    newest = packets.select(F.max("ts_us")).first()[0]
    tail = packets.join(last, DST_KEY, "left").filter(F.col("at").isNull() | (F.struct("ts_us", "frame_no") >= F.col("at"))).drop("at")
    label = ["dst_ip", "dst_port", "protocol", "flow_start_us", "flow_start_frame"]
    return flow_features(tail, as_of_us=newest, **options).join(emitted.select(*label), label, "left_anti")


def _ip_of(dotted: str) -> F.Column:
    octets = F.split(dotted, r"\.")
    return sum(octets[i].cast("bigint") * (1 << s) for i, s in enumerate((24, 16, 8, 0)))


def close_out_sessions(packets: DataFrame, emitted: DataFrame, idle: str = "60 seconds") -> DataFrame:
    """Sessions still open when the stream stopped: those of packets after each key's last emitted session."""
    last = emitted.groupBy(*DST_KEY).agg(F.max("flow_end_us").alias("done_us"))
    tail = packets.join(last, DST_KEY, "left").filter(F.col("done_us").isNull() | (F.col("ts_us") > F.col("done_us"))).drop("done_us")
    return stream_sessions(tail.withColumn("ts", F.timestamp_micros("ts_us")), idle)


def close_out_rates(packets: DataFrame, emitted: DataFrame, width_us: int = 5_000_000) -> DataFrame:
    """Rate windows still open when the stream stopped: those after the last one that the watermark closed."""
    last = emitted.agg(F.max("window_start_us").alias("done_us"))  # one row
    after = F.col("done_us").isNull() | (F.col("ts_us") >= F.col("done_us") + width_us)
    tail = packets.join(F.broadcast(last)).filter(after).drop("done_us")
    return rate_windows(tail.withColumn("ts", F.timestamp_micros("ts_us")), f"{width_us} microseconds")
