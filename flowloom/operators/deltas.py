"""Per-packet deltas: what each packet adds to its flow, as window expressions.

``mark`` runs every window over one layout, ``(part) order by (ts_us, frame_no, capture_no, kind)``, so one
exchange and one sort serve them all. ``resolve`` turns the window results into additive columns.
A flow feature is then a plain aggregate of those columns.

When ``part`` is a chunk of a hot key, the state before the chunk is not known to the windows.
``resolve`` takes it from ``carry`` columns (see ``carry.py``) and needs no further window.

Bulk runs. A payload packet continues the run of its direction unless the gap to the previous one
exceeds a second or an opposite payload packet is *later* than the run's first packet. Without
equal timestamps the second test only looks at the latest opposite packet. When that packet shares
its microsecond with the previous same-direction packet ("tie"), the run breaks exactly if it
started earlier than that instant. Let x say "the run starts at the instant of its latest packet".
Each payload packet either fixes x, keeps it or flips it (a tie), so x before a packet is the last
fixed value plus the parity of the flips since: two running aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.custom import value_columns

ACTIVITY_US = 1_000_000
BULK_MIN_PACKETS = 4
DIRS = ("f", "b")


def _or(*conds: Column) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def mark(rows: DataFrame, part: list[str], directional: bool, chunked: bool, idle_us: int) -> DataFrame:
    """Add the window columns to packets (kind 0) and cut markers (kind 1)."""
    w = Window.partitionBy(*part).orderBy("ts_us", "frame_no", "capture_no", "kind")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    dirs = DIRS if directional else DIRS[:1]
    ts, rn = F.col("ts_us"), F.col("rn")
    packet = F.col("kind") == 0
    of_dir = {"f": packet & F.col("is_fwd"), "b": packet & ~F.col("is_fwd")}
    if not directional:
        of_dir["f"] = packet
    data = {d: of_dir[d] & (F.col("payload_len") > 0) for d in dirs}
    size = F.col("payload_len").cast("bigint")

    cols = {
        "prev_ts": F.lag("ts_us").over(w),
        "prev_kind": F.lag("kind").over(w),
        "rn": F.row_number().over(w).cast("bigint"),
    }
    for d in dirs:
        cols[f"n_{d}"] = F.count(F.when(data[d], 1)).over(run)
        cols[f"b_{d}"] = F.coalesce(F.sum(F.when(data[d], size)).over(run), F.lit(0))
    df = rows.withColumns(cols)

    first_row = F.lit(False) if chunked else rn == 1
    df = df.withColumn("start", packet & _or(first_row, F.col("prev_kind") == 1, ts - F.col("prev_ts") > idle_us))
    df = df.withColumn("edge", packet & _or(F.col("start"), ts - F.col("prev_ts") > ACTIVITY_US))
    start = F.col("start")
    cols = {
        "fs_rn": F.max(F.when(start, rn)).over(run),
        "fs_us": F.max(F.when(start, ts)).over(run),
        "fs_frame": F.last(F.when(start, F.col("frame_no")), ignorenulls=True).over(run),
        "fs_capture": F.last(F.when(start, F.col("capture_no")), ignorenulls=True).over(run),
        "run_start": F.max(F.when(F.col("edge"), ts)).over(past),
        "paused": F.count(F.when(packet & ~start & F.col("edge"), 1)).over(run),
    }
    for d in dirs:
        cols[f"q_{d}"] = F.max(F.when(data[d], ts)).over(past)
        cols[f"q_rn_{d}"] = F.max(F.when(data[d], rn)).over(past)
        if directional:
            cols[f"p_{d}"] = F.max(F.when(of_dir[d], ts)).over(past)
            cols[f"p_rn_{d}"] = F.max(F.when(of_dir[d], rn)).over(past)
    df = df.withColumns(cols)

    # keep a previous packet only if it belongs to the same flow
    since = F.coalesce(F.col("fs_rn"), F.lit(1))
    cols = {"fs_paused": F.max(F.when(start, F.col("paused"))).over(run)}
    for d in dirs:
        cols[f"q_{d}"] = F.when(F.col(f"q_rn_{d}") >= since, F.col(f"q_{d}"))
        if directional:
            cols[f"p_{d}"] = F.when(F.col(f"p_rn_{d}") >= since, F.col(f"p_{d}"))
    drop = [f"q_rn_{d}" for d in dirs] + [f"p_rn_{d}" for d in dirs if directional] + ["prev_kind"]
    df = df.withColumns(cols).drop(*drop)
    for d in dirs:
        df = _bulk_windows(df, d, data[d], run, past, directional, chunked)
    return df


def _bulk_windows(df: DataFrame, d: str, mine: Column, run, past, directional: bool, chunked: bool) -> DataFrame:
    ts, prev = F.col("ts_us"), F.col(f"q_{d}")
    other = F.col(f"q_{'b' if d == 'f' else 'f'}") if directional else F.lit(None).cast("bigint")
    # first payload packet of the flow that was open when the chunk began: decided in resolve()
    entry = mine & prev.isNull() & F.col("fs_rn").isNull() if chunked else F.lit(False)
    sure = mine & ~entry & _or(prev.isNull(), ts - prev > ACTIVITY_US, other > prev)
    df = df.withColumns({f"entry_{d}": entry, f"sure_{d}": sure})
    sure, entry = F.col(f"sure_{d}"), F.col(f"entry_{d}")
    hypotheses = ("0",)
    breaks = {"0": sure}
    if directional:
        tie = mine & ~sure & ~entry & _or(other == prev)
        later = ts > prev
        flip = tie & later
        df = df.withColumn(f"flips_{d}", F.count(F.when(flip, 1)).over(run))
        flips = F.col(f"flips_{d}")
        fixed = (F.when(entry, F.lit(-1)).when(sure | (tie & ~later), flips * 2 + 1)
                 .when(mine & ~tie & later, flips * 2))
        df = df.withColumn(f"fixed_{d}", F.last(fixed, ignorenulls=True).over(past))
        last_fixed = F.col(f"fixed_{d}")
        before = flips - flip.cast("int")
        hypotheses = ("0", "1") if chunked else ("0",)
        for h in hypotheses:
            x = (F.when(last_fixed == -1, F.lit(int(h)) + before)
                 .otherwise(last_fixed % 2 + before - F.expr(f"fixed_{d} div 2"))) % 2
            breaks[h] = sure | (tie & _or(x == 0))
    cols = {}
    for h in hypotheses:
        cols[f"s_ts_{d}{h}"] = F.max(F.when(breaks[h], ts)).over(run)
        cols[f"s_n_{d}{h}"] = F.max(F.when(breaks[h], F.col(f"n_{d}"))).over(run)
        cols[f"s_b_{d}{h}"] = F.max(F.when(breaks[h], F.col(f"b_{d}") - F.col("payload_len"))).over(run)
    return df.withColumns(cols)


def resolve(marked: DataFrame, key: list[str], directional: bool, carry: DataFrame | None = None) -> DataFrame:
    """Additive per-packet columns with the flow label ``(key, fs_us, fs_frame, fs_capture)``."""
    part = key + ["chunk"] if carry is not None else key
    df = marked.join(carry, part) if carry is not None else marked
    ts, rn, size = F.col("ts_us"), F.col("rn"), F.col("payload_len").cast("bigint")
    packet = F.col("kind") == 0
    fwd = F.col("is_fwd") if directional else F.lit(True)
    before_start = F.col("fs_rn").isNull()

    def known(value: Column, carried: str) -> Column:
        return F.coalesce(value, F.col(carried)) if carry is not None else value

    if carry is not None:
        head = rn == 1
        start = F.col("start") | (head & packet & ~F.col("c_open"))
        prev_ts = F.when(head, F.col("c_prev_ts")).otherwise(F.col("prev_ts"))
        run_start = F.when(head, F.col("c_run_prev")).otherwise(known(F.col("run_start"), "c_run_in"))
    else:
        start, prev_ts, run_start = F.col("start"), F.col("prev_ts"), F.col("run_start")

    iat = F.when(packet, F.when(start, F.lit(0).cast("bigint")).otherwise(ts - prev_ts))
    pause = packet & ~start & _or(iat > ACTIVITY_US)
    out = {
        "fs_us": known(F.col("fs_us"), "c_fs_us"),
        "fs_frame": known(F.col("fs_frame"), "c_fs_frame"),
        "fs_capture": known(F.col("fs_capture"), "c_fs_capture"),
        "iat_us": iat,
        "active_us": F.when(pause & (prev_ts > run_start), prev_ts - run_start),
        "idle_us": F.when(pause, iat),
        "subflow_no": F.when(packet, F.when(before_start, known(F.lit(None).cast("bigint"), "c_sub") + F.col("paused"))
                             .otherwise(F.col("paused") - F.col("fs_paused") + 1)),
        "cut": F.col("kind") == 1,
        # cut markers are not packets
        "frame_no": F.when(packet, F.col("frame_no")),
        "capture_no": F.when(packet, F.col("capture_no")),
        "ts_us": F.when(packet, ts),
        "is_fwd": F.when(packet, fwd),
        "header_len": F.when(packet, F.col("header_len")),
        "payload_len": F.when(packet, F.col("payload_len")),
        "tcp_flags": F.when(packet, F.col("tcp_flags")),
    }
    for d in DIRS if directional else DIRS[:1]:
        this_way = packet & (fwd if d == "f" else ~fwd)
        if directional:
            prev_dir = F.col(f"p_{d}")
            if carry is not None:
                prev_dir = F.coalesce(prev_dir, F.when(before_start, F.col(f"c_p_{d}")))
            out[f"{d}_iat_us"] = F.when(this_way, ts - prev_dir)
        else:
            out["f_iat_us"] = F.when(packet & ~start, iat)

        def pick(name: str) -> Column:
            value = F.col(f"{name}_{d}0")
            if carry is not None and directional:
                value = F.when(F.col(f"c_h_{d}") == 1, F.col(f"{name}_{d}1")).otherwise(value)
            return value

        data = this_way & (size > 0)
        begun = known(pick("s_ts"), f"c_s_{d}")
        if carry is not None:
            pos = F.col(f"n_{d}") - F.coalesce(pick("s_n") - 1, -F.col(f"c_n_{d}"))
            run_bytes = F.col(f"b_{d}") - F.coalesce(pick("s_b"), -F.col(f"c_b_{d}"))
            prev = F.coalesce(F.col(f"q_{d}"), F.when(F.col(f"entry_{d}"), F.col(f"c_q_{d}")))
        else:
            pos = F.col(f"n_{d}") - pick("s_n") + 1
            run_bytes = F.col(f"b_{d}") - pick("s_b")
            prev = F.col(f"q_{d}")
        full, more = data & (pos == BULK_MIN_PACKETS), data & (pos > BULK_MIN_PACKETS)
        out[f"{d}_bulk_n"] = F.when(full, F.lit(1))
        out[f"{d}_bulk_pkts"] = F.when(full, F.lit(BULK_MIN_PACKETS)).when(more, F.lit(1))
        out[f"{d}_bulk_bytes"] = F.when(full, run_bytes).when(more, size)
        out[f"{d}_bulk_us"] = F.when(full, ts - begun).when(more, ts - prev)
    out |= {c: F.when(packet, F.col(c)) for c in value_columns(df.columns)}
    return df.select(*key, *[expr.alias(name) for name, expr in out.items()])
