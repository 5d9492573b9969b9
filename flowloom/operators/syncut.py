"""Early cut of SYN-flooded flows.

Inside a session the flow is closed by the first SYN-only packet at which it has at least
``threshold`` forward packets; the next packet opens a new flow. Where a flow starts thus
depends on the previous cut, which windows cannot express. Only the SYN packets that may
cut, each with its running forward count, leave the JVM; a vectorised step walks them in
order and keeps the cutting ones (at most one in ``threshold`` packets).

For keys split into chunks the rule is a small automaton: what a chunk does depends only on
how many forward packets, up to the threshold, the open flow had on entry. Each chunk yields
its exit count for every entry count, those maps are composed along the chunks of a key, and
each chunk is then cut knowing its entry count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.net import TCP, is_syn_only
from flowloom.session import durable

SYN_THRESHOLD = 50
ORDER = ["ts_us", "frame_no", "capture_no"]
IDLE_US = 60_000_000


def _sessions(packets: DataFrame, part: list[str], idle_us: int, more: tuple[str, ...] = ()) -> DataFrame:
    """TCP packets with their session number inside the partition and forward count in it; ``more`` columns pass."""
    w = Window.partitionBy(*part).orderBy(*ORDER)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = F.col("is_fwd").cast("int")
    fresh = F.col("ts_us") - F.col("prev_ts") > idle_us
    return (
        packets.filter(F.col("protocol") == TCP)
        .select(*part, *ORDER, "is_fwd", is_syn_only().alias("is_syn"), *more)
        .withColumns({"prev_ts": F.lag("ts_us").over(w), "seen": F.sum(fwd).over(running)})
        .withColumns({
            "sess": F.count(F.when(fresh, 1)).over(running),
            "base": F.coalesce(F.max(F.when(fresh, F.col("seen") - fwd)).over(running), F.lit(0)),
        })
        .select(*part, *ORDER, "is_syn", "sess", (F.col("seen") - F.col("base")).alias("pos"), *more)
    )


def _cutting_rows(candidates: DataFrame, group: list[str], threshold: int) -> DataFrame:
    """Rows of ``candidates`` (ordered inside each ``group`` by ``pos``) at which a flow is cut."""
    out_cols = [c for c in candidates.columns if c not in ("pos", "sess")]
    out_schema = T.StructType([candidates.schema[c] for c in out_cols])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, need = None, threshold
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in group]
            pos = batch.column("pos").to_numpy(zero_copy_only=False)
            moved = np.zeros(len(pos), dtype=bool)
            for values in keys:
                moved[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(moved)
            bounds = [0, *starts.tolist(), len(pos)]
            kept: list[int] = []
            for lo, hi in zip(bounds, bounds[1:]):
                this_group = tuple(values[lo] for values in keys)
                if this_group != open_group:
                    open_group, need = this_group, threshold
                i = lo + int(np.searchsorted(pos[lo:hi], need))
                while i < hi:
                    kept.append(i)
                    need = int(pos[i]) + threshold
                    i += 1 + int(np.searchsorted(pos[i + 1:hi], need))
            if kept:
                yield batch.select(out_cols).take(pa.array(kept, type=pa.int64()))

    # sessions of a key follow each other in time, so this order keeps every group together
    ordered = candidates.sortWithinPartitions(*[c for c in group if c != "sess"], *ORDER)
    return ordered.mapInArrow(cut, out_schema)


def syn_cuts(packets: DataFrame, key: list[str], threshold: int = SYN_THRESHOLD, idle_us: int = IDLE_US) -> DataFrame:
    """``(key, ts_us, frame_no, capture_no)`` of every packet that cuts its flow, keys processed whole."""
    candidates = _sessions(packets, key, idle_us).filter(F.col("is_syn") & (F.col("pos") >= threshold)).drop("is_syn")
    return _cutting_rows(candidates, key + ["sess"], threshold)


def syn_cuts_after(packets: DataFrame, key: list[str], threshold: int = SYN_THRESHOLD, idle_us: int = IDLE_US) -> DataFrame:
    """The same for keys whose flow may be open already: ``entry`` has its forward packets so far, 0 if a new flow begins."""
    rows = _sessions(packets, key, idle_us, ("entry",)).filter("is_syn")
    pos = F.col("pos") + F.when(F.col("sess") == 0, F.col("entry")).otherwise(0)
    return _cutting_rows(rows.withColumn("pos", pos).filter(F.col("pos") >= threshold).drop("is_syn", "entry"), key + ["sess"], threshold)


def syn_cuts_chunked(packets: DataFrame, key: list[str], threshold: int = SYN_THRESHOLD,
                     idle_us: int = IDLE_US, entry: DataFrame | None = None) -> DataFrame:
    """The same for packets that carry ``chunk``; ``entry`` may give the open flow before a key's first chunk
    (``key, entry_count, entry_last``: forward packets, up to the threshold, and time of the last packet); returns ``(key, chunk, ts_us, frame_no, capture_no)``."""
    part = key + ["chunk"]
    end = Window.partitionBy(*part).orderBy(*ORDER)
    rows = _sessions(packets, part, idle_us).withColumn("is_last", F.lead("ts_us").over(end).isNull())
    rows = rows.filter(F.col("is_last") | (F.col("is_syn") & ((F.col("sess") == 0) | (F.col("pos") >= threshold))))
    rows = durable(rows)

    edges = packets.filter(F.col("protocol") == TCP).groupBy(*part).agg(
        F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts"))
    exits = rows.groupBy(*part).applyInPandas(_exit_counts(part, threshold), T.StructType(
        [rows.schema[c] for c in part] + [T.StructField("exits", T.ArrayType(T.IntegerType()))]))
    walked = exits.join(edges, part)
    if entry is None:
        walked = walked.withColumns({"entry_count": F.lit(None).cast("bigint"), "entry_last": F.lit(None).cast("bigint")})
    else:
        walked = walked.join(entry, key, "left")
    entries = walked.repartition(*key).sortWithinPartitions(*part).mapInArrow(
        _compose(key, part, idle_us), T.StructType([rows.schema[c] for c in part] + [T.StructField("entry", T.LongType())]))

    known = rows.filter("is_syn").join(durable(entries), part)  # one row per chunk
    offset = F.when(F.col("sess") == 0, F.col("entry")).otherwise(F.lit(0))
    candidates = known.withColumn("pos", F.col("pos") + offset).filter(F.col("pos") >= threshold)
    candidates = candidates.select(*part, *ORDER, "sess", "pos").repartition(*part)
    return _cutting_rows(candidates, part + ["sess"], threshold)


def _exit_counts(part: list[str], threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = threshold  # a backward SYN adds nothing to the count, so the threshold itself is a state
        last_sess = pdf["sess"].max()
        tail = pdf[pdf["sess"] == last_sess]
        total = int(tail["pos"].max())
        pos = np.sort(tail.loc[tail["is_syn"], "pos"].to_numpy())
        # each SYN's next cut, doubled until it stays: the last cut after it
        n = len(pos)
        last = np.append(np.searchsorted(pos, pos + threshold), n)
        last[:n] = np.where(last[:n] < n, last[:n], np.arange(n))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        left = np.minimum(total - pos[last[:n]], top) if n else pos  # packets after the last cut
        exits = []
        for entry in range(threshold + 1):
            start = entry if last_sess == 0 else 0
            i = int(np.searchsorted(pos, threshold - start))
            exits.append(int(left[i]) if i < len(pos) else min(start + total, top))
        row = {c: [pdf[c].iloc[0]] for c in part}
        row["exits"] = [exits]
        return pd.DataFrame(row)

    return run


def _compose(key: list[str], part: list[str], idle_us: int):
    """Entry count of every chunk, from rows in order of key and chunk: one state is held, however many chunks a key has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, prev_last = None, 0, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            given = zip(*(batch.column(c).to_pylist() for c in ("first_ts", "last_ts", "entry_count", "entry_last")), strict=True)
            exits = batch.column("exits")
            entry = []
            for i, (this, (first_ts, last_ts, count, last)) in enumerate(zip(keys, given, strict=True)):
                if this != at:
                    at, state, prev_last = this, count or 0, last
                if prev_last is None or first_ts - prev_last > idle_us:
                    state = 0
                entry.append(state)
                state, prev_last = exits[i][state].as_py(), last_ts
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in part), pa.array(entry, type=pa.int64())], [*part, "entry"])

    return run
