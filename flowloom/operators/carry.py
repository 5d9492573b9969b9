"""Flow state handed from one chunk of a hot key to the next.

Each chunk is summarised to one row by plain aggregates of its window columns. The rows, one for some million
packets, are then walked by key and chunk as they stream through a task, which holds one state at a time however
many keys or chunks pass. The result, one row per chunk, says in which state the chunk begins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowloom.operators.deltas import ACTIVITY_US, DIRS


def summarise(marked: DataFrame, part: list[str], directional: bool) -> DataFrame:
    """One row per chunk from the output of ``mark(..., chunked=True)``."""
    ts, rn, packet = F.col("ts_us"), F.col("rn"), F.col("kind") == 0

    def latest(cond: Column, value: Column) -> Column:
        return F.max(F.when(cond, value))

    aggs = [
        F.min("ts_us").alias("first_ts"),
        latest(rn == 1, F.col("frame_no")).alias("first_frame"),
        latest(rn == 1, F.col("capture_no")).alias("first_capture"),
        F.max("paused").alias("paused"),
        F.max("fs_paused").alias("fs_paused"),
        F.max("ts_us").alias("last_ts"),
        (F.max_by("kind", "rn") == 1).alias("closed"),
        F.max("fs_rn").alias("fs_rn"),
        F.max("fs_us").alias("fs_us"),
        F.max_by("fs_frame", F.when(F.col("fs_rn").isNotNull(), rn)).alias("fs_frame"),
        F.max_by("fs_capture", F.when(F.col("fs_rn").isNotNull(), rn)).alias("fs_capture"),
        latest(F.col("edge"), ts).alias("edge_ts"),
    ]
    for d in DIRS if directional else DIRS[:1]:
        way = packet if not directional else packet & (F.col("is_fwd") if d == "f" else ~F.col("is_fwd"))
        data = way & (F.col("payload_len") > 0)
        opposite = F.col(f"q_{'b' if d == 'f' else 'f'}") if directional else F.lit(None).cast("bigint")
        aggs += [
            latest(way, ts).alias(f"p_{d}"), latest(way, rn).alias(f"p_rn_{d}"),
            latest(data, ts).alias(f"q_{d}"), latest(data, rn).alias(f"q_rn_{d}"),
            F.max(f"n_{d}").alias(f"n_{d}"), F.max(f"b_{d}").alias(f"b_{d}"),
            latest(F.col(f"entry_{d}"), ts).alias(f"entry_ts_{d}"),
            latest(F.col(f"entry_{d}"), opposite).alias(f"entry_other_{d}"),
        ]
        for h in ("0", "1") if directional else ("0",):
            aggs += [F.max(f"{name}_{d}{h}").alias(f"{name}_{d}{h}") for name in ("s_ts", "s_n", "s_b")]
    return marked.groupBy(*part).agg(*aggs)


#: Start of the flow that is the latest when a chunk ends.
LEFT_OPEN = ["e_fs_us", "e_fs_frame", "e_fs_capture"]


def carry_schema(part_fields: list[T.StructField], directional: bool) -> T.StructType:
    names = ["c_prev_ts", "c_fs_us", "c_fs_frame", "c_fs_capture", "c_run_prev", "c_run_in", "c_sub", *LEFT_OPEN]
    for d in DIRS if directional else DIRS[:1]:
        names += [f"c_{name}_{d}" for name in ("p", "h", "s", "n", "b", "q")]
    return T.StructType(part_fields + [T.StructField("c_state", T.StringType()), T.StructField("c_open", T.BooleanType())]
                        + [T.StructField(n, T.LongType()) for n in names])


def chunk_carry(summary: DataFrame, key: list[str], directional: bool, idle_us: int, start: DataFrame | None = None) -> DataFrame:
    """State at the start of every chunk, from the chunk summaries of each key in order.

    ``c_state`` is the state after the chunk as text, ``LEFT_OPEN`` the start of the flow it is about; ``start`` may give the
    state of an earlier stretch (``key, state``).
    """
    if start is None:
        summary = summary.withColumn("state", F.lit(None).cast("string"))
    else:
        summary = summary.join(start, key, "left")
    part = key + ["chunk"]
    schema = carry_schema([summary.schema[c] for c in part], directional)
    dirs = DIRS if directional else DIRS[:1]
    arrow_schema = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                this = [row[c] for c in key]
                if this != at:
                    at, state = this, json.loads(row["state"]) if row["state"] else None
                begin, state = _step(state, row, dirs, idle_us)
                after = zip(LEFT_OPEN, (state["fs_us"], state["fs_frame"], state["fs_capture"]), strict=True)
                out.append({**{c: row[c] for c in part}, **begin, **dict(after), "c_state": json.dumps(state)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return summary.repartition(*key).sortWithinPartitions(*part).mapInArrow(walk, schema)


def _step(state: dict | None, row: dict, dirs: tuple[str, ...], idle_us: int) -> tuple[dict, dict]:
    """Carry row for this chunk and the state after it."""
    follows = state is not None and state["open"] and row["first_ts"] - state["prev_ts"] <= idle_us
    if follows:
        paused = row["first_ts"] - state["prev_ts"] > ACTIVITY_US
        now = {"fs_us": state["fs_us"], "fs_frame": state["fs_frame"],
               "fs_capture": state["fs_capture"], "sub": state["sub"] + int(paused),
               "run": row["first_ts"] if paused else state["run"], "p": dict(state["p"]), "bulk": dict(state["bulk"])}
    else:
        now = {"fs_us": row["first_ts"], "fs_frame": row["first_frame"], "fs_capture": row["first_capture"], "sub": 1,
               "run": row["first_ts"],
               "p": dict.fromkeys(dirs), "bulk": dict.fromkeys(dirs)}
    begin = {
        "c_open": follows,
        "c_prev_ts": state["prev_ts"] if follows else None,
        "c_fs_us": now["fs_us"],
        "c_fs_frame": now["fs_frame"],
        "c_fs_capture": now["fs_capture"],
        "c_sub": now["sub"],
        "c_run_prev": state["run"] if follows else None,
        "c_run_in": now["run"],
    }
    restart = row["fs_rn"]
    bulk_before = dict(now["bulk"])
    for d in dirs:
        begin[f"c_p_{d}"] = now["p"][d]
        if row[f"p_{d}"] is not None and (restart is None or row[f"p_rn_{d}"] >= restart):
            now["p"][d] = row[f"p_{d}"]
        elif restart is not None:
            now["p"][d] = None
        begin.update(_bulk_step(now, bulk_before, row, d, "b" if d == "f" else "f"))
    if restart is not None:
        now["fs_us"], now["fs_frame"], now["fs_capture"] = row["fs_us"], row["fs_frame"], row["fs_capture"]
        now["sub"] = 1 + row["paused"] - row["fs_paused"]
    else:
        now["sub"] += row["paused"]
    if row["edge_ts"] is not None:
        now["run"] = row["edge_ts"]
    now["open"] = not row["closed"]
    now["prev_ts"] = row["last_ts"]
    return begin, now


def _bulk_step(now: dict, before: dict, row: dict, d: str, opp: str) -> dict:
    """Bulk part of the carry row for direction ``d``; updates ``now['bulk'][d]``."""
    old, entry_ts = before[d], row[f"entry_ts_{d}"]
    begun, count, size, prev, h = None, 0, 0, None, 1
    if entry_ts is not None:
        other = row[f"entry_other_{d}"]
        if other is None and before.get(opp):
            other = before[opp]["last"]
        breaks = (old is None or entry_ts - old["last"] > ACTIVITY_US
                  or (other is not None and (other > old["last"]
                                             or (other == old["last"] and old["start"] != old["last"]))))
        if breaks:
            begun = entry_ts
        else:
            begun, count, size, prev = old["start"], old["n"], old["bytes"], old["last"]
        h = int(begun == entry_ts)
    carry = {f"c_h_{d}": h, f"c_s_{d}": begun, f"c_n_{d}": count, f"c_b_{d}": size, f"c_q_{d}": prev}

    ends_in_flow = row[f"q_{d}"] is not None and (row["fs_rn"] is None or row[f"q_rn_{d}"] >= row["fs_rn"])
    if ends_in_flow:
        s_ts, s_n, s_b = (row.get(f"{name}_{d}{h}", row[f"{name}_{d}0"]) for name in ("s_ts", "s_n", "s_b"))
        if s_ts is not None:
            run = {"start": s_ts, "n": row[f"n_{d}"] - s_n + 1, "bytes": row[f"b_{d}"] - s_b}
        else:
            run = {"start": begun, "n": count + row[f"n_{d}"], "bytes": size + row[f"b_{d}"]}
        now["bulk"][d] = {**run, "last": row[f"q_{d}"]}
    elif row["fs_rn"] is not None:
        now["bulk"][d] = None
    return carry
