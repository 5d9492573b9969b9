"""Hot flow keys and their even time chunks.

Flow rules are order-dependent, so packets of one key are processed in time order. A key
that holds a large share of all packets would put that share in one task. Such keys are
found first and cut into consecutive pieces ("chunks") of about ``chunk_rows`` packets
along ``(ts_us, frame_no)``; every chunk is one window partition.

The cut points come from counts per binary time slice: ``ts_us >> shift``. A slice that is
still too full is refined with a smaller shift, down to one microsecond, and then along
``frame_no``. Keys, slices and chunk numbers are tables, never lists on the driver; a key's
slices are numbered by one running sum. Chunk numbers are a function of the row alone, so a
lost task recomputes the same ones.

Each of the stacked windows holds its whole partition, so ``CHUNK_ROWS`` also bounds a task's memory: half a dozen buffers of
as many rows, each row some hundred bytes, stay in the memory of one core and aren't spilled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.net import is_syn_only
from flowloom.session import durable

CHUNK_ROWS = 250_000
TASK_ROWS = 500_000
SLICES_PER_CHUNK = 8
REFINE_BITS = 6
_SLOT = ["_by_frame", "shift", "_slice", "_round"]


@dataclass
class HotKeys:
    """Packets split by key volume; ``hot`` carries ``chunk`` and is None when no key is hot.

    ``n_tasks`` are as many as the hot packets fill with ``TASK_ROWS`` each, at most one a chunk: small chunks share a task.
    """

    cold: DataFrame
    hot: DataFrame | None
    n_chunks: int = 0
    n_tasks: int = 0


def key_stats(packets: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: packets, SYN-only packets, first and last time."""
    return packets.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_syn_only()).alias("n_syn"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))


def split_hot_keys(packets: DataFrame, key: list[str], chunk_rows: int | None = None, stats: DataFrame | None = None) -> HotKeys:
    """Separate keys with more than ``chunk_rows`` packets and number their chunks.

    ``stats`` are the ``key_stats`` of the packets, where the caller has them stored. The packets are read several times: store them if
    they are costly.
    """
    limit = chunk_rows or CHUNK_ROWS
    stats = key_stats(packets, key) if stats is None else stats
    width = (F.col("hi") - F.col("lo") + 1) / F.greatest(F.lit(1.0), F.col("n") / limit * SLICES_PER_CHUNK)
    hot = stats.filter(F.col("n") > limit).select(*key, "n", F.floor(F.log2(F.greatest(F.lit(1.0), width))).cast("long").alias("shift"))
    hot = durable(hot)
    if hot.isEmpty():
        return HotKeys(packets, None)
    n_rows = hot.agg(F.sum("n")).first()[0]
    cold = packets.join(hot.select(*key), key, "left_anti")
    rows, n_chunks = _number_chunks(packets.join(hot.drop("n"), key), key, limit)
    return HotKeys(cold, rows, n_chunks, min(n_chunks, max(packets.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS))))


def _number_chunks(rows: DataFrame, key: list[str], limit: int) -> tuple[DataFrame, int]:
    """Add ``chunk`` to rows that carry ``shift``."""
    carried = [c for c in rows.columns if c != "shift"]
    rows = rows.withColumns({"_by_frame": F.lit(False), "_slice": F.expr("ts_us >> cast(shift as int)"), "_round": F.lit(0)})
    slot, open_rows, n_round, leaves = key + _SLOT, rows, 0, None
    whole = F.col("_by_frame") & (F.col("shift") == 0)
    while True:
        counts = durable(open_rows.groupBy(*slot).agg(
            F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("lo"), F.min("frame_no").alias("flo"), F.max("frame_no").alias("fhi")))
        full = (F.col("n") > limit) & ~whole
        done = counts.filter(~full)
        leaves = done if leaves is None else leaves.union(done)
        heavy = counts.filter(full)
        if heavy.isEmpty():
            break
        # below one microsecond the order continues along frame_no
        to_frame, n_round = F.col("shift") == 0, n_round + 1
        frame_bits = F.length(F.bin(F.col("fhi") - F.col("flo"))) - REFINE_BITS
        finer = F.when(to_frame, frame_bits).otherwise(F.col("shift") - REFINE_BITS)
        table = heavy.select(*slot, (F.col("_by_frame") | to_frame).alias("next_by_frame"),
                             F.greatest(F.lit(0), finer).cast("long").alias("next_shift"))
        rows = _refine(rows, table, slot, n_round)
        open_rows = _refine(open_rows, table, slot, n_round).filter(F.col("_round") == n_round)

    so_far = Window.partitionBy(*key).orderBy("lo", "flo").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("n").over(so_far), F.lit(0)) / limit).cast("long")
    leaves = durable(leaves.select(*slot, chunk.alias("chunk")))
    n_chunks = leaves.select(*key, "chunk").distinct().count()
    return rows.join(leaves, slot).select(*carried, "chunk"), n_chunks


def _refine(rows: DataFrame, table: DataFrame, slot: list[str], n_round: int) -> DataFrame:
    others = [c for c in rows.columns if c not in _SLOT]
    hit = F.col("next_shift").isNotNull()
    finer = F.expr("(case when next_by_frame then frame_no else ts_us end) >> cast(next_shift as int)")
    return rows.join(table, slot, "left").select(
        *others, F.coalesce("next_by_frame", "_by_frame").alias("_by_frame"), F.coalesce("next_shift", "shift").alias("shift"),
        F.when(hit, finer).otherwise(F.col("_slice")).alias("_slice"),
        F.when(hit, F.lit(n_round)).otherwise(F.col("_round")).alias("_round"))
