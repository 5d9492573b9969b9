"""Packets to flow records: the batch plan.

Usual keys: one exchange by flow key, windows, aggregate on the same partitioning.
The packets are first written once, as the narrow columns the rules need: a decode or a join before
them then runs once, however often the steps read them. One row of statistics a key tells hot keys, the
newest packet, and which keys can be cut at all.
Hot keys (see ``hotkeys``): one exchange by (key, chunk), windows, a durable write, then chunk
carries and a partial aggregate; only per-flow partial rows are exchanged again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import carry as carry_ops
from flowloom.operators.custom import FlowFeature, packet_values, value_columns
from flowloom.operators.deltas import mark, resolve
from flowloom.operators.features import aggregate_flows, flow_record
from flowloom.operators.hotkeys import key_stats, split_hot_keys
from flowloom.operators.syncut import IDLE_US, ORDER, SYN_THRESHOLD, syn_cuts, syn_cuts_chunked
from flowloom.session import durable

DST_KEY = ["dst_ip_int", "dst_port", "protocol"]
_BODY = [*ORDER, "header_len", "payload_len", "tcp_flags", "is_fwd"]


def with_cuts(packets: DataFrame, cuts: DataFrame | None, part: list[str]) -> DataFrame:
    rows = packets.select(*part, *_BODY, *value_columns(packets.columns), F.lit(0).alias("kind"))
    if cuts is None:
        return rows
    markers = cuts.select(
        *part, *ORDER, F.lit(0).alias("header_len"), F.lit(0).alias("payload_len"),
        F.lit(0).alias("tcp_flags"), F.lit(True).alias("is_fwd"), F.lit(1).alias("kind"))
    return rows.unionByName(markers, allowMissingColumns=True)


def _narrow(packets: DataFrame, key: list[str], directional: bool, features: Sequence[FlowFeature]) -> DataFrame:
    """The columns the rules read, stored. ``capture_no`` tells captures apart that number frames alike."""
    more = {}
    if not directional:
        more["is_fwd"] = F.lit(True)
    if "capture_no" not in packets.columns:
        more["capture_no"] = F.lit(0).cast("bigint")
    return durable(packets.withColumns(more).select(*key, *_BODY, *packet_values(features)))


def _deltas(packets: DataFrame, key: list[str], directional: bool, syn_cut: bool, threshold: int, idle_us: int,
            chunk_rows: int | None, features: Sequence[FlowFeature] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The parts of ``packet_deltas`` and the statistics of the keys."""
    packets = _narrow(packets, key, directional, features)
    stats = durable(key_stats(packets, key))
    split = split_hot_keys(packets, key, chunk_rows, stats)
    may_cut = stats.filter((F.col("n") >= threshold) & (F.col("n_syn") > 0)).select(*key)
    cuts = syn_cuts(split.cold.join(may_cut, key, "left_semi"), key, threshold, idle_us) if syn_cut else None
    marked = mark(with_cuts(split.cold, cuts, key), key, directional, False, idle_us)
    parts = [resolve(marked, key, directional)]
    if split.hot is not None:
        part = key + ["chunk"]
        cuts = syn_cuts_chunked(split.hot, key, threshold, idle_us) if syn_cut else None
        rows = with_cuts(split.hot, cuts, part).repartition(split.n_tasks, *part)
        marked = durable(mark(rows, part, directional, True, idle_us), "zstd")  # the widest table, a row a packet
        summary = carry_ops.summarise(marked, part, directional)
        carry = durable(carry_ops.chunk_carry(summary, key, directional, idle_us))
        parts.append(resolve(marked, key, directional, carry))
    return parts, stats


def packet_deltas(packets: DataFrame, key: list[str] | None = None, directional: bool = False, syn_cut: bool = True,
                  threshold: int = SYN_THRESHOLD, idle_us: int = IDLE_US, chunk_rows: int | None = None) -> list[DataFrame]:
    """Labelled per-packet deltas, one DataFrame for usual keys and one for hot keys if any."""
    return _deltas(packets, key or DST_KEY, directional, syn_cut, threshold, idle_us, chunk_rows)[0]


def flow_features(packets: DataFrame, key: list[str] | None = None, directional: bool = False, syn_cut: bool = True,
                  threshold: int = SYN_THRESHOLD, idle_us: int = IDLE_US, as_of_us: int | None = None,
                  chunk_rows: int | None = None, turn: Callable[[DataFrame], DataFrame] | None = None,
                  features: Sequence[FlowFeature] = ()) -> DataFrame:
    """Flow records (88 columns plus extras) of a packet table.

    ``directional=False`` is destination-keyed monitoring: every packet counts as forward.
    ``chunk_rows`` is the number of packets above which a key is processed in chunks. Packets are in order of
    time, frame number and, where the table has it, ``capture_no``. ``turn`` may rewrite the raw sums of the flows, which
    then say in ``first_fwd`` which way the first packet went. ``features`` are columns of the user's own.
    """
    key = key or DST_KEY
    parts, stats = _deltas(packets, key, directional, syn_cut, threshold, idle_us, chunk_rows, features)
    newest = stats.select(F.max("hi")).scalar()
    as_of = newest if as_of_us is None else F.greatest(newest, F.lit(as_of_us))
    records = []
    for part in parts:
        flows = aggregate_flows(part, key, directional, turn is not None, features)
        flows = turn(flows) if turn else flows
        records.append(flow_record(flows, directional, as_of, idle_us, "flow_src_ip_int" in flows.columns, features))
    return records[0] if len(records) == 1 else records[0].unionByName(records[1])
