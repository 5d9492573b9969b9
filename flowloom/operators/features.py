"""The 88 flow columns as one aggregate over packet deltas plus arithmetic.

Aggregates keep integers exact (packets, bytes and microseconds in BIGINT); means are sums over
counts, spreads come from one mergeable variance per measure. Columns nobody selects are pruned.
Expressions are SQL text: a hundred columns then cost one analysis step each way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.net import FLAG_BITS, TCP
from flowloom.operators.custom import FlowFeature
from flowloom.schemas import FLOW_EXTRAS, FLOW_NAMES

EXPORT_IDLE_US = 120_000_000
FLOW_LABEL = ["fs_us", "fs_frame", "fs_capture"]
DIRECTIONAL_FLAGS = ("PSH", "URG", "RST")


def _measure(prefix: str, value: str) -> list[str]:
    return [
        f"count({value}) as {prefix}_n",
        f"sum(cast({value} as bigint)) as {prefix}_sum",
        f"var_samp(cast({value} as double)) as {prefix}_var",
        f"min({value}) as {prefix}_min",
        f"max({value}) as {prefix}_max",
    ]


def aggregate_flows(deltas: DataFrame, key: list[str], directional: bool, opener: bool = False,
                    features: Sequence[FlowFeature] = ()) -> DataFrame:
    """One row of raw sums per flow. Partial aggregation spreads a hot flow over all its chunks.

    With ``opener``, ``first_fwd`` tells whether the flow's first packet is a forward one.
    """
    first = "ts_us = fs_us and frame_no = fs_frame and capture_no = fs_capture"
    aggs = [f"max(if({first}, is_fwd, null)) as first_fwd"] if opener else []
    aggs += [
        "max(ts_us) as flow_end_us",
        "max(cut) as was_cut",
        "count(idle_us) as pauses",
        *_measure("len", "payload_len"), *_measure("iat", "iat_us"),
        *_measure("active", "active_us"), *_measure("idle", "idle_us"),
    ]
    for d, way in (("f", "is_fwd"), ("b", "not is_fwd"))[:2 if directional else 1]:
        if directional:
            aggs += _measure(f"{d}_len", f"if({way}, payload_len, null)")
        aggs += _measure(f"{d}_iat", f"{d}_iat_us")
        aggs += [f"count_if({way} and payload_len > 0) as {d}_data", f"min(if({way} and payload_len > 0, payload_len, null)) as {d}_data_min"]
        aggs.append(f"sum(cast(if({way}, header_len, null) as bigint)) as {d}_header")
        aggs += [f"count_if({way} and protocol = {TCP} and tcp_flags & {FLAG_BITS[flag]} <> 0) as {d}_{flag.lower()}"
                 for flag in DIRECTIONAL_FLAGS]
        aggs += [f"sum(cast({d}_bulk_{p} as bigint)) as {d}_bulk_{p}" for p in ("n", "pkts", "bytes", "us")]
    aggs += [f"count_if(protocol = {TCP} and tcp_flags & {bit} <> 0) as all_{flag.lower()}"
             for flag, bit in FLAG_BITS.items() if directional or flag not in DIRECTIONAL_FLAGS]
    aggs += [f.aggregate() for f in features]
    return deltas.groupBy(*key, *FLOW_LABEL).agg(*[F.expr(a) for a in aggs])


def _stats(prefix: str) -> dict[str, str]:
    total = f"coalesce({prefix}_sum, 0)"
    return {
        "tot": f"cast({total} as double)",
        "mean": f"coalesce(cast({total} as double) / nullif({prefix}_n, 0), 0D)",
        "var": f"coalesce({prefix}_var, 0D)",
        "std": f"sqrt(coalesce({prefix}_var, 0D))",
        "max": f"cast(coalesce({prefix}_max, 0) as double)",
        "min": f"cast(coalesce({prefix}_min, 0) as double)",
    }


def _stats_with(prefix: str, extra: str) -> dict[str, str]:
    """Statistics of a measure after adding the sample in column ``extra`` (NULL adds nothing)."""
    n, total = f"{prefix}_n", f"coalesce({prefix}_sum, 0)"
    n2 = f"({n} + if({extra} is null, 0, 1))"
    # sum of squared deviations, grown by one sample
    spread = f"coalesce({prefix}_var, 0D) * ({n} - 1)"
    shift = f"(cast({extra} as double) - cast({total} as double) / nullif({n}, 0))"
    grown = f"({spread} + coalesce({shift} * {shift} * {n} / ({n} + 1), 0D))"
    return {
        "mean": f"coalesce(cast({total} + coalesce({extra}, 0) as double) / nullif({n2}, 0), 0D)",
        "std": f"if({n2} > 1, sqrt({grown} / nullif({n2} - 1, 0)), 0D)",
        "max": f"cast(coalesce(greatest({prefix}_max, {extra}), 0) as double)",
        "min": f"cast(coalesce(least({prefix}_min, {extra}), 0) as double)",
    }


def _quotient(num: str, den: str) -> str:
    return f"if({den} > 0, cast({num} as double) / {den}, 0D)"


def _whole_quotient(num: str, den: str) -> str:
    return f"cast(if({den} > 0, cast({num} as double) / {den}, 0D) as bigint)"


def _dotted(ip: str) -> str:
    return f"concat_ws('.', {', '.join(f'cast(({ip} >> {s}) & 255 as string)' for s in (24, 16, 8, 0))})"


def record_expressions(directional: bool, source_known: bool, idle_us: int) -> dict[str, str]:
    """SQL expression of every flow column over the output of ``aggregate_flows``."""
    none = dict.fromkeys(("tot", "mean", "var", "std", "max", "min"), "0D")
    length, iat = _stats("len"), _stats("iat")
    n, everything = "len_n", "coalesce(len_sum, 0)"
    if directional:
        count = {"fwd": "f_len_n", "bwd": "b_len_n"}
        size = {"fwd": "coalesce(f_len_sum, 0)", "bwd": "coalesce(b_len_sum, 0)"}
        lengths = {"fwd": _stats("f_len"), "bwd": _stats("b_len")}
        iats = {"fwd": _stats("f_iat"), "bwd": _stats("b_iat")}
    else:
        count = {"fwd": n, "bwd": "0L"}
        size = {"fwd": everything, "bwd": "0L"}
        lengths, iats = {"fwd": length, "bwd": none}, {"fwd": _stats("f_iat"), "bwd": none}
    # no backward packet: -1 for these four, 0 for the spread
    iats["bwd"] = {k: v if k in ("std", "var") else f"if({count['bwd']} = 0, -1D, {v})" for k, v in iats["bwd"].items()}

    sf_count, span = "(pauses + 1)", "(flow_end_us - fs_us)"
    src_ip = _dotted("flow_src_ip_int") if source_known else "'*'"
    src_port = "flow_src_port" if source_known else "0"
    dst_ip = _dotted("dst_ip_int")
    duration = f"if({span} = 0, -1D, cast({span} as double))"

    def total(d: str, name: str) -> str:
        return f"coalesce({d[0]}_{name}, 0L)" if directional or d == "fwd" else "0L"

    out = {
        "flow_id": f"concat_ws('-', {src_ip}, {dst_ip}, {src_port}, dst_port, protocol)",
        "src_ip": src_ip, "src_port": src_port, "dst_ip": dst_ip, "dst_port": "dst_port", "protocol": "protocol",
        "timestamp": "date_format(timestamp_micros(fs_us), 'yyyy-MM-dd HH:mm:ss.SSSSSS')",
        "flow_duration": duration,
        "flow_byts_s": _quotient(f"{everything} * 1000000", span),
        "flow_pkts_s": _quotient(f"{n} * 1000000", span),
        "pkt_len_var": length["var"],
        "fwd_iat_tot": iats["fwd"]["tot"], "bwd_iat_tot": iats["bwd"]["tot"],
        "down_up_ratio": _quotient(size["bwd"], size["fwd"]),
        "pkt_size_avg": length["mean"],
        "init_fwd_win_byts": "0L", "init_bwd_win_byts": "0L",
        "fwd_act_data_pkts": "f_data", "fwd_seg_size_min": "cast(coalesce(f_data_min, 0) as bigint)",
        "icmp_code": "0D", "icmp_type": "0D",
        "total_tcp_flow_time": f"if(protocol = {TCP}, {duration}, 0D)",
        "flow_start_us": "fs_us", "flow_start_frame": "fs_frame", "flow_start_capture": "fs_capture", "flow_end_us": "flow_end_us",
        "end_reason": f"case when was_cut then '[SYN-FLOOD]' when as_of_us - flow_end_us > {idle_us} then '[Timeout]' "
                      "else '[Shutdown]' end",
        "sf_count": sf_count,
    }
    trailing = {"active": _stats_with("active", "trailing_active"), "idle": _stats_with("idle", "trailing_idle")}
    for stat in ("max", "min", "mean", "std"):
        out[f"pkt_len_{stat}"], out[f"flow_iat_{stat}"] = length[stat], iat[stat]
        out[f"active_{stat}"], out[f"idle_{stat}"] = trailing["active"][stat], trailing["idle"][stat]
    for d in ("fwd", "bwd"):
        out[f"tot_{d}_pkts"], out[f"totlen_{d}_pkts"] = count[d], size[d]
        out[f"{d}_pkts_s"] = _quotient(f"{count[d]} * 1000000", span)
        out[f"{d}_header_len"] = total(d, "header")
        out[f"{d}_seg_size_avg"] = lengths[d]["mean"]
        out[f"subflow_{d}_pkts"] = _whole_quotient(count[d], sf_count)
        out[f"subflow_{d}_byts"] = _whole_quotient(size[d], sf_count)
        out[f"{d}_psh_flags"], out[f"{d}_urg_flags"] = total(d, "psh"), total(d, "urg")
        out[f"{d}_rst_flags"] = f"cast({total(d, 'rst')} as double)"
        out[f"{d}_byts_b_avg"] = _whole_quotient(total(d, "bulk_bytes"), total(d, "bulk_n"))
        out[f"{d}_pkts_b_avg"] = _whole_quotient(total(d, "bulk_pkts"), total(d, "bulk_n"))
        out[f"{d}_blk_rate_avg"] = _whole_quotient(total(d, "bulk_bytes"), f"({total(d, 'bulk_us')} / 1000000D)")
        for stat in ("max", "min", "mean", "std"):
            out[f"{d}_pkt_len_{stat}"], out[f"{d}_iat_{stat}"] = lengths[d][stat], iats[d][stat]
    for flag in FLAG_BITS:
        prefix = "all" if directional or flag not in DIRECTIONAL_FLAGS else "f"
        out[f"{flag.lower()}_flag_cnt"] = f"{prefix}_{flag.lower()}"
    return out


def flow_record(flows: DataFrame, directional: bool, as_of_us: Column, idle_us: int, source_known: bool,
                features: Sequence[FlowFeature] = ()) -> DataFrame:
    """The 88 columns plus the extras, and declared features, from the raw sums of ``aggregate_flows``."""
    out = record_expressions(directional, source_known, idle_us)
    span = "(flow_end_us - fs_us)"
    # the whole flow counts once more as an active or, beyond the export limit, an idle period
    staged = flows.selectExpr(
        "*",
        f"if({span} > 0 and {span} <= {EXPORT_IDLE_US}, {span}, null) as trailing_active",
        f"if({span} > {EXPORT_IDLE_US}, {span}, null) as trailing_idle",
    ).withColumn("as_of_us", as_of_us)
    return staged.selectExpr(*[f"{out[c]} as {c}" for c in FLOW_NAMES + FLOW_EXTRAS], *[f.result() for f in features])
