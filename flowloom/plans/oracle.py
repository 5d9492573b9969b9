"""DuckDB statements that restate the registered queries over the same tables.

They use groups, joins and recursion where the Spark side uses running windows, so agreement is
not agreement by construction.
"""

from __future__ import annotations

from flowloom.schemas import FLOW_COLUMNS, FLOW_TYPES

KEY = "dst_ip_int, dst_port, protocol"
FLOW = f"{KEY}, sess, fno"
LABEL = f"{KEY}, fs_us, fs_frame"

EVENT_PACKETS = """
e as (select event_id, user_id, event_type, value,
    1704067200000000 + (epoch_us(ts) - 1704067200000000) // 2000 as ts_us,
    case when user_id % 2 = 0 then user_id % 8 else user_id end as dst_id from events),
p as (select event_id as frame_no, ts_us,
  cast(167772160 + (user_id * 7919 + event_id) % 65536 as bigint) as src_ip_int,
  cast(3232235776 + dst_id as bigint) as dst_ip_int,
  cast(1024 + event_id % 50000 as int) as src_port,
  cast(case when dst_id % 3 = 0 then 53 else 443 end as int) as dst_port,
  cast(case when dst_id % 5 = 0 then 17 else 6 end as int) as protocol,
  cast(case when dst_id % 5 = 0 then 28 when event_type = 'signup' then 60 else 40 end as int) as header_len,
  cast(case when event_type in ('signup', 'error') and dst_id % 5 <> 0 then 0 else floor(value * 3) end as int) as payload_len,
  cast(case when dst_id % 5 = 0 then 0 else
    case event_type when 'signup' then 2 when 'error' then 20 when 'click' then 24 when 'view' then 16 else 17 end
    + case when event_id % 11 = 0 then 32 else 0 end + case when event_id % 13 = 0 then 192 else 0 end end as int) as tcp_flags,
  (event_id * 7 + user_id) % 3 <> 0 as is_fwd
from e)"""

LINEITEM_PACKETS = """
p as (select (l_orderkey * 8 + l_linenumber) * 33554432
    + (l_partkey * 1024 + l_suppkey + cast(round(l_extendedprice * 100) as bigint) * 7) % 33554432 as frame_no,
  1704067200000000 + (l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000 as ts_us,
  cast(167772160 + l_partkey as bigint) as src_ip_int,
  cast(3232235776 + l_suppkey % 16 as bigint) as dst_ip_int,
  cast(1024 + l_partkey % 50000 as int) as src_port,
  cast(case when l_suppkey % 2 = 0 then 443 else 80 end as int) as dst_port,
  6 as protocol, 40 as header_len,
  cast(l_quantity * 10 as int) as payload_len,
  case when l_returnflag = 'R' then 2 else 16 end as tcp_flags,
  l_linenumber % 2 = 1 as is_fwd
from lineitem)"""

DOTTED = "concat_ws('.', ({0} >> 24) & 255, ({0} >> 16) & 255, ({0} >> 8) & 255, {0} & 255)"
SYN_ONLY = "(protocol = 6 and (tcp_flags & 2) <> 0 and (tcp_flags & 16) = 0)"


def r2(expr: str) -> str:
    """Two decimals with the same arithmetic in both engines."""
    return f"floor(({expr}) * 100 + 0.5) / 100"


def segmented(packets: str, syn_cut: bool = True, directional: bool = False) -> str:
    """CTEs ending in ``h``: packets with flow label, gaps and subflow number."""
    fwd = "is_fwd" if directional else "true"
    nxt = (f"min(case when {SYN_ONLY} then pos end) over (partition by {KEY}, sess order by pos "
           "rows between 49 following and unbounded following)") if syn_cut else "cast(null as bigint)"
    return f"""with recursive {packets},
s0 as (select *, {fwd} as fwd, ts_us - lag(ts_us) over (partition by {KEY} order by ts_us, frame_no) as key_gap from p),
s1 as (select *, sum(case when key_gap > 60000000 then 1 else 0 end) over
  (partition by {KEY} order by ts_us, frame_no rows unbounded preceding) as sess from s0),
s2 as (select *, row_number() over (partition by {KEY}, sess order by ts_us, frame_no) as pos from s1),
s3 as (select *, {nxt} as nxt from s2),
st(a, b, c, s, start) as (
  select {KEY}, sess, pos from s3 where pos = 1
  union all
  select a, b, c, s, nxt + 1 from st join s3 on dst_ip_int = a and dst_port = b and protocol = c and sess = s and pos = start
  where nxt is not null),
s4 as (select s3.*, start is not null as is_start from s3
  left join st on dst_ip_int = a and dst_port = b and protocol = c and sess = s and pos = start),
f as (select *, sum(case when is_start then 1 else 0 end) over
  (partition by {KEY}, sess order by pos rows unbounded preceding) as fno from s4),
g as (select *, ts_us - lag(ts_us) over wf as gap,
  ts_us - lag(ts_us) over (partition by {FLOW}, fwd order by ts_us, frame_no) as dgap,
  first_value(ts_us) over wf as fs_us, first_value(frame_no) over wf as fs_frame,
  first_value(nxt) over wf is not null as was_cut,
  row_number() over wf as flow_pos
  from f window wf as (partition by {FLOW} order by ts_us, frame_no)),
h as (select *, sum(case when gap > 1000000 then 1 else 0 end) over
  (partition by {FLOW} order by ts_us, frame_no rows unbounded preceding) as sub from g)"""


def _a0(prefix: str, value: str, where: str = "true") -> list[str]:
    x = f"case when {where} then {value} end"
    return [
        f"coalesce(sum({x}), 0)::double as {prefix}_tot",
        f"coalesce(avg({x}), 0) as {prefix}_mean",
        f"coalesce(stddev_samp({x}), 0) as {prefix}_std",
        f"coalesce(var_samp({x}), 0) as {prefix}_var",
        f"coalesce(max({x}), 0)::double as {prefix}_max",
        f"coalesce(min({x}), 0)::double as {prefix}_min",
    ]


def flows(packets: str, syn_cut: bool = True, directional: bool = False) -> str:
    """CTEs ending in ``flows``: all 88 columns and the extras."""
    agg = ["max(ts_us) as flow_end_us", "count(*) as n", "bool_or(was_cut) as was_cut", "max(sub) + 1 as sf_count",
           "sum(payload_len)::bigint as bytes"]
    agg += _a0("pkt_len", "payload_len") + _a0("flow_iat", "coalesce(gap, 0)")
    flag_bits = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}
    agg += [f"count(*) filter (protocol = 6 and (tcp_flags & {b}) <> 0) as {n}_flag_cnt" for n, b in flag_bits.items()]
    for d, way in (("fwd", "fwd"), ("bwd", "not fwd")):
        agg += [f"count(*) filter ({way}) as tot_{d}_pkts",
                f"coalesce(sum(payload_len) filter ({way}), 0)::bigint as totlen_{d}_pkts",
                f"coalesce(sum(header_len) filter ({way}), 0)::bigint as {d}_header_len"]
        agg += _a0(f"{d}_pkt_len", "payload_len", way) + _a0(f"{d}_iat0", "dgap", way)
        agg += [f"count(*) filter ({way} and protocol = 6 and (tcp_flags & {flag_bits[n]}) <> 0) as {d}_{n}_flags0"
                for n in ("psh", "urg", "rst")]
    agg += ["count(*) filter (fwd and payload_len > 0) as fwd_act_data_pkts",
            "coalesce(min(payload_len) filter (fwd and payload_len > 0), 0)::bigint as fwd_seg_size_min"]
    sql = segmented(packets, syn_cut, directional) + f""",
base as (select {LABEL}, {', '.join(agg)} from h group by {LABEL}),
runs as (select {LABEL}, sub, max(ts_us) - min(ts_us) as v from h group by {LABEL}, sub),
act as (select {LABEL}, v from (select *, max(sub) over (partition by {LABEL}) as top from runs) where sub < top and v > 0
  union all select {LABEL}, flow_end_us - fs_us from base where flow_end_us - fs_us between 1 and 120000000),
idl as (select {LABEL}, gap as v from h where gap > 1000000
  union all select {LABEL}, flow_end_us - fs_us from base where flow_end_us - fs_us > 120000000),
acts as (select {LABEL}, {', '.join(_a0('active', 'v'))} from act group by {LABEL}),
idls as (select {LABEL}, {', '.join(_a0('idle', 'v'))} from idl group by {LABEL}),
q0 as (select *, case when lag(fwd) over wq = fwd and ts_us - lag(ts_us) over wq <= 1000000 then 0 else 1 end as brk
  from h where payload_len > 0 window wq as (partition by {LABEL} order by ts_us, frame_no)),
q1 as (select *, sum(brk) over (partition by {LABEL} order by ts_us, frame_no rows unbounded preceding) as run_no from q0),
q2 as (select {LABEL}, fwd, run_no, count(*) as c, sum(payload_len) as b, max(ts_us) - min(ts_us) as u
  from q1 group by {LABEL}, fwd, run_no having count(*) >= 4),
bulk as (select {LABEL}, fwd, count(*) as bn, sum(c) as bc, sum(b) as bb, sum(u) as bu from q2 group by {LABEL}, fwd),
newest as (select max(ts_us) as as_of from p),
j as (select base.*, as_of, flow_end_us - fs_us as d,
  {', '.join(f'coalesce(acts.active_{s}, 0) as active_{s}, coalesce(idls.idle_{s}, 0) as idle_{s}' for s in ('mean', 'std', 'max', 'min'))},
  {', '.join(f'bf.{c} as f{c}, bb.{c} as b{c}' for c in ('bn', 'bc', 'bb', 'bu'))}
  from base cross join newest
  left join acts using ({LABEL}) left join idls using ({LABEL})
  left join (select * exclude (fwd) from bulk where fwd) bf using ({LABEL})
  left join (select * exclude (fwd) from bulk where not fwd) bb using ({LABEL})),
flows as (select {_record()} from j)"""
    return sql


def _record() -> str:
    dst = DOTTED.format("dst_ip_int")
    out = {c: c for c in FLOW_TYPES}
    rate = "case when d > 0 then {} * 1000000 / d else 0 end"
    out |= {
        "flow_id": f"concat_ws('-', '*', {dst}, 0, dst_port, protocol)", "src_ip": "'*'", "src_port": "0", "dst_ip": dst,
        "timestamp": "strftime(make_timestamp(fs_us), '%Y-%m-%d %H:%M:%S.%f')",
        "flow_duration": "case when d = 0 then -1.0 else d end::double",
        "flow_byts_s": rate.format("bytes"), "flow_pkts_s": rate.format("n"),
        "fwd_pkts_s": rate.format("tot_fwd_pkts"), "bwd_pkts_s": rate.format("tot_bwd_pkts"),
        "down_up_ratio": "case when totlen_fwd_pkts > 0 then totlen_bwd_pkts / totlen_fwd_pkts else 0 end",
        "pkt_size_avg": "pkt_len_mean", "fwd_seg_size_avg": "fwd_pkt_len_mean", "bwd_seg_size_avg": "bwd_pkt_len_mean",
        "init_fwd_win_byts": "0::bigint", "init_bwd_win_byts": "0::bigint",
        "icmp_code": "0.0::double", "icmp_type": "0.0::double",
        "total_tcp_flow_time": "case when protocol <> 6 then 0.0 when d = 0 then -1.0 else d end::double",
    }
    for d in ("fwd", "bwd"):
        x = d[0]
        out[f"subflow_{d}_pkts"], out[f"subflow_{d}_byts"] = f"tot_{d}_pkts // sf_count", f"totlen_{d}_pkts // sf_count"
        out[f"{d}_byts_b_avg"] = f"coalesce({x}bb // {x}bn, 0)::bigint"
        out[f"{d}_pkts_b_avg"] = f"coalesce({x}bc // {x}bn, 0)::bigint"
        out[f"{d}_blk_rate_avg"] = f"case when {x}bu > 0 then floor({x}bb / ({x}bu / 1000000)) else 0 end::bigint"
        for s in ("tot", "mean", "std", "max", "min"):
            v = f"{d}_iat0_{s}"
            out[f"{d}_iat_{s}"] = v if d == "fwd" or s == "std" else f"case when tot_bwd_pkts = 0 then -1.0 else {v} end"
        for n in ("psh", "urg", "rst"):
            out[f"{d}_{n}_flags"] = f"{d}_{n}_flags0" + ("::double" if n == "rst" else "")
    reason = ("case when was_cut then '[SYN-FLOOD]' when as_of - flow_end_us > 60000000 then '[Timeout]' "
              "else '[Shutdown]' end")
    extras = {"flow_start_us": "fs_us", "flow_start_frame": "fs_frame", "flow_start_capture": "0::bigint", "flow_end_us": "flow_end_us",
              "end_reason": reason, "sf_count": "sf_count::bigint"}
    return ", ".join(f"{v} as {k}" for k, v in {**out, **extras}.items())


def pick(columns: list[str], headers: dict[str, str] | None = None) -> str:
    """Select list over ``flows``; doubles go through ``r2``."""
    headers = headers or {}
    parts = []
    for c in columns:
        expr = r2(c) if FLOW_TYPES.get(c) == "double" else c
        parts.append(f'{expr} as "{headers.get(c, c)}"')
    return ", ".join(parts)


SHORT = {name: short for name, _, short, _ in FLOW_COLUMNS}
CIC2017 = {name: cic for name, _, _, cic in FLOW_COLUMNS}
