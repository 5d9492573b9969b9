"""Every registered query: the Spark job and, where SQL can say it, its DuckDB restatement."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.functions.stats import summary_stats as stats_by
from flowloom.operators import columns as col_ops
from flowloom.operators import decode, detect, filters
from flowloom.operators.custom import FlowFeature
from flowloom.operators.orient import bidirectional_features, bidirectional_flow_key
from flowloom.plans import oracle as O
from flowloom.plans.flow_plan import DST_KEY, flow_features, packet_deltas
from flowloom.schemas import CIC2017_HEADERS, FLOW_NAMES, FLOW_TYPES, SHORT_HEADERS
from flowloom.session import durable, scratch_path
from flowloom.sources import captures, files, tables
from flowloom.streaming import flows as live
from flowloom.streaming.assemble import FlowAssembler, run_flow_stream, stop_flow_stream
from flowloom.streaming.run import drain, stream_table
from flowloom.streaming.sessions import close_out_session_flows, session_flows

Query = Callable[[SparkSession, str], DataFrame]
ID = ["dst_ip", "dst_port", "protocol", "flow_start_us", "flow_start_frame"]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
events, lineitem = tables.packets_from_events, tables.packets_from_lineitem


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def r2(c: str | F.Column) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 100 + 0.5) / 100


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[r2(c).alias(c) if FLOW_TYPES.get(c) == "double" else F.col(c) for c in columns])


def stat(prefix: str, names: tuple[str, ...] = ("max", "min", "mean", "std")) -> list[str]:
    return [f"{prefix}_{n}" for n in names]


# ---- packets -------------------------------------------------------------------------------

PACKET_SQL = {"events": f"with {O.EVENT_PACKETS} ", "lineitem": f"with {O.LINEITEM_PACKETS} "}


def packet_query(name: str, build: Callable[[DataFrame], DataFrame], select: str) -> None:
    register(name, lambda spark, sf: build(events(spark, sf)), PACKET_SQL["events"] + select)


PACKET_LIST = ("frame_no, ts_us, src_ip_int, dst_ip_int, src_port, dst_port, protocol, header_len, payload_len, "
               "tcp_flags, is_fwd")
packet_query("packets_from_table", lambda p: p, f"select {PACKET_LIST} from p")
register("packets_from_lineitem", lineitem, PACKET_SQL["lineitem"] + f"select {PACKET_LIST} from p")
packet_query("host_filter", lambda p: filters.host_filter(p, "192.168.1.2"),
             f"select {PACKET_LIST} from p where {O.DOTTED.format('src_ip_int')} = '192.168.1.2' "
             f"or {O.DOTTED.format('dst_ip_int')} = '192.168.1.2'")
packet_query("ipv4_tcp_udp_only",
             lambda p: filters.ipv4_tcp_udp_only(p.withColumn("protocol", F.expr("cast(if(frame_no % 3 = 0, frame_no % 20, protocol) as int)"))),
             f"select * from (select {PACKET_LIST.replace(' protocol,', ' cast(case when frame_no % 3 = 0 then frame_no % 20 else protocol end as int) as protocol,')}"
             " from p) where protocol in (6, 17)")
packet_query("is_syn_only", lambda p: p.select("frame_no", net.is_syn_only().alias("is_syn_only")),
             f"select frame_no, {O.SYN_ONLY} as is_syn_only from p")
packet_query("int_to_ip", lambda p: p.select("frame_no", net.int_to_ip("src_ip_int").alias("src_ip"),
                                             net.int_to_ip("dst_ip_int").alias("dst_ip")),
             f"select frame_no, {O.DOTTED.format('src_ip_int')} as src_ip, {O.DOTTED.format('dst_ip_int')} as dst_ip from p")
packet_query("ip_to_int",
             lambda p: p.select("frame_no", net.ip_to_int(F.unhex(F.lpad(F.hex("dst_ip_int"), 8, "0"))).alias("ip_int")),
             "select frame_no, dst_ip_int as ip_int from p")
NAMES_SQL = "list_filter([{}], lambda x: x is not null)".format(", ".join(
    f"case when (tcp_flags & {net.FLAG_BITS[n]}) <> 0 then '{n}' end" for n in net.FLAG_NAME_ORDER))
packet_query("tcp_flag_names",
             lambda p: p.select("frame_no", F.array_join(net.tcp_flag_names("tcp_flags"), ",").alias("names")),
             f"select frame_no, coalesce(array_to_string({NAMES_SQL}, ','), '') as names from p")
TIME_SQL = "strftime(make_timestamp(ts_us), '%H:%M:%S.%f')"
packet_query("format_hhmmss_us", lambda p: p.select("frame_no", net.format_hhmmss_us("ts_us").alias("time")),
             f"select frame_no, {TIME_SQL} as time from p")
ROUTE = [f"concat({O.DOTTED.format(ip)}, ':', {port})" for ip, port in
         (("src_ip_int", "src_port"), ("dst_ip_int", "dst_port"))]
packet_query("packet_summary", lambda p: p.select("frame_no", net.packet_summary().alias("line")), f"""
    select frame_no, concat_ws(' ', printf('%6d', frame_no), printf('%-15s', {TIME_SQL}),
      printf('%-45s', concat({ROUTE[0]}, ' -> ', {ROUTE[1]})),
      printf('%-4s', case protocol when 6 then 'TCP' when 17 then 'UDP' else cast(protocol as varchar) end),
      printf('%5d', payload_len),
      case when protocol = 6 then case when tcp_flags = 0 then '[.]'
          else concat('[', array_to_string({NAMES_SQL}, ', '), ']') end
        when tcp_flags = 0 then '[.]' else printf('[0x%02x]', tcp_flags) end) as line from p""")
packet_query("packet_debug_line", lambda p: p.select("frame_no", net.packet_debug_line().alias("line")), f"""
    select frame_no, concat('[PKT] ', {ROUTE[0]}, ' → ', {ROUTE[1]}, ' proto=', protocol, ' len=', payload_len,
      ' flags=', tcp_flags) as line from p""")


# ---- frames --------------------------------------------------------------------------------

def frames(spark: SparkSession, sf: str) -> DataFrame:
    return tables.frames_from_packets(events(spark, sf))


# How a good frame is damaged (by packet number modulo their count) and the error that results.
DAMAGE = [
    ("ethertype_not_ipv4", 1, "unhex(concat('02000000000102000000000286DD', hex(substring(raw, 15, 60))))"),
    ("ethernet_short", 1, "substring(raw, 1, 13)"),
    ("vlan_short", 1, "unhex('0200000000010200000000028100000A08')"),
    ("ip_short", 12, "substring(raw, 1, 19)"),
    ("ihl_invalid", 12, "unhex(concat('44', hex(substring(raw, 2, 60))))"),
    ("total_len_too_small", 12, "unhex(concat('4500001B', hex(substring(raw, 5, 60))))"),
    ("sll_short", 113, "unhex('000000010006020000000001000008')"),
    ("sll_not_ipv4", 113, "unhex(concat('000000010006020000000001000086DD', hex(substring(raw, 1, 60))))"),
    ("loopback_short", 0, "substring(raw, 1, 3)"),
    ("ip_options_short", 12, "unhex(concat('4F', hex(substring(raw, 2, 19))))"),
    ("tcp_short", 12, "unhex('450000320000000040060000C0A80005C0A8010204D200500000000000000000501820')"),
    ("tcp_offset_invalid", 12, "unhex('450000320000000040060000C0A80005C0A8010204D2005000000000000000004018200000000000')"),
    ("udp_short", 12, "unhex('450000240000000040110000C0A80005C0A8010204D20035001000')"),
    ("protocol_unsupported", 12, "unhex('450000320000000040010000C0A80005C0A8010204D2005000000000000000005018200000000000')"),
    ("", 12, "raw"),
]
DAMAGE_KIND = f"frame_no % {len(DAMAGE)}"


def damaged_frames(spark: SparkSession, sf: str) -> DataFrame:
    bare = decode.strip_l2(frames(spark, sf)).selectExpr("frame_no", "ts_us", "substring(raw, ip_at + 1, 200) as raw")
    link = f"case {DAMAGE_KIND} " + " ".join(f"when {i} then {link}" for i, (_, link, _) in enumerate(DAMAGE)) + " end"
    raw = f"case {DAMAGE_KIND} " + " ".join(f"when {i} then {sql}" for i, (_, _, sql) in enumerate(DAMAGE)) + " end"
    return bare.selectExpr("frame_no", "ts_us", f"{link} as linktype", f"{raw} as raw").withColumn("caplen", F.length("raw"))


DAMAGE_SQL = f"case {DAMAGE_KIND} " + " ".join(
    f"when {i} then '{error}'" for i, (error, _, _) in enumerate(DAMAGE) if error) + " end"
register("parse_frames", lambda s, sf: decode.decode_packets(frames(s, sf)).drop("is_fwd"),
         PACKET_SQL["events"] + f"select {PACKET_LIST.replace(', is_fwd', '')} from p")
register("strip_l2", lambda s, sf: decode.strip_l2(frames(s, sf)).selectExpr("frame_no", "ip_at", "l2_error is null as ok"),
         PACKET_SQL["events"] + """select frame_no, case when frame_no % 8 = 0 then 18 when frame_no % 8 = 4 then 14
            when frame_no % 4 = 1 then 0 when frame_no % 4 = 2 then 16 else 4 end as ip_at, true as ok from p""")
register("quarantine_bad_frames", lambda s, sf: decode.quarantine_bad_frames(damaged_frames(s, sf))
         .select("frame_no", "parse_error"),
         PACKET_SQL["events"] + f"select frame_no, {DAMAGE_SQL} as parse_error from p where {DAMAGE_KIND} < {len(DAMAGE) - 1}")
register("parse_error_counts", lambda s, sf: decode.parse_frames(damaged_frames(s, sf)).groupBy("parse_error")
         .agg(F.count(F.lit(1)).alias("n")),
         PACKET_SQL["events"] + f"select {DAMAGE_SQL} as parse_error, count(*) as n from p group by 1")


def frames_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "frames")
    frames(spark, sf).write.parquet(path)
    return decode.decode_packets(files.read_frames(spark, path)).drop("is_fwd", "capture_no")


register("read_frames", frames_round_trip, ORACLES["parse_frames"])


def captured(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of two capture files, each numbered from 1, read in ranges of 8 kB."""
    folder, rows = scratch_path(spark, "captures"), frames(spark, sf)
    for n, part in enumerate((rows.filter("frame_no % 8 = 0"), rows.filter("frame_no % 8 = 4"))):
        captures.write_captures(part.repartition(1).sortWithinPartitions("ts_us", "frame_no"), folder, name=str(n))
    return decode.decode_packets(captures.read_captures(spark, folder, 8192)).drop("is_fwd")


CAPTURED = O.EVENT_PACKETS.replace("\np as", "\np0 as") + """,
p as (select * replace (row_number() over (partition by frame_no % 8 order by ts_us, frame_no) * 2 + frame_no % 8 // 4 as frame_no)
    from p0 where frame_no % 4 = 0)"""
register("read_captures", captured, f"""with {CAPTURED} select {PACKET_LIST.replace(', is_fwd', '').replace('frame_no', 'frame_no // 2 as frame_no')},
    frame_no % 2 as capture_no from p""")


# ---- addresses and names -------------------------------------------------------------------

ADDRESS_SQL = """case event_id % 8 when 0 then '' when 1 then '  ' when 2 then concat('1.2.', user_id % 300)
  when 3 then concat('256.1.1.', user_id % 256) when 4 then concat('01.2.3.', user_id % 256)
  when 5 then '0.0.0.0' else concat(' 10.0.0.', user_id % 300, ' ') end"""
ALLOWED_SQL = "select distinct concat('10.0.0.', s_suppkey % 128) as ip from {}"


def validate_ip(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", f"{ADDRESS_SQL} as addr")
    allowed = spark.sql(ALLOWED_SQL.format("{t}"), t=spark.read.parquet(f"{sf}/supplier.parquet"))
    return filters.validate_ip(rows, "addr", allowed).select("event_id", "status")


register("validate_ip", validate_ip, f"""
    with a as (select event_id, trim({ADDRESS_SQL}) as addr from events),
    ok as ({ALLOWED_SQL.format('supplier')}),
    x as (select *, string_split(addr, '.') as o from a)
    select event_id, case when addr = '' then 'empty'
      when len(o) <> 4 or not list_bool_and([try_cast(v as int) between 0 and 255 and v = cast(try_cast(v as int) as varchar) for v in o])
        then 'malformed'
      when addr = '0.0.0.0' then 'wildcard' when addr in (select ip from ok) then 'ok' else 'not_allowed' end as status
    from x""")


def endpoint_names(packets: DataFrame) -> DataFrame:
    name = net.endpoint("dst_ip_int", "dst_port")
    return packets.groupBy(name.alias("name")).agg(F.min("frame_no").alias("pos")).select("pos", "name")


NAMES_OF = f"select min(frame_no) as pos, concat({O.DOTTED.format('dst_ip_int')}, ':', dst_port) as name from {{}} group by 2"
register("schema_diff",
         lambda s, sf: col_ops.schema_diff_table(endpoint_names(events(s, sf)), endpoint_names(lineitem(s, sf))), f"""
    with {O.EVENT_PACKETS}, {O.LINEITEM_PACKETS.replace('p as', 'p2 as', 1)},
    a as ({NAMES_OF.format('p')}), b as ({NAMES_OF.format('p2')})
    select 'missing' as side, pos, name from b where name not in (select name from a)
    union all select 'extra', pos, name from a where name not in (select name from b)""")
register("distinct_sources",
         lambda s, sf: events(s, sf).select("src_ip_int", "dst_ip_int").dropDuplicates(),
         PACKET_SQL["events"] + "select distinct src_ip_int, dst_ip_int from p")


# ---- flows ---------------------------------------------------------------------------------

SOURCES = {"events": (events, O.EVENT_PACKETS), "lineitem": (lineitem, O.LINEITEM_PACKETS)}


def flow_query(name: str, columns: list[str], source: str = "events", directional: bool = False,
               syn_cut: bool = True, **options) -> None:
    """Identity plus ``columns`` of every flow."""
    packets, sql = SOURCES[source]
    wanted = ID + [c for c in columns if c not in ID]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        flows = flow_features(packets(spark, sf), directional=directional, syn_cut=syn_cut, **options)
        return rounded(flows, wanted)

    register(name, run, O.flows(sql, syn_cut, directional) + f" select {O.pick(wanted)} from flows")


DIR_FLAGS = [f"{d}_{n}_flags" for d in ("fwd", "bwd") for n in ("psh", "urg", "rst")]
FLAG_COUNTS = [f"{n}_flag_cnt" for n in ("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece")]
COUNTS = ["tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "fwd_header_len", "bwd_header_len"]
BULK = [f"{d}_{n}_avg" for d in ("fwd", "bwd") for n in ("byts_b", "pkts_b", "blk_rate")]
ACTIVE_IDLE = stat("active") + stat("idle")
FULL = FLOW_NAMES + ["flow_start_us", "flow_start_frame", "flow_end_us", "end_reason", "sf_count"]
both = {"directional": True, "syn_cut": False}

flow_query("flow_key", ["src_ip", "src_port", "tot_fwd_pkts"])
flow_query("idle_timeout", ["flow_end_us", "tot_fwd_pkts"], syn_cut=False)
flow_query("syn_flush", ["flow_end_us", "tot_fwd_pkts", "end_reason"])
flow_query("syn_flush_lineitem", ["flow_end_us", "tot_fwd_pkts", "end_reason"], "lineitem")
flow_query("end_reason", ["end_reason"])
flow_query("flow_id", ["flow_id", "timestamp"])
flow_query("direction", COUNTS, **both)
flow_query("flow_counts", COUNTS)
flow_query("pkt_len_stats", stat("fwd_pkt_len") + stat("bwd_pkt_len") + stat("pkt_len") + ["pkt_len_var"], **both)
flow_query("flow_iat", stat("flow_iat"))
flow_query("dir_iat", stat("fwd_iat", ("tot", "mean", "std", "max", "min"))
           + stat("bwd_iat", ("tot", "mean", "std", "max", "min")), **both)
flow_query("tcp_flag_counts", FLAG_COUNTS + DIR_FLAGS, **both)
flow_query("flow_rates", ["flow_byts_s", "flow_pkts_s", "fwd_pkts_s", "bwd_pkts_s"], **both)
flow_query("ratios_segments", ["down_up_ratio", "pkt_size_avg", "fwd_seg_size_avg", "bwd_seg_size_avg"], **both)
flow_query("subflows", ["sf_count"] + [f"subflow_{d}_{n}" for d in ("fwd", "bwd") for n in ("pkts", "byts")], **both)
flow_query("active_idle", ACTIVE_IDLE)
flow_query("bulk", BULK)
flow_query("bulk_directional", BULK, **both)
flow_query("data_pkts_segmin", ["fwd_act_data_pkts", "fwd_seg_size_min"])
flow_query("duration", ["flow_duration", "flow_end_us"])
flow_query("compat_constants", ["init_fwd_win_byts", "init_bwd_win_byts", "icmp_code", "icmp_type", "total_tcp_flow_time"])
flow_query("flow_record", FULL)
CAPTURE_ID = ["flow_start_frame", "flow_start_capture"]
register("capture_flows", lambda s, sf: rounded(flow_features(captured(s, sf)), FULL + ["flow_start_capture"]),
         O.flows(CAPTURED) + f" select {O.pick([c for c in FULL if c not in CAPTURE_ID])}, "
         "flow_start_frame // 2 as flow_start_frame, flow_start_frame % 2 as flow_start_capture from flows")
flow_query("flow_record_directional", FULL, **both)
flow_query("flow_record_lineitem", FULL, "lineitem")
flow_query("flow_record_hot_keys", FULL, "lineitem", chunk_rows=1500)
flow_query("flow_record_hot_keys_directional", FULL, chunk_rows=400, **both)


def exported(spark: SparkSession, sf: str, style: str) -> DataFrame:
    table = col_ops.select_features(flow_features(events(spark, sf)), "short")
    table = col_ops.rename_features(table, style)
    headers = SHORT_HEADERS if style == "short" else CIC2017_HEADERS
    return table.select(*[(r2(col_ops.quoted(h)) if FLOW_TYPES[n] == "double" else col_ops.quoted(h)).alias(h)
                          for n, h in zip(FLOW_NAMES, headers)])


FLOWS_SQL = O.flows(O.EVENT_PACKETS)
register("flow_features_short", partial(exported, style="short"), FLOWS_SQL + f" select {O.pick(FLOW_NAMES, O.SHORT)} from flows")
register("flow_features_cic2017", partial(exported, style="cic2017"),
         FLOWS_SQL + f" select {O.pick(FLOW_NAMES, O.CIC2017)} from flows")


def delta_query(columns: list[str], **options) -> Query:
    """Per-packet columns of usual and hot keys together, cut markers left out."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts = packet_deltas(events(spark, sf), **options)
        rows = reduce(DataFrame.unionByName, [p.select("frame_no", *columns) for p in parts])
        return rows.filter("frame_no is not null")

    return run


register("packet_deltas", delta_query(["fs_us", "fs_frame", "iat_us", "active_us", "idle_us"]), O.segmented(O.EVENT_PACKETS) + f""",
    ends as (select {O.LABEL}, sub + 1 as sub, max(ts_us) - min(ts_us) as v from h group by {O.LABEL}, sub)
    select frame_no, fs_us, fs_frame, coalesce(gap, 0) as iat_us,
      case when gap > 1000000 and v > 0 then v end as active_us, case when gap > 1000000 then gap end as idle_us
    from h left join ends using ({O.LABEL}, sub)""")


BULK_DELTAS = ["f_bulk_n", "f_bulk_pkts", "f_bulk_bytes", "f_bulk_us"]


def dir_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = delta_query(["f_iat_us", "b_iat_us"], directional=True, syn_cut=False)(spark, sf)
    return rows.select("frame_no", F.coalesce("f_iat_us", "b_iat_us").alias("dir_iat_us"))


register("w_session", delta_query(["fs_us", "fs_frame"], syn_cut=False),
         O.segmented(O.EVENT_PACKETS, False) + " select frame_no, fs_us, fs_frame from h")
register("w_lag_iat", delta_query(["iat_us"]), O.segmented(O.EVENT_PACKETS) + " select frame_no, coalesce(gap, 0) as iat_us from h")
register("w_dir_iat", dir_gaps, O.segmented(O.EVENT_PACKETS, False, True) + " select frame_no, dgap as dir_iat_us from h")
register("w_subflow_no", delta_query(["subflow_no"]),
         O.segmented(O.EVENT_PACKETS) + " select frame_no, (sub + 1)::bigint as subflow_no from h")
register("w_bulk_run", delta_query(BULK_DELTAS), O.segmented(O.EVENT_PACKETS) + f""",
    b0 as (select *, ts_us - lag(ts_us) over wb as since, case when ts_us - lag(ts_us) over wb <= 1000000 then 0 else 1 end as brk
      from h where payload_len > 0 window wb as (partition by {O.LABEL} order by ts_us, frame_no)),
    b1 as (select *, sum(brk) over (partition by {O.LABEL} order by ts_us, frame_no rows unbounded preceding) as run_no from b0),
    b2 as (select *, row_number() over wr as nth, sum(payload_len) over wr as so_far, min(ts_us) over wr as begun
      from b1 window wr as (partition by {O.LABEL}, run_no order by ts_us, frame_no))
    select frame_no, case when nth = 4 then 1 end as f_bulk_n, case when nth = 4 then 4 when nth > 4 then 1 end as f_bulk_pkts,
      case when nth = 4 then so_far::bigint when nth > 4 then payload_len end as f_bulk_bytes,
      case when nth = 4 then ts_us - begun when nth > 4 then since end as f_bulk_us
    from h left join (select frame_no, nth, so_far, begun, since from b2) using (frame_no)""")


def top_destinations(spark: SparkSession, sf: str) -> DataFrame:
    flows = flow_features(events(spark, sf))
    per = flows.groupBy("dst_ip", "dst_port", "protocol").agg(
        F.sum(F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")).alias("packets"),
        F.count(F.lit(1)).alias("flows"), F.count_if(F.col("end_reason") == "[SYN-FLOOD]").alias("syn_floods"))
    return per.orderBy(F.desc("packets"), "dst_ip", "dst_port", "protocol").limit(10)


register("top_destinations", top_destinations, FLOWS_SQL + """
    select dst_ip, dst_port, protocol, sum(tot_fwd_pkts + tot_bwd_pkts)::bigint as packets, count(*) as flows,
      count(*) filter (end_reason = '[SYN-FLOOD]') as syn_floods from flows group by 1, 2, 3
    order by packets desc, dst_ip, dst_port, protocol limit 10""")


def summary_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = stats_by(lineitem(spark, sf), ["dst_port", "tcp_flags"], "payload_len")
    return out.select("dst_port", "tcp_flags", "count", "sum", *[r2(c).alias(c) for c in ("mean", "variance", "std")], "min", "max")


register("summary_stats", summary_stats, PACKET_SQL["lineitem"] + f"""
    select dst_port, tcp_flags, count(payload_len) as count, coalesce(sum(payload_len), 0)::double as sum,
      {O.r2('coalesce(avg(payload_len), 0)')} as mean, {O.r2('coalesce(var_samp(payload_len), 0)')} as variance,
      {O.r2('coalesce(stddev_samp(payload_len), 0)')} as std, min(payload_len)::double as min,
      max(payload_len)::double as max from p group by 1, 2""")


def rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    return live.rate_windows(events(spark, sf).withColumn("ts", F.timestamp_micros("ts_us")))


RATE_SQL = PACKET_SQL["events"] + f"""
    select ts_us // 5000000 * 5000000 as window_start_us, {O.KEY}, count(*) as packets,
      count(*) filter ({O.SYN_ONLY}) as syn_packets, sum(payload_len)::bigint as payload_bytes from p group by 1, 2, 3, 4"""
register("rate_windows", rate_windows, RATE_SQL)


def bidirectional(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bidirectional_features(wide_pairs(events(spark, sf))), FULL)


def wide_pairs(packets: DataFrame) -> DataFrame:
    """Conversations between a source port and its server, both ways round by ``is_fwd``."""
    a, b = ("src_ip_int", "src_port"), ("dst_ip_int", "dst_port")
    port = (F.col("src_port") % 5 + 1024).cast("int")
    host = F.col("src_ip_int") % 3 + 167772160
    flip = ~F.col("is_fwd")
    swapped = {x: F.when(flip, y).otherwise(z) for x, y, z in (
        (a[0], F.col(b[0]), host), (a[1], F.col(b[1]), port), (b[0], host, F.col(b[0])), (b[1], port, F.col(b[1])))}
    return packets.withColumns(swapped)


# pairs under one number each way round, oriented by the session's first packet
BI_PACKETS = O.EVENT_PACKETS.replace("\np as", "\np0 as") + """,
p1 as (select * exclude (src_ip_int, src_port, dst_ip_int, dst_port),
    src_ip_int % 3 + 167772160 as h, cast(src_port % 5 + 1024 as int) as hp, dst_ip_int as sv, dst_port as svp from p0),
p2 as (select * exclude (is_fwd), h * 4294967296 + sv as dst_ip_int, hp * 65536 + svp as dst_port,
    case when is_fwd then h else sv end as src_ip_int, case when is_fwd then hp else svp end as src_port,
    case when is_fwd then sv else h end as to_ip, case when is_fwd then svp else hp end as to_port from p1),
p3 as (select *, coalesce(ts_us - lag(ts_us) over w > 60000000, false) as fresh
    from p2 window w as (partition by dst_ip_int, dst_port, protocol order by ts_us, frame_no)),
p4 as (select *, sum(fresh::int) over (partition by dst_ip_int, dst_port, protocol order by ts_us, frame_no rows unbounded preceding) as s from p3),
p as (select * exclude (fresh, s), src_ip_int = first_value(src_ip_int) over (
    partition by dst_ip_int, dst_port, protocol, s order by ts_us, frame_no) as is_fwd from p4)"""


def oriented_record(columns: list[str]) -> str:
    """Select list of the flow's columns with the ends of its first packet ``o``."""
    si, di = O.DOTTED.format("o.src_ip_int"), O.DOTTED.format("o.to_ip")
    ends = {"flow_id": f"concat_ws('-', {si}, {di}, o.src_port, o.to_port, f.protocol)", "src_ip": si, "src_port": "o.src_port",
            "dst_ip": di, "dst_port": "o.to_port", "protocol": "f.protocol"}
    return ", ".join(f"{ends[c]} as {c}" if c in ends else O.pick([c]) for c in columns)


BI_SQL = (O.flows(BI_PACKETS, False, True)
          + f" select {oriented_record(FULL)} from flows f join p o on o.frame_no = f.flow_start_frame")
register("bidirectional_flow_key", bidirectional, BI_SQL)


def oriented_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Each packet with the ends of its flow, as the flow's first packet has them."""
    return bidirectional_flow_key(wide_pairs(events(spark, sf))).drop("capture_no")


register("oriented_packets", oriented_packets, f"""with {BI_PACKETS}
    select frame_no, ts_us, case when is_fwd then src_ip_int else to_ip end as flow_src_ip_int,
      case when is_fwd then src_port else to_port end as flow_src_port, case when is_fwd then to_ip else src_ip_int end as dst_ip_int,
      case when is_fwd then to_port else src_port end as dst_port, protocol, header_len, payload_len, tcp_flags, is_fwd from p""")


# ---- model frames and files ----------------------------------------------------------------

MODEL_COLUMNS = ["tot_fwd_pkts", "flow_byts_s", "fwd_header_len", "syn_flag_cnt", "flow_iat_mean", "pkt_len_mean", "idle_max"]
MODEL_SOURCES = {dict(zip(FLOW_NAMES, CIC2017_HEADERS))[c]: c for c in MODEL_COLUMNS}
MODEL_FEATURES = list(MODEL_SOURCES)


def prepare_features(spark: SparkSession, sf: str) -> DataFrame:
    table = col_ops.prepare_features(col_ops.select_features(flow_features(events(spark, sf))), MODEL_FEATURES)
    return table.select(*[(r2(col_ops.quoted(n)) if FLOW_TYPES[c] == "double" else col_ops.quoted(n)).alias(n)
                          for n, c in MODEL_SOURCES.items()])


register("prepare_features", prepare_features, FLOWS_SQL + " select " + O.pick(
    list(MODEL_SOURCES.values()), {c: n for n, c in MODEL_SOURCES.items()}) + " from flows")
register("prepare_features_long_names",
         lambda s, sf: col_ops.prepare_features(col_ops.select_features(flow_features(events(s, sf)), "cic2017"), MODEL_FEATURES)
         .select(*[(r2(col_ops.quoted(n)) if FLOW_TYPES[c] == "double" else col_ops.quoted(n)).alias(n) for n, c in MODEL_SOURCES.items()]),
         FLOWS_SQL + " select " + O.pick(list(MODEL_SOURCES.values()), {c: n for n, c in MODEL_SOURCES.items()}) + " from flows")
register("resolve_aliases",
         lambda s, sf: col_ops.resolve_aliases(
             flow_features(events(s, sf)).select(*ID, "tot_fwd_pkts"), {"pkts": "Total", "Total": "tot_fwd_pkts"}),
         FLOWS_SQL + f" select {', '.join(ID)}, tot_fwd_pkts, tot_fwd_pkts as \"Total\", tot_fwd_pkts as pkts from flows")


def csv_round_trip(spark: SparkSession, sf: str, style: str = "short") -> DataFrame:
    first, second = scratch_path(spark, "csv"), scratch_path(spark, "csv-renamed")
    files.write_flow_csv(flow_features(events(spark, sf)), first)
    if style == "short":
        return rounded(files.read_flow_csv(spark, first, "short").toDF(*FLOW_NAMES), FLOW_NAMES)
    files.rename_flow_csv(spark, first, second, style)
    return rounded(files.read_flow_csv(spark, second, style).toDF(*FLOW_NAMES), FLOW_NAMES)


ALL_SQL = FLOWS_SQL + f" select {O.pick(FLOW_NAMES)} from flows"
register("write_flow_csv", csv_round_trip, ALL_SQL)
register("rename_flow_csv", partial(csv_round_trip, style="cic2017"), ALL_SQL)


# ---- detection -----------------------------------------------------------------------------

TRAIN_FEATURES = ["protocol", "tot_fwd_pkts", "totlen_fwd_pkts", "flow_pkts_s", "syn_flag_cnt", "pkt_len_mean", "flow_iat_mean"]
HELD_OUT = "flow_start_us % 5 = 0"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Flows, stored, with a label that the features can tell: UDP or not."""
    return durable(flow_features(events(spark, sf)).withColumn("label", (F.col("protocol") == 17).cast("int")))


def fitted(rows: DataFrame) -> detect.FlowModel:
    return detect.train_flow_model(rows.filter(f"not ({HELD_OUT})"), TRAIN_FEATURES, "label")


def score_flows(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf)
    scored = detect.add_verdict(detect.score_flows(rows, fitted(rows)))
    return scored.select(*ID, "label", "verdict")


def train_flow_model(spark: SparkSession, sf: str) -> DataFrame:
    """Labels against verdicts on flows that the model hasn't seen."""
    rows = labelled(spark, sf)
    scored = detect.add_verdict(detect.score_flows(rows.filter(HELD_OUT), fitted(rows)))
    return scored.groupBy("label", "verdict").agg(F.count(F.lit(1)).alias("flows"))


VERDICT_SQL = "case when protocol = 17 then 'DDoS' else 'Normal' end as verdict"
LABEL_SQL = "(protocol = 17)::int as label"
register("train_flow_model", train_flow_model, FLOWS_SQL
         + f" select {LABEL_SQL}, {VERDICT_SQL}, count(*) as flows from flows where {HELD_OUT} group by 1, 2")
register("score_flows", score_flows, FLOWS_SQL + f" select {', '.join(ID)}, {LABEL_SQL}, {VERDICT_SQL} from flows")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    # a stand-in probability from the SYN share, so that the rule itself can be checked in SQL
    flows = flow_features(events(spark, sf))
    proba = F.col("syn_flag_cnt") / (F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")) * 4
    packets = (F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")) * 10
    return flows.select(*ID, detect.verdict(proba, packets).alias("verdict"),
                        detect.verdict(proba, packets, True).alias("verdict_with_rate"))


# Whether a flow is an attack here hangs on two features at once.
ATTACK_SQL = "flow_iat_mean < 13000000 and pkt_len_mean > 70"
ACCURATE = 0.9


def flow_model_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out flows of both labels, whether the model is right on ``ACCURATE`` of them at least, and its probabilities' range."""
    rows = durable(flow_features(events(spark, sf)).withColumn("label", F.expr(f"cast({ATTACK_SQL} as int)")))
    scored = detect.add_verdict(detect.score_flows(rows.filter(HELD_OUT), fitted(rows)))
    right = (F.col("verdict") == "DDoS") == (F.col("label") == 1)
    return scored.agg(F.count("*").alias("flows"), F.sum("label").alias("attacks"), (F.avg(right.cast("int")) >= ACCURATE).alias("accurate"),
                      (F.min("proba") >= 0).alias("from_0"), (F.max("proba") <= 1).alias("to_1"),
                      (F.count_if(F.col("verdict") == "DDoS").between(1, F.count("*") - 1)).alias("both_verdicts"))


register("flow_model_accuracy", flow_model_accuracy, FLOWS_SQL + f"""
    select count(*) as flows, sum(({ATTACK_SQL})::int)::bigint as attacks, true as accurate, true as from_0, true as to_1, true as both_verdicts
    from flows where {HELD_OUT}""")
register("verdict", verdicts, FLOWS_SQL + f"""
    select {', '.join(ID)},
      case when syn_flag_cnt / tot_fwd_pkts * 4 > 0.5 then 'DDoS' else 'Normal' end as verdict,
      case when syn_flag_cnt / tot_fwd_pkts * 4 > 0.5 then 'DDoS' when tot_fwd_pkts * 10 > 2000 then 'Warning'
        else 'Normal' end as verdict_with_rate from flows""")


# ---- streams -------------------------------------------------------------------------------

def packet_stream(spark: SparkSession, sf: str) -> DataFrame:
    table = stream_table(spark, sf, "events.parquet", spark.read.parquet(f"{sf}/events.parquet").schema)
    return live.with_event_time(tables.packets_from_table(table, tables.EVENT_PACKETS_SQL, "events"))


WATERMARK = "(select (max(ts_us) - 10000000) // 1000 * 1000 from p)"
CLOSED_BY_NOW = f"flow_end_us + 60000000 <= {WATERMARK}"
# a live flow is out once the watermark has passed its cut or its idle timeout
EMITTED = f"({CLOSED_BY_NOW} or (end_reason = '[SYN-FLOOD]' and flow_end_us <= {WATERMARK}))"


def tidy_sessions(out: DataFrame) -> DataFrame:
    return out.withColumns({"pkt_len_std": r2("pkt_len_std"), "flow_pkts_s": r2("flow_pkts_s")})


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return tidy_sessions(drain(live.stream_sessions(packet_stream(spark, sf))))


def sessions_close_out(spark: SparkSession, sf: str) -> DataFrame:
    closed = drain(live.stream_sessions(packet_stream(spark, sf)))
    return tidy_sessions(live.close_out_sessions(events(spark, sf), closed))


SESSIONS_SQL = O.segmented(O.EVENT_PACKETS, False) + f""",
    r as (select {O.KEY}, min(ts_us) as flow_start_us, max(ts_us) as flow_end_us, count(*) as tot_fwd_pkts,
      sum(payload_len)::bigint as totlen_fwd_pkts, sum(header_len)::bigint as fwd_header_len,
      min(payload_len) as pkt_len_min, max(payload_len) as pkt_len_max,
      coalesce(stddev_samp(payload_len), 0) as sd, count(*) filter ({O.SYN_ONLY}) as syn_only_pkts
      from h group by {O.FLOW})
    select * exclude (sd), {O.r2('sd')} as pkt_len_std,
      {O.r2('case when flow_end_us > flow_start_us then tot_fwd_pkts * 1000000 / (flow_end_us - flow_start_us) else 0 end')}
      as flow_pkts_s from r where """
register("stream_sessions", stream_sessions, SESSIONS_SQL + CLOSED_BY_NOW)
register("sessions_close_out", sessions_close_out, SESSIONS_SQL + f"not ({CLOSED_BY_NOW})")

# Spark's session window holds the one-second slices that lie up to 60 apart: such sessions leave together
SESSION_FLOWS_SQL = O.flows(O.EVENT_PACKETS, False) + f''',
    apart as (select *, flow_start_us // 1000000 - lag(flow_end_us // 1000000) over (partition by dst_ip, dst_port, protocol order by flow_start_us)
      as seconds from flows),
    together as (select *, sum(case when seconds <= 60 then 0 else 1 end) over
      (partition by dst_ip, dst_port, protocol order by flow_start_us rows unbounded preceding) as part from apart),
    leaving as (select *, (max(flow_end_us) over (partition by dst_ip, dst_port, protocol, part) // 1000000 + 61) * 1000000 - 1 <= {WATERMARK}
      as gone from together)
    select {O.pick(FULL)} from leaving where '''


def stream_session_flows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drain(session_flows(packet_stream(spark, sf))), FULL)


def session_flows_close_out(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(close_out_session_flows(events(spark, sf), drain(session_flows(packet_stream(spark, sf)))), FULL)


def session_flows_table(spark: SparkSession, sf: str, packets: Callable = lineitem) -> DataFrame:
    table = packets(spark, sf)
    return rounded(session_flows(table.withColumn("ts", F.timestamp_micros("ts_us")), as_of_us=table.select(F.max("ts_us")).scalar()), FULL)


register("stream_session_flows", stream_session_flows, SESSION_FLOWS_SQL + "gone")
register("session_flows_close_out", session_flows_close_out, SESSION_FLOWS_SQL + "not gone")
register("session_flows_lineitem", session_flows_table, O.flows(O.LINEITEM_PACKETS, False) + f" select {O.pick(FULL)} from flows")


def assembler(spark: SparkSession, **options) -> FlowAssembler:
    return FlowAssembler(spark, scratch_path(spark, "live-state"), scratch_path(spark, "live-flows"), **options)


def assembled(spark: SparkSession, packets: DataFrame, **options) -> FlowAssembler:
    """A flow stream run to the end of its input."""
    run = assembler(spark, **options)
    run_flow_stream(packets, run, scratch_path(spark, "live-checkpoint"), {"availableNow": True}).awaitTermination()
    return run


def live_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Packets to verdicts in one live run, with a stop and a new start between its batches, closed out at the end."""
    folder, checkpoint, model, target = (scratch_path(spark, n) for n in ("live-packets", "live-checkpoint", "model", "verdicts"))
    fitted(labelled(spark, sf)).save(model)
    run = assembler(spark)
    for numbers in (range(2), range(2, 3)):
        in_files(events(spark, sf), folder, THIRD.format("div"), numbers)
        sink = detect.VerdictSink(spark, model, target)
        run = FlowAssembler(spark, run.state, run.target, then=sink)
        run_flow_stream(file_stream(spark, folder), run, checkpoint, {"availableNow": True}).awaitTermination()
    run.close_out()
    return sink.verdicts().select(*ID, "verdict")


def stream_flows(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream itself has put out at the end of its input."""
    return rounded(assembled(spark, packet_stream(spark, sf)).emitted(), FULL)


def close_out(spark: SparkSession, sf: str) -> DataFrame:
    """Flows still open then, finished from the state the stream has kept."""
    run = assembled(spark, packet_stream(spark, sf))
    return rounded(run.close_out(), FULL)


def stream_flows_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drain(live.stream_flows_keyed(packet_stream(spark, sf))), FULL)


def keyed_close_out(spark: SparkSession, sf: str) -> DataFrame:
    closed = drain(live.stream_flows_keyed(packet_stream(spark, sf)))
    return rounded(live.close_out(events(spark, sf), closed), FULL)


def flooded(packets: DataFrame) -> DataFrame:
    """Three of five packets go to one destination."""
    hot = F.expr("frame_no % 5 < 3")
    return packets.withColumns({c: F.when(hot, F.lit(v)).otherwise(F.col(c)).cast(packets.schema[c].dataType).alias(c)
                                for c, v in (("dst_ip_int", 3232235777), ("dst_port", 80), ("protocol", 6))})


def stream_flows_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a flooded destination, in three batches, hot keys of each batch in chunks."""
    folder = scratch_path(spark, "live-packets")
    flooded(events(spark, sf)).repartitionByRange(3, "ts_us").sortWithinPartitions("ts_us").write.parquet(folder)
    parts = sorted(spark.read.parquet(folder).select(F.col("_metadata.file_path")).distinct().toPandas()["file_path"])  # three files
    step = scratch_path(spark, "live-steps")
    for n, part in enumerate(parts):
        spark.read.parquet(part).coalesce(1).write.parquet(f"{step}/step={n}")
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(f"{step}/*")
    return rounded(assembled(spark, stream, chunk_rows=1500).emitted(), FULL)


def stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Captured frames as they arrive, decoded and assembled to flows."""
    folder = scratch_path(spark, "live-frames")
    frames(spark, sf).repartition(4).write.parquet(folder)
    packets = decode.decode_packets(files.read_frames(spark, folder, streaming=True))
    return rounded(assembled(spark, packets).emitted(), FULL)


def in_files(packets: DataFrame, folder: str, part: str, numbers: range) -> None:
    """Adds the packets of each part, in turn, as one file of a folder that a stream reads file by file."""
    for n in numbers:
        packets.filter(f"{part} = {n}").repartition(1).write.mode("append").parquet(folder)


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


THIRD, HALF = (f"(ts_us - 1704067200000000) {{}} {us}" for us in (432_000_000, 648_000_000))


def two_way(spark: SparkSession, sf: str) -> FlowAssembler:
    """Conversations of both directions, live in three batches, closed out at the end."""
    folder = scratch_path(spark, "live-packets")
    in_files(wide_pairs(events(spark, sf)).drop("is_fwd"), folder, THIRD.format("div"), range(3))
    run = assembled(spark, file_stream(spark, folder), two_way=True)
    run.close_out()
    return run


def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """A stream on a clock: two files, a stop, a third file to a new run on the same state, a stop that closes out."""
    folder, checkpoint, run = scratch_path(spark, "live-packets"), scratch_path(spark, "live-checkpoint"), assembler(spark)
    for numbers in (range(2), range(2, 3)):
        in_files(events(spark, sf), folder, THIRD.format("div"), numbers)
        run = FlowAssembler(spark, run.state, run.target)
        query = run_flow_stream(file_stream(spark, folder), run, checkpoint, {"processingTime": "1 second"})
        query.processAllAvailable()
        if 2 in numbers:
            stop_flow_stream(query, run)
        else:
            query.stop()
            query.awaitTermination()
    return rounded(run.emitted(closed_out=True), FULL)


LATE_PART = f"case when frame_no % 97 = 0 then 1 else {HALF} end"


def late_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Packets that come a file too late, behind the watermark of the first file."""
    folder = scratch_path(spark, "live-packets")
    in_files(events(spark, sf), folder, LATE_PART.format("div"), range(2))
    run = assembled(spark, file_stream(spark, folder))
    return run.late_packets().select(*DST_KEY, "frame_no", "ts_us", "behind_us", "reason")


LATE_SQL = PACKET_SQL["events"][:-1] + f""", t as (select *, {LATE_PART.format('//')} as part from p),
    m as (select (max(ts_us) - 10000000) // 1000 * 1000 as passed from t where part = 0)
    select {O.KEY}, frame_no, ts_us, passed - ts_us as behind_us, 'behind_watermark' as reason from t, m where part = 1 and ts_us <= passed"""


FLOOD_PACKETS = O.EVENT_PACKETS.replace("\np as", "\np0 as") + """,
p as (select * replace (case when frame_no % 5 < 3 then 3232235777 else dst_ip_int end as dst_ip_int,
    (case when frame_no % 5 < 3 then 80 else dst_port end)::int as dst_port,
    (case when frame_no % 5 < 3 then 6 else protocol end)::int as protocol) from p0)"""
register("stream_flows_hot", stream_flows_hot, O.flows(FLOOD_PACKETS) + f" select {O.pick(FULL)} from flows where {EMITTED}")
register("stream_flows_keyed", stream_flows_keyed, FLOWS_SQL + f" select {O.pick(FULL)} from flows where {EMITTED}")
register("keyed_close_out", keyed_close_out, FLOWS_SQL + f" select {O.pick(FULL)} from flows where not {EMITTED}")
register("stream_flows", stream_flows, FLOWS_SQL + f" select {O.pick(FULL)} from flows where {EMITTED}")
register("stream_frames_flows", stream_frames, FLOWS_SQL + f" select {O.pick(FULL)} from flows where {EMITTED}")
register("stream_flows_two_way", lambda spark, sf: two_way(spark, sf).emitted(closed_out=True).transform(rounded, FULL), BI_SQL)
register("stream_restart", stream_restart, FLOWS_SQL + f" select {O.pick(FULL)} from flows")
register("late_packets", late_packets, LATE_SQL)
register("close_out", close_out, FLOWS_SQL + f" select {O.pick(FULL)} from flows where not {EMITTED}")


def stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    return drain(live.rate_windows(packet_stream(spark, sf)))


def rates_close_out(spark: SparkSession, sf: str) -> DataFrame:
    return live.close_out_rates(events(spark, sf), stream_rates(spark, sf))


OPEN_RATES = f"window_start_us + 5000000 > {WATERMARK}"
ALL_RATES = PACKET_SQL["events"] + f"select * from ({RATE_SQL[len(PACKET_SQL['events']):]}) where "
register("stream_rate_windows", stream_rates, ALL_RATES + f"not ({OPEN_RATES})")
register("rates_close_out", rates_close_out, ALL_RATES + OPEN_RATES)


def live_csv(spark: SparkSession, sf: str) -> str:
    """A folder of flow CSV files, written by a stream."""
    folder, state = scratch_path(spark, "live-csv"), scratch_path(spark, "live-state")
    closed = live.stream_flows_keyed(packet_stream(spark, sf))
    files.stream_flows_csv(closed, folder, state).trigger(availableNow=True).start().awaitTermination()
    return folder


def stream_flow_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The live CSV folder read as a stream, and after it the flows of the close-out in a folder of their own."""
    folder = live_csv(spark, sf)
    done = drain(files.stream_flow_csv(spark, folder).toDF(*FLOW_NAMES))
    started = done.withColumns({"flow_start_us": F.unix_micros(F.col("timestamp").cast("timestamp"))})
    open_ = flow_features(events(spark, sf)).join(started.select("flow_id", "flow_start_us"), ["flow_id", "flow_start_us"], "left_anti")
    added = scratch_path(spark, "shutdown-csv")
    files.write_flow_csv(open_, added)
    return rounded(done.union(drain(files.stream_flow_csv(spark, added).toDF(*FLOW_NAMES))), FLOW_NAMES)


register("stream_flow_csv", stream_flow_csv, ALL_SQL)
register("stream_flows_csv", lambda spark, sf: rounded(drain(files.stream_flow_csv(spark, live_csv(spark, sf)).toDF(*FLOW_NAMES)), FLOW_NAMES),
         FLOWS_SQL + f" select {O.pick(FLOW_NAMES)} from flows where {EMITTED}")

CSV_DAMAGE = ("case frame % 7 when 1 then concat(line, ',1') when 2 then regexp_replace(line, ',[^,]*$', '') "
              "when 3 then regexp_replace(line, ',[^,]*$', ',seven') else line end")


def damaged_csv(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Flow CSV lines, some with a cell more, a cell less or a cell of another type, and how the reader splits them."""
    flows, folder = flow_features(events(spark, sf)), scratch_path(spark, "damaged-csv")
    texts = F.concat_ws(",", *[F.col(n).cast("string") for n in FLOW_NAMES]).alias("line")
    rows = flows.select(F.col("flow_start_frame").alias("frame"), texts).selectExpr("1 as place", f"{CSV_DAMAGE} as line")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("line"), F.lit(parts)))
    header = spark.range(parts).select(F.lit(0).alias("place"), F.lit(",".join(SHORT_HEADERS)).alias("line"), F.col("id").alias("part"))
    # a header leads each file, and each part that a file is made of
    header.unionByName(rows).repartition("part").sortWithinPartitions("place").select("line").write.text(folder)
    return files.split_flow_csv(spark, folder)


register("split_flow_csv", lambda spark, sf: rounded(damaged_csv(spark, sf)[0].toDF(*FLOW_NAMES), FLOW_NAMES),
         FLOWS_SQL + f" select {O.pick(FLOW_NAMES)} from flows where flow_start_frame % 7 not in (1, 2, 3)")
register("rejected_flow_rows", lambda spark, sf: damaged_csv(spark, sf)[1].groupBy("reason").agg(F.count("*").alias("n")),
         FLOWS_SQL + """ select case when flow_start_frame % 7 = 3 then 'cell_type' else 'cell_count' end as reason, count(*) as n from flows
         where flow_start_frame % 7 in (1, 2, 3) group by 1""")


def stream_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf)
    folder = scratch_path(spark, "scored-csv")
    files.write_flow_csv(rows, folder)
    stream = files.stream_flow_csv(spark, folder).toDF(*FLOW_NAMES)
    scored = detect.add_verdict(detect.score_flows(stream, fitted(rows))).select("flow_id", "timestamp", "tot_fwd_pkts", "verdict")
    return drain(scored)


register("live_verdicts", live_verdicts, FLOWS_SQL + f" select {', '.join(ID)}, {VERDICT_SQL} from flows")
register("stream_verdicts", stream_verdicts,
         FLOWS_SQL + f" select flow_id, timestamp, tot_fwd_pkts, {VERDICT_SQL} from flows")


# ---- features of the user's own ------------------------------------------------------------

OWN_FEATURES = [
    FlowFeature("src_ports", "src_port", "distinct", "int"),
    FlowFeature("sources", "src_ip_int", "distinct"),
    FlowFeature("small_pkts", "if(payload_len between 1 and 299, 1, null)", "count", "int"),
    FlowFeature("least_src_port", "if(payload_len > 0, src_port, null)", "min", "int"),
    FlowFeature("largest_pkt", "header_len + payload_len", "max"),
    FlowFeature("mean_pkt", "header_len + payload_len", "sum", record="{value} div {packets}"),
]
OWN_COLUMNS = ID + [f.name for f in OWN_FEATURES] + ["tot_fwd_pkts"]
OWN_SQL = f""" select {O.DOTTED.format('dst_ip_int')} as dst_ip, dst_port, protocol, fs_us as flow_start_us, fs_frame as flow_start_frame,
  count(distinct src_port) as src_ports, count(distinct src_ip_int) as sources,
  count(*) filter (payload_len between 1 and 299) as small_pkts, min(src_port) filter (payload_len > 0) as least_src_port,
  max(header_len + payload_len)::bigint as largest_pkt, (sum(header_len + payload_len) // count(*))::bigint as mean_pkt, count(*) as tot_fwd_pkts
  from h group by {O.LABEL}"""


def own_features(spark: SparkSession, sf: str, chunk_rows: int | None = None) -> DataFrame:
    return flow_features(events(spark, sf), chunk_rows=chunk_rows, features=OWN_FEATURES).select(*OWN_COLUMNS)


def own_features_live(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream in three batches, closed out."""
    folder = scratch_path(spark, "live-packets")
    in_files(events(spark, sf), folder, THIRD.format("div"), range(3))
    run = assembled(spark, file_stream(spark, folder), features=OWN_FEATURES)
    run.close_out()
    return run.emitted(closed_out=True).select(*OWN_COLUMNS)


register("own_features", own_features, O.segmented(O.EVENT_PACKETS) + OWN_SQL)
register("own_features_hot", partial(own_features, chunk_rows=1500), O.segmented(O.EVENT_PACKETS) + OWN_SQL)
register("own_features_live", own_features_live, O.segmented(O.EVENT_PACKETS) + OWN_SQL)
