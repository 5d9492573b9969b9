"""Explicit table schemas and the public names of the 88 flow columns.

Inside the library every column is snake_case; the public header names exist
only at the edges (CSV, model feature lists).
"""

from __future__ import annotations

from pyspark.sql import types as T

FRAMES = T.StructType([
    T.StructField("frame_no", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("linktype", T.IntegerType()),
    T.StructField("caplen", T.IntegerType()),
    T.StructField("raw", T.BinaryType()),
])
CAPTURED_FRAMES = T.StructType([*FRAMES.fields, T.StructField("capture_no", T.LongType())])

PACKETS = T.StructType([
    T.StructField("frame_no", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip_int", T.LongType()),
    T.StructField("dst_ip_int", T.LongType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("header_len", T.IntegerType()),
    T.StructField("payload_len", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("is_fwd", T.BooleanType()),
])

# Internal column, type, short header, cic2017 header.
FLOW_COLUMNS = [
    ("flow_id", "string", "Flow ID", "Flow ID"),
    ("src_ip", "string", "Src IP", "Src IP"),
    ("src_port", "int", "Src Port", "Src Port"),
    ("dst_ip", "string", "Dst IP", "Dst IP"),
    ("dst_port", "int", "Dst Port", "Dst Port"),
    ("protocol", "int", "Protocol", "Protocol"),
    ("timestamp", "string", "Timestamp", "Timestamp"),
    ("flow_duration", "double", "Flow Duration", "Flow Duration"),
    ("tot_fwd_pkts", "bigint", "Tot Fwd Pkts", "Total Fwd Packets"),
    ("tot_bwd_pkts", "bigint", "Tot Bwd Pkts", "Total Backward Packets"),
    ("totlen_fwd_pkts", "bigint", "TotLen Fwd Pkts", "Total Length of Fwd Packets"),
    ("totlen_bwd_pkts", "bigint", "TotLen Bwd Pkts", "Total Length of Bwd Packets"),
    ("fwd_pkt_len_max", "double", "Fwd Pkt Len Max", "Fwd Packet Length Max"),
    ("fwd_pkt_len_min", "double", "Fwd Pkt Len Min", "Fwd Packet Length Min"),
    ("fwd_pkt_len_mean", "double", "Fwd Pkt Len Mean", "Fwd Packet Length Mean"),
    ("fwd_pkt_len_std", "double", "Fwd Pkt Len Std", "Fwd Packet Length Std"),
    ("bwd_pkt_len_max", "double", "Bwd Pkt Len Max", "Bwd Packet Length Max"),
    ("bwd_pkt_len_min", "double", "Bwd Pkt Len Min", "Bwd Packet Length Min"),
    ("bwd_pkt_len_mean", "double", "Bwd Pkt Len Mean", "Bwd Packet Length Mean"),
    ("bwd_pkt_len_std", "double", "Bwd Pkt Len Std", "Bwd Packet Length Std"),
    ("flow_byts_s", "double", "Flow Byts/s", "Flow Bytes/s"),
    ("flow_pkts_s", "double", "Flow Pkts/s", "Flow Packets/s"),
    ("flow_iat_mean", "double", "Flow IAT Mean", "Flow IAT Mean"),
    ("flow_iat_std", "double", "Flow IAT Std", "Flow IAT Std"),
    ("flow_iat_max", "double", "Flow IAT Max", "Flow IAT Max"),
    ("flow_iat_min", "double", "Flow IAT Min", "Flow IAT Min"),
    ("fwd_iat_tot", "double", "Fwd IAT Tot", "Fwd IAT Total"),
    ("fwd_iat_mean", "double", "Fwd IAT Mean", "Fwd IAT Mean"),
    ("fwd_iat_std", "double", "Fwd IAT Std", "Fwd IAT Std"),
    ("fwd_iat_max", "double", "Fwd IAT Max", "Fwd IAT Max"),
    ("fwd_iat_min", "double", "Fwd IAT Min", "Fwd IAT Min"),
    ("bwd_iat_tot", "double", "Bwd IAT Tot", "Bwd IAT Total"),
    ("bwd_iat_mean", "double", "Bwd IAT Mean", "Bwd IAT Mean"),
    ("bwd_iat_std", "double", "Bwd IAT Std", "Bwd IAT Std"),
    ("bwd_iat_max", "double", "Bwd IAT Max", "Bwd IAT Max"),
    ("bwd_iat_min", "double", "Bwd IAT Min", "Bwd IAT Min"),
    ("fwd_psh_flags", "bigint", "Fwd PSH Flags", "Fwd PSH Flags"),
    ("bwd_psh_flags", "bigint", "Bwd PSH Flags", "Bwd PSH Flags"),
    ("fwd_urg_flags", "bigint", "Fwd URG Flags", "Fwd URG Flags"),
    ("bwd_urg_flags", "bigint", "Bwd URG Flags", "Bwd URG Flags"),
    ("fwd_header_len", "bigint", "Fwd Header Len", "Fwd Header Length"),
    ("bwd_header_len", "bigint", "Bwd Header Len", "Bwd Header Length"),
    ("fwd_pkts_s", "double", "Fwd Pkts/s", "Fwd Packets/s"),
    ("bwd_pkts_s", "double", "Bwd Pkts/s", "Bwd Packets/s"),
    ("pkt_len_min", "double", "Pkt Len Min", "Packet Length Min"),
    ("pkt_len_max", "double", "Pkt Len Max", "Packet Length Max"),
    ("pkt_len_mean", "double", "Pkt Len Mean", "Packet Length Mean"),
    ("pkt_len_std", "double", "Pkt Len Std", "Packet Length Std"),
    ("pkt_len_var", "double", "Pkt Len Var", "Packet Length Variance"),
    ("fin_flag_cnt", "bigint", "FIN Flag Cnt", "FIN Flag Count"),
    ("syn_flag_cnt", "bigint", "SYN Flag Cnt", "SYN Flag Count"),
    ("rst_flag_cnt", "bigint", "RST Flag Cnt", "RST Flag Count"),
    ("psh_flag_cnt", "bigint", "PSH Flag Cnt", "PSH Flag Count"),
    ("ack_flag_cnt", "bigint", "ACK Flag Cnt", "ACK Flag Count"),
    ("urg_flag_cnt", "bigint", "URG Flag Cnt", "URG Flag Count"),
    ("cwr_flag_cnt", "bigint", "CWE Flag Count", "CWR Flag Count"),
    ("ece_flag_cnt", "bigint", "ECE Flag Cnt", "ECE Flag Count"),
    ("down_up_ratio", "double", "Down/Up Ratio", "Down/Up Ratio"),
    ("pkt_size_avg", "double", "Pkt Size Avg", "Average Packet Size"),
    ("fwd_seg_size_avg", "double", "Fwd Seg Size Avg", "Fwd Segment Size Avg"),
    ("bwd_seg_size_avg", "double", "Bwd Seg Size Avg", "Bwd Segment Size Avg"),
    ("fwd_byts_b_avg", "bigint", "Fwd Byts/b Avg", "Fwd Bytes/Bulk Avg"),
    ("fwd_pkts_b_avg", "bigint", "Fwd Pkts/b Avg", "Fwd Packet/Bulk Avg"),
    ("fwd_blk_rate_avg", "bigint", "Fwd Blk Rate Avg", "Fwd Bulk Rate Avg"),
    ("bwd_byts_b_avg", "bigint", "Bwd Byts/b Avg", "Bwd Bytes/Bulk Avg"),
    ("bwd_pkts_b_avg", "bigint", "Bwd Pkts/b Avg", "Bwd Packet/Bulk Avg"),
    ("bwd_blk_rate_avg", "bigint", "Bwd Blk Rate Avg", "Bwd Bulk Rate Avg"),
    ("subflow_fwd_pkts", "bigint", "Subflow Fwd Pkts", "Subflow Fwd Packets"),
    ("subflow_fwd_byts", "bigint", "Subflow Fwd Byts", "Subflow Fwd Bytes"),
    ("subflow_bwd_pkts", "bigint", "Subflow Bwd Pkts", "Subflow Bwd Packets"),
    ("subflow_bwd_byts", "bigint", "Subflow Bwd Byts", "Subflow Bwd Bytes"),
    ("init_fwd_win_byts", "bigint", "Init Fwd Win Byts", "FWD Init Win Bytes"),
    ("init_bwd_win_byts", "bigint", "Init Bwd Win Byts", "Bwd Init Win Bytes"),
    ("fwd_act_data_pkts", "bigint", "Fwd Act Data Pkts", "Fwd Act Data Pkts"),
    ("fwd_seg_size_min", "bigint", "Fwd Seg Size Min", "Fwd Seg Size Min"),
    ("active_mean", "double", "Active Mean", "Active Mean"),
    ("active_std", "double", "Active Std", "Active Std"),
    ("active_max", "double", "Active Max", "Active Max"),
    ("active_min", "double", "Active Min", "Active Min"),
    ("idle_mean", "double", "Idle Mean", "Idle Mean"),
    ("idle_std", "double", "Idle Std", "Idle Std"),
    ("idle_max", "double", "Idle Max", "Idle Max"),
    ("idle_min", "double", "Idle Min", "Idle Min"),
    ("fwd_rst_flags", "double", "Fwd RST Flags", "Fwd RST Flags"),
    ("bwd_rst_flags", "double", "Bwd RST Flags", "Bwd RST Flags"),
    ("icmp_code", "double", "ICMP Code", "ICMP Code"),
    ("icmp_type", "double", "ICMP Type", "ICMP Type"),
    ("total_tcp_flow_time", "double", "Total TCP Flow Time", "Total TCP Flow Time"),
]
FLOW_NAMES = [name for name, _, _, _ in FLOW_COLUMNS]
SHORT_HEADERS = [short for _, _, short, _ in FLOW_COLUMNS]
CIC2017_HEADERS = [cic for _, _, _, cic in FLOW_COLUMNS]
SHORT_TO_CIC2017 = {short: cic for _, _, short, cic in FLOW_COLUMNS if short != cic}
FLOW_TYPES = {name: typ for name, typ, _, _ in FLOW_COLUMNS}

# Carried beside the 88 columns, dropped at the CSV sink.
FLOW_EXTRAS = ["flow_start_us", "flow_start_frame", "flow_start_capture", "flow_end_us", "end_reason", "sf_count"]

HEADER_STYLES = {"short": SHORT_HEADERS, "cic2017": CIC2017_HEADERS}


def flow_schema(style: str = "short") -> T.StructType:
    """Typed schema of a flow CSV written with the given header style."""
    if style not in HEADER_STYLES:
        raise ValueError(f"unknown header style {style!r}; use one of {sorted(HEADER_STYLES)}")
    parts = [f"`{header}` {typ}" for header, (_, typ, _, _) in zip(HEADER_STYLES[style], FLOW_COLUMNS)]
    return T.StructType.fromDDL(", ".join(parts))
