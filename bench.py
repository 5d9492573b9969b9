"""Headline timings: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the scale.

The flow records are also timed on a tenth of the packets, so that the time any query takes and the time a
packet takes can be told apart.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowloom.operators.decode import parse_frames  # noqa: E402
from flowloom.plans.catalog import QUERIES  # noqa: E402
from flowloom.plans.flow_plan import flow_features  # noqa: E402
from flowloom.session import build_session  # noqa: E402
from flowloom.sources.files import read_frames  # noqa: E402
from flowloom.sources.tables import frames_from_packets, packets_from_events, packets_from_lineitem  # noqa: E402

FRAMES_DIR = os.path.join(tempfile.mkdtemp(prefix="flowloom-bench-"), "frames")

HEADLINE = {
    "flow_record_events": lambda s, d: flow_features(packets_from_events(s, d)),
    "flow_record_lineitem": lambda s, d: flow_features(packets_from_lineitem(s, d)),
    "flow_record_lineitem_directional": lambda s, d: flow_features(packets_from_lineitem(s, d), directional=True,
                                                                   syn_cut=False),
    "flow_record_lineitem_hot_keys": lambda s, d: flow_features(packets_from_lineitem(s, d), chunk_rows=50_000),
    "flow_counts_lineitem": lambda s, d: flow_features(packets_from_lineitem(s, d)).select(
        "dst_ip", "dst_port", "tot_fwd_pkts", "totlen_fwd_pkts", "flow_duration"),
    "decode_lineitem_frames": lambda s, d: parse_frames(read_frames(s, FRAMES_DIR)),
    "rate_windows": QUERIES["rate_windows"],
    "top_destinations": QUERIES["top_destinations"],
    "summary_stats": QUERIES["summary_stats"],
    "bidirectional_flow_key": QUERIES["bidirectional_flow_key"],
    "stream_sessions": QUERIES["stream_sessions"],
    "stream_flows": QUERIES["stream_flows"],
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    frames = frames_from_packets(packets_from_lineitem(spark, sf_dir))
    frames.repartition(int(cpus)).write.parquet(FRAMES_DIR)  # input of the decode query, not timed
    times = {}
    for name, query in HEADLINE.items():
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    packets = packets_from_lineitem(spark, sf_dir).count()
    parts = {}
    small = packets_from_lineitem(spark, sf_dir).filter("frame_no % 10 = 0")
    for name, options in (("flow_record_lineitem", {}), ("flow_record_lineitem_hot_keys", {"chunk_rows": 50_000})):
        start = time.perf_counter()
        flow_features(small, **options).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        per_packet = max(0.0, (times[name] - took) / (0.9 * packets))
        parts[name] = {"fixed_s": round(times[name] - per_packet * packets, 2), "us_per_packet": round(per_packet * 1e6, 2)}
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "parts": parts, "packets_per_sec": round(packets / times["flow_record_lineitem"])}))
    spark.stop()


if __name__ == "__main__":
    main()
