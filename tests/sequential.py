"""Packet-at-a-time restatement of the flow rules, the brute-force side of the property tests."""

import statistics


def _spread(samples):
    n = len(samples)
    return {
        "tot": float(sum(samples)), "mean": sum(samples) / n if n else 0.0,
        "std": statistics.stdev(samples) if n > 1 else 0.0, "var": statistics.variance(samples) if n > 1 else 0.0,
        "max": float(max(samples)) if n else 0.0, "min": float(min(samples)) if n else 0.0,
    }


def cut_into_flows(packets, key, directional, syn_cut=True, threshold=50, idle_us=60_000_000):
    """packets: dicts; returns [(packets of one flow, was it cut)]."""
    open_flows, done = {}, []
    for p in sorted(packets, key=lambda p: (p["ts_us"], p["frame_no"])):
        k = tuple(p[c] for c in key)
        flow = open_flows.get(k)
        if flow and p["ts_us"] - flow[-1]["ts_us"] > idle_us:
            done.append((open_flows.pop(k), False))
            flow = None
        if flow is None:
            flow = open_flows[k] = []
        flow.append(p)
        forward = sum(1 for q in flow if q["is_fwd"] or not directional)
        opening = p["protocol"] == 6 and p["tcp_flags"] & 2 and not p["tcp_flags"] & 16
        if syn_cut and opening and forward >= threshold:
            done.append((open_flows.pop(k), True))
    return done + [(f, False) for f in open_flows.values()]


def _bulk(flow, way):
    """Bulk totals of one direction: runs of four packets or more, their packets, bytes and microseconds.

    The payload packets of the direction are first listed as runs. Each opposite payload packet is looked at only by
    the moment it came, so a run's members and its end are both known before anything is added up.
    """
    data = [(i, p["ts_us"], p["payload_len"], p["fwd"] == way) for i, p in enumerate(flow) if p["payload_len"] > 0]
    opposite = [(i, t) for i, t, _, mine in data if not mine]
    runs = []
    for i, t, size, mine in data:
        if not mine:
            continue
        latest = max((at for j, at in opposite if j < i), default=None)
        joins = runs and t - runs[-1][-1][0] <= 1_000_000 and (latest is None or latest <= runs[-1][0][0])
        if not joins:
            runs.append([])
        runs[-1].append((t, size))
    long = [r for r in runs if len(r) >= 4]
    return [len(long), sum(map(len, long)), sum(size for r in long for _, size in r), sum(r[-1][0] - r[0][0] for r in long)]


def features(flow, was_cut, as_of, directional):
    flow = [{**p, "fwd": bool(p["is_fwd"]) or not directional} for p in flow]
    ts = [p["ts_us"] for p in flow]
    span = ts[-1] - ts[0]
    gaps = [b - a for a, b in zip(ts, ts[1:])]
    out = {"flow_start_us": ts[0], "flow_start_frame": flow[0]["frame_no"], "flow_end_us": ts[-1],
           "flow_duration": float(span) if span else -1.0}
    reason = "[SYN-FLOOD]" if was_cut else "[Timeout]" if as_of - ts[-1] > 60_000_000 else "[Shutdown]"
    out["end_reason"] = reason

    def stat(prefix, samples, names=("max", "min", "mean", "std")):
        for n in names:
            out[f"{prefix}_{n}"] = _spread(samples)[n]

    ways = {"fwd": [p for p in flow if p["fwd"]], "bwd": [p for p in flow if not p["fwd"]]}
    tcp = flow[0]["protocol"] == 6
    rate = (lambda n: n * 1e6 / span) if span else (lambda n: 0.0)
    sf = 1 + sum(g > 1_000_000 for g in gaps)
    out["sf_count"] = sf
    for d, pk in ways.items():
        sizes = [p["payload_len"] for p in pk]
        out[f"tot_{d}_pkts"], out[f"totlen_{d}_pkts"] = len(pk), sum(sizes)
        out[f"{d}_header_len"] = sum(p["header_len"] for p in pk)
        out[f"{d}_pkts_s"] = rate(len(pk))
        stat(f"{d}_pkt_len", sizes)
        out[f"{d}_seg_size_avg"] = _spread(sizes)["mean"]
        t = [p["ts_us"] for p in pk]
        stat(f"{d}_iat", [b - a for a, b in zip(t, t[1:])], ("tot", "mean", "std", "max", "min"))
        out[f"subflow_{d}_pkts"], out[f"subflow_{d}_byts"] = len(pk) // sf, sum(sizes) // sf
        for name, bit in (("psh", 8), ("urg", 32), ("rst", 4)):
            out[f"{d}_{name}_flags"] = sum(tcp and bool(p["tcp_flags"] & bit) for p in pk)
        n, pkts, size, us = _bulk(flow, d == "fwd")
        out[f"{d}_byts_b_avg"], out[f"{d}_pkts_b_avg"] = (size // n, pkts // n) if n else (0, 0)
        out[f"{d}_blk_rate_avg"] = int(size / (us / 1e6)) if us else 0
    if not ways["bwd"]:
        for n in ("tot", "mean", "max", "min"):
            out[f"bwd_iat_{n}"] = -1.0
    sizes = [p["payload_len"] for p in flow]
    stat("pkt_len", sizes, ("max", "min", "mean", "std", "var"))
    out["pkt_size_avg"] = out["pkt_len_mean"]
    out["flow_byts_s"], out["flow_pkts_s"] = rate(sum(sizes)), rate(len(flow))
    stat("flow_iat", [0, *gaps])
    for name, bit in zip(("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr"), (1, 2, 4, 8, 16, 32, 64, 128)):
        out[f"{name}_flag_cnt"] = sum(tcp and bool(p["tcp_flags"] & bit) for p in flow)
    up = out["totlen_fwd_pkts"]
    out["down_up_ratio"] = out["totlen_bwd_pkts"] / up if up else 0.0
    data = [p["payload_len"] for p in ways["fwd"] if p["payload_len"] > 0]
    out["fwd_act_data_pkts"], out["fwd_seg_size_min"] = len(data), min(data, default=0)
    active, idle, begun = [], [], ts[0]
    for before, gap in zip(ts, gaps):
        if gap > 1_000_000:
            if before > begun:
                active.append(before - begun)
            idle.append(gap)
            begun = before + gap
    (idle if span > 120_000_000 else active if span else []).append(span)
    stat("active", active)
    stat("idle", idle)
    out["total_tcp_flow_time"] = out["flow_duration"] if tcp else 0.0
    return out


def all_features(packets, key, directional=False, syn_cut=True):
    as_of = max(p["ts_us"] for p in packets)
    return [{**{c: flow[0][c] for c in key}, **features(flow, was_cut, as_of, directional)}
            for flow, was_cut in cut_into_flows(packets, key, directional, syn_cut)]
