import random
import struct

import pytest

from flowloom.operators.decode import decode_packets
from flowloom.plans.flow_plan import flow_features
from flowloom.sources import captures
from flowloom.sources.captures import read_captures, write_captures
from flowloom.sources.files import read_frames


def capture_bytes(rng, n, order="<", nano=False, inside=b"", snap=96, tail=0):
    """A capture file and its frames (time in microseconds, bytes)."""
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, snap, 101)
    frames = []
    for i in range(n):
        raw = rng.randbytes(rng.randrange(0, snap)) if not inside or i % 3 else inside[:snap]
        second, fraction = 1_700_000_000 + i // 4, rng.randrange(10**9 if nano else 10**6)
        out += struct.pack(order + "IIII", second, fraction, len(raw), len(raw) + rng.choice([0, 1000])) + raw
        frames.append((second * 10**6 + (fraction // 1000 if nano else fraction), raw))
    return out[:len(out) - tail], frames[:-1] if tail else frames


def parts(path, data, cuts):
    """Frames of a file cut into ranges, each begun where the one before ended, and how many ranges guessed that place."""
    edges, known, found, guessed = [0, *cuts, len(data)], None, [], 0
    for start, end in zip(edges, edges[1:]):
        first = 24 if start == 0 else known
        capture, block, base = captures._range(path, len(data), start, end, None)
        places = [p for p, *_ in captures._walk(capture, block, base, end, 24 if start == 0 else None)]
        guessed += bool(places) and base + places[0] == first
        if first < end:
            capture, block, base = captures._range(path, len(data), start, end, first)
            walked = list(captures._walk(capture, block, base, end, first))
            unit = capture.fractions // 10**6
            found += [(s * 10**6 + f // unit, block[p + 16:p + 16 + n]) for p, s, f, n in walked if n >= 0]
            known = base + walked[-1][0]
    return found, guessed


@pytest.mark.parametrize("order, nano", [("<", False), (">", False), ("<", True), (">", True)])
def test_cut_at_every_offset(tmp_path, order, nano):
    data, frames = capture_bytes(random.Random(1), 16, order, nano, snap=48, tail=3)
    path = str(tmp_path / "a.pcap")
    open(path, "wb").write(data)
    for cut in range(25, len(data)):
        assert parts(path, data, [cut])[0] == frames
    found, guessed = parts(path, data, range(64, len(data), 64))
    assert found == frames and guessed > 0.6 * (len(data) // 64 - 1)


@pytest.mark.parametrize("split", [500, 1 << 20])
def test_read(spark, tmp_path, split):
    rng = random.Random(2)
    nested = capture_bytes(rng, 30, snap=40)[0][24:]  # records inside a frame: guesses may go wrong there
    want = []
    for n, (order, nano, inside, snap) in enumerate([("<", False, b"", 90), (">", True, b"", 90), ("<", False, nested, 2000)]):
        data, frames = capture_bytes(rng, 60, order, nano, inside, snap)
        (tmp_path / f"{n}.pcap").write_bytes(data)
        want += [(k + 1, ts, 12, len(raw), raw, n) for k, (ts, raw) in enumerate(frames) if raw]
    (tmp_path / "3.pcap").write_bytes(capture_bytes(rng, 0)[0])
    (tmp_path / "notes.txt").write_bytes(b"no capture")
    got = [tuple(r) for r in read_captures(spark, str(tmp_path), split).collect()]
    assert sorted(got) == sorted((k, t, link, n, bytearray(raw), c) for k, t, link, n, raw, c in want)


def test_other_files(spark, tmp_path):
    assert read_captures(spark, str(tmp_path)).count() == 0
    (tmp_path / "x.pcap").write_bytes(b"this is no capture file at all")
    with pytest.raises(Exception, match="not a capture file"):
        read_captures(spark, str(tmp_path)).count()


def frame_of(port, flags):
    """Bare IP and TCP headers."""
    return bytes.fromhex("4500002800000000400600000A0000010A000002") + struct.pack(">HHIIBBHI", port, 443, 0, 0, 0x50, flags, 0, 0)


def test_two_captures_numbered_alike_cut_at_fifty(spark, tmp_path):
    """Frames of both files have the same numbers and times; the SYN that cuts is that of the second one."""
    for n, flags in ((0, 0x10), (1, 0x02)):
        rows = [(1_700_000_000_000_000 + k * 1000, frame_of(1000 + n, flags if k == 24 else 0x10)) for k in range(30)]
        write_captures(spark.createDataFrame(rows, "ts_us long, raw binary").coalesce(1), str(tmp_path / "c"), 101, str(n))
    packets = decode_packets(read_captures(spark, str(tmp_path / "c"), 256))
    assert packets.count() == 60 and packets.select("frame_no", "ts_us").distinct().count() == 30
    flows = sorted((r.tot_fwd_pkts, r.end_reason, r.flow_start_frame, r.flow_start_capture) for r in flow_features(packets).collect())
    assert flows == [(10, "[Shutdown]", 26, 0), (50, "[SYN-FLOOD]", 1, 0)]


def test_frame_tables_without_capture_number(spark, tmp_path):
    spark.createDataFrame([(1, 5, 12, 40, frame_of(1, 2))], "frame_no long, ts_us long, linktype int, caplen int, raw binary").write.parquet(str(tmp_path / "f"))
    assert decode_packets(read_frames(spark, str(tmp_path / "f"))).first().capture_no == 0


def test_small_ranges_are_read_together(tmp_path, monkeypatch):
    """Ranges of a stretch share one read of it, and see what each would have read alone."""
    data, _ = capture_bytes(random.Random(4), 400, snap=90)
    path = str(tmp_path / "a.pcap")
    open(path, "wb").write(data)
    reads, plain = [], captures._range
    monkeypatch.setattr(captures, "_range", lambda *a: reads.append(a) or plain(*a))
    stretches, each = captures._Stretches(), 4096
    for start in range(0, len(data), 256):
        low = start // each * each
        r = {"path": path, "size": len(data), "start": start, "end": min(len(data), start + 256), "stretch": start // each,
             "low": low, "high": min(len(data), low + each)}
        for first in (None, start + 7 if start else None):
            capture, block, base = stretches.range(r, first)
            alone = plain(path, len(data), start, r["end"], first)
            assert (bytes(block), base) == (bytes(alone[1]), alone[2])
    assert len(reads) == -(-len(data) // each)


def test_tasks_follow_the_bytes_not_the_ranges(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture_bytes(random.Random(5), 2000, snap=90)[0])
    frames = read_captures(spark, str(tmp_path), 512)
    assert frames.rdd.getNumPartitions() == 1 and frames.filter("caplen > 0").count() > 1900
