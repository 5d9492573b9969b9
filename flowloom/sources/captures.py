"""Capture files (classic pcap) to frames, a big file in many tasks.

A file is cut into byte ranges. Inside a range nothing marks where a record begins, so each range is first walked by
its own guess: the first place from which a chain of plausible record headers runs. It reports where it began, where the record
after its end begins, and how many records it has. The first range of a file begins after the file's header without a guess,
so where every range's end is the next one's beginning, all are proved right; a range that guessed wrong is walked again
from its predecessor's end. Frame numbers are the counts before a range plus the place in it, and only then are frames read.

Ranges and their counts are tables; neighbours that make up ``STRETCH_BYTES`` are one task's, which reads them at once. What a task holds
is such a stretch, or one range of ``split_bytes`` if that is larger, and at most one record beyond.
Files are opened where Arrow's file systems reach them (local and shared paths, ``hdfs``, ``s3``, ``gs``).
Both byte orders, microsecond and nanosecond files and frames cut short at capture are read. A record cut off
at the end of its file is left out; after a damaged record reading goes on in the next range. Files that aren't captures
are an error, empty folders give no frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.session import durable, files_in, scratch_path

SPLIT_BYTES = 128 << 20
STRETCH_BYTES = 4 << 20
_HEAD, _RECORD = 24, 16
_LONGEST = 262_144
_CHAIN = 12
_DAY = 86_400
# The magic numbers of the format (seconds' fractions a second), and bare IP among its link types.
_MAGIC = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
_BARE_IP = {101: 12, 14: 12}


def _opened(path: str) -> pa.NativeFile:
    system, at = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(at)


class _Capture:
    """What the head of a capture file says about its records."""

    def __init__(self, head: bytes, size: int):
        self.size = size
        for order in "<>":
            magic = struct.unpack(order + "I", head[:4])[0] if len(head) == _HEAD else None
            if magic in _MAGIC:
                self.order, self.fractions = order, _MAGIC[magic]
                break
        else:
            raise ValueError("not a capture file")
        snap, link = struct.unpack(self.order + "II", head[16:24])
        self.longest = max(snap, _LONGEST)
        self.link = _BARE_IP.get(link & 0x0FFFFFFF, link & 0x0FFFFFFF)

    def record(self, data: memoryview, at: int) -> tuple[int, int, int]:
        """Second, fraction and captured length of the record at a place in ``data``; length -1 if it can't be one."""
        second, fraction, size, whole = struct.unpack_from(self.order + "IIII", data, at)
        return second, fraction, size if size <= self.longest and size <= whole and fraction < self.fractions else -1

    def begins(self, data: memoryview, at: int, rest: int) -> bool:
        """Whether a chain of records seems to run from ``at``; ``rest`` bytes of the file follow ``data``."""
        last = None
        for _ in range(_CHAIN):
            if at + _RECORD > len(data):
                return last is not None and (rest > 0 or at >= len(data))
            second, _, size = self.record(data, at)
            if size < 0 or (last is not None and abs(second - last) > _DAY):
                return False
            last, at = second, at + _RECORD + size
        return True

    def first(self, data: memoryview, rest: int) -> int | None:
        return next((at for at in range(len(data) - _RECORD + 1) if self.begins(data, at, rest)), None)


def _range(path: str, size: int, start: int, end: int, first: int | None) -> tuple[_Capture, memoryview, int]:
    """A file's head, the bytes of a range and of the record that may cross its end, and the file offset they begin at."""
    with _opened(path) as file:
        capture = _Capture(file.read(_HEAD), size)
        at = max(start if first is None else first, _HEAD)
        file.seek(at)
        return capture, memoryview(file.read(max(0, min(size, end + _RECORD + capture.longest) - at))), at


class _Stretches:
    """``_range`` for rows that come by stretch: each stretch is read once."""

    def __init__(self):
        self.at, self.read = None, None

    def range(self, r: dict, first: int | None) -> tuple[_Capture, memoryview, int]:
        if self.at != (r["path"], r["stretch"]):
            self.at, self.read = (r["path"], r["stretch"]), _range(r["path"], r["size"], r["low"], r["high"], None)
        capture, data, base = self.read
        at = max(r["start"] if first is None else first, _HEAD)
        return capture, data[at - base:max(at, r["end"] + _RECORD + capture.longest) - base], at


def _by_stretch(ranges: DataFrame, n: int) -> DataFrame:
    """Ranges of a stretch in one task, in order."""
    return ranges.repartition(n, "path", "stretch").sortWithinPartitions("path", "start")


def _walk(capture: _Capture, data: memoryview, base: int, end: int, first: int | None) -> Iterator[tuple[int, int, int, int]]:
    """Place in ``data``, second, fraction and size of each record that begins before ``end``; last the place after them."""
    at = first - base if first is not None else capture.first(data, capture.size - base - len(data))
    if at is None:
        return
    while base + at < end and at + _RECORD <= len(data):
        second, fraction, size = capture.record(data, at)
        if size < 0 or at + _RECORD + size > len(data):
            at = len(data) if base + len(data) >= capture.size and size >= 0 else at
            break
        yield at, second, fraction, size
        at += _RECORD + size
    yield at, -1, -1, -1


_PLACES = ["capture_no", "size", "start", "end", "stretch", "low", "high"]
_RANGE = "path string, " + ", ".join(f"{c} long" for c in _PLACES)


def _walked(ranges: DataFrame) -> DataFrame:
    """For ranges with ``known`` (where the first record begins, null to guess): ``first``, ``after`` and number ``n`` of records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = _Stretches()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                known = _HEAD if r["start"] == 0 else r["known"]
                first, after, n = known, known, 0
                if known is None or known < r["end"]:
                    capture, data, base = stretches.range(r, known)
                    places = [at for at, *_ in _walk(capture, data, base, r["end"], known)]
                    first, after, n = (base + places[0], base + places[-1], len(places) - 1) if places else (None, None, 0)
                    if after is not None and after + _RECORD > r["size"]:
                        after = r["size"]
                out.append({**r, "first": first, "after": after, "n": n})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in (*_PLACES, "known", "first", "after", "n")]])
    return ranges.mapInArrow(run, _RANGE + ", known long, first long, after long, n long")


def _proved(ranges: DataFrame, n: int) -> DataFrame:
    """Walked ranges whose ends meet; those that don't are walked again from where their predecessor ends."""
    walked = durable(_walked(_by_stretch(ranges.withColumn("known", F.lit(None).cast("long")), n)))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("after", ignorenulls=True).over(earlier)
    while True:
        # an end before this range is still to be mended itself, or that of a damaged record, after which guesses stand
        wrong = walked.withColumn("wanted", before).filter("start > 0 AND wanted >= start AND NOT first <=> wanted")
        if wrong.isEmpty():
            return walked
        mended = _walked(_by_stretch(wrong.drop("known", "first", "after", "n").withColumnRenamed("wanted", "known"), n))
        walked = durable(walked.join(wrong.select("path", "start"), ["path", "start"], "left_anti").unionByName(mended))


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames of a capture file, or of the capture files of a folder, with ``capture_no`` in the order of file names.

    ``frame_no`` counts a file's frames from 1.
    """
    files = [(p, n, size) for n, (p, size) in enumerate(files_in(spark, path, (".pcap", ".cap")))]
    if not files:
        return spark.createDataFrame([], "frame_no long, ts_us long, linktype int, caplen int, raw binary, capture_no long")
    ranges = spark.createDataFrame(files, "path string, capture_no long, size long").select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    each = max(1, STRETCH_BYTES // split_bytes) * split_bytes
    ranges = durable(ranges.withColumn("end", F.least(F.col("size"), F.col("start") + split_bytes)).withColumn("stretch", F.floor(F.col("start") / each))
                     .withColumns({"low": F.col("stretch") * each, "high": F.least(F.col("size"), (F.col("stretch") + 1) * each)}))
    spread = max(1, min(sum(-(-size // each) for *_, size in files), 100_000))
    proved = _proved(ranges, spread)
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = proved.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("n > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = _Stretches()
        for batch in batches:
            for r in batch.to_pylist():
                capture, data, base = stretches.range(r, r["first"])
                unit = capture.fractions // 1_000_000
                rows = [(at, second * 1_000_000 + fraction // unit, size) for at, second, fraction, size in
                        _walk(capture, data, base, r["end"], r["first"]) if size >= 0]
                for low in range(0, len(rows), 4096):
                    part = rows[low:low + 4096]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(range(r["earlier"] + low + 1, r["earlier"] + low + n + 1), pa.int64()), pa.array([t for _, t, _ in part], pa.int64()),
                        pa.array([capture.link] * n, pa.int32()), pa.array([size for *_, size in part], pa.int32()),
                        pa.array([bytes(data[at + _RECORD:at + _RECORD + size]) for at, _, size in part], pa.binary()),
                        pa.array([r["capture_no"]] * n, pa.int64())], ["frame_no", "ts_us", "linktype", "caplen", "raw", "capture_no"])

    return _by_stretch(numbered, spread).mapInArrow(
        run, "frame_no long, ts_us long, linktype int, caplen int, raw binary, capture_no long").filter("caplen > 0")


def write_captures(frames: DataFrame, path: str, linktype: int = 1, name: str = "part") -> None:
    """Writes frames of one link type as a capture file for each partition, in the order of its rows (microseconds, little endian).

    A file appears under its name when it is whole, so a task that is run again replaces it.
    """
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, _LONGEST, linktype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))
        system.create_dir(folder, recursive=True)
        context, n = TaskContext.get(), 0
        target = f"{folder}/{name}-{context.partitionId():05d}.pcap"
        part = f"{target}.{context.taskAttemptId()}.tmp"
        with system.open_output_stream(part) as out:
            out.write(head)
            for batch in batches:
                for r in batch.to_pylist():
                    out.write(struct.pack("<IIII", r["ts_us"] // 1_000_000, r["ts_us"] % 1_000_000, len(r["raw"]), max(len(r["raw"]), r["wire"] or 0)) + r["raw"])
                    n += 1
        system.move(part, target)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    wire = F.col("wire_len") if "wire_len" in frames.columns else F.lit(None)
    frames.select("ts_us", "raw", wire.cast("long").alias("wire")).mapInArrow(run, "n long").write.parquet(scratch_path(frames.sparkSession, "captures"))
