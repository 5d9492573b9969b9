"""Text files that grow, shrink or are recreated, as a stream of their whole lines.

Spark's own file stream knows a file by its path and reads it once. This source (a Python data source) notes for each
file how far it has been read and a digest of its head. A batch is what lies between two such notes: the whole lines added
since. A file that is shorter than before, or has another head, was recreated and is read again from its start. A line
without its line feed waits for the rest. Notes are Spark's offsets, kept in the query's checkpoint, so a batch that is
run again has the same lines.

Many bytes at once are cut into ranges of ``SPLIT_BYTES``, each its own task, which begin and end at lines. Files are opened
where Arrow's file systems reach them. A note holds one entry a file: meant for a folder of live files, not for an archive.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES = 32 << 20
HEAD_BYTES = 4096
_STEP = 1 << 16


def _system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))


def _digest(file, size: int) -> str:
    file.seek(0)
    return hashlib.sha256(file.read(size)).hexdigest()


def _whole_lines(file, size: int) -> int:
    """Offset behind the last line feed of the first ``size`` bytes."""
    while size > 0:
        low = max(0, size - _STEP)
        file.seek(low)
        at = file.read(size - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        size = low
    return 0


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, low: int):
        self.path, self.start, self.end, self.low = path, start, end, low


class _GrownReader(DataSourceStreamReader):
    def __init__(self, folder: str, ending: str, split: int):
        self.folder, self.ending, self.split = folder, ending, split

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, folder = _system(self.folder)
        found = {}
        for info in system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and info.base_name.endswith(self.ending) and info.base_name[0] not in "._":
                with system.open_input_file(info.path) as file:
                    end = _whole_lines(file, info.size)
                    head = min(end, HEAD_BYTES)
                    found[info.path] = [end, head, _digest(file, head)]
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        before, system = json.loads(start["files"]), _system(self.folder)[0]
        out = []
        for path, (now, head, digest) in json.loads(end["files"]).items():
            read, old_head, old = before.get(path, (0, 0, ""))
            if read:
                if old_head < head and now >= read:
                    with system.open_input_file(path) as file:
                        digest = _digest(file, old_head)
                if now < read or digest != old:
                    read = 0  # recreated
            out += [_Range(path, low, min(now, low + self.split), read) for low in range(read, now, self.split)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        """Lines that begin in the range; the line that crosses its end is read to its own."""
        with _system(self.folder)[0].open_input_file(partition.path) as file:
            at, begin = partition.start, partition.start
            if begin > partition.low:  # the line of the byte before belongs to the range before
                begin = at = begin - 1
            file.seek(begin)
            rest, skip = b"", begin < partition.start
            while at < partition.end:
                block = file.read(_STEP)
                if not block:
                    return
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if at >= partition.end:
                        return
                    if not skip:
                        yield partition.path, at, line.removesuffix(b"\r").decode("utf-8", "ignore")
                    skip = False
                    at += len(line) + 1


class GrownFiles(DataSource):
    """``spark.readStream.format("grown_files").option("ending", ".csv").load(folder)``: ``path``, ``at`` (byte offset), ``line``."""

    @classmethod
    def name(cls) -> str:
        return "grown_files"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _GrownReader(self.options["path"], self.options.get("ending", ""), int(self.options.get("split", SPLIT_BYTES)))


def stream_lines(spark: SparkSession, folder: str, ending: str = ".csv", split: int = SPLIT_BYTES) -> DataFrame:
    """The whole lines of a folder's files as they appear: ``path``, ``at`` (byte offset of the line), ``line``."""
    spark.dataSource.register(GrownFiles)
    return spark.readStream.format("grown_files").option("ending", ending).option("split", split).load(folder)
