"""Words of Arrow text columns as byte spans and 64-bit hashes, one bounded block at a time.

Every text is handled whole. A block holds as many whole texts as fit ``BLOCK_BYTES`` (a longer text
is a block of its own), so temporary arrays stay small whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLOCK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_TABLE = (1 << 17) + 64


def _lut(is_member: Callable[[int], bool]) -> np.ndarray:
    return np.array([is_member(b) for b in range(256)], dtype=bool)


#: Bytes of words split at ASCII white space only.
PLAIN = _lut(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of ASCII letters, ASCII digits and everything beyond ASCII.
ALNUM = _lut(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    if int(base) not in _tables:
        _tables[int(base)] = (_powers(base, _TABLE), _powers(_inverse(base), _TABLE))
    return _tables[int(base)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Some whole texts of a batch: ``buf`` bytes, text ``i`` at ``offsets[i]:offsets[i+1]``, rows from ``first``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first: int):
        self.buf, self.offsets, self.first = buf, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def texts(self) -> Iterator[bytes]:
        data, at = self.buf.tobytes(), self.offsets.tolist()
        return (data[a:b] for a, b in zip(at, at[1:], strict=False))

    def words(self, member: np.ndarray, lower: bool = False) -> Words:
        return Words(LOWER[self.buf] if lower else self.buf, self.offsets, member)


class Words:
    """Spans of the words of a block; word ``j`` of text ``i`` has index ``first[i] + j``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        flag = member[buf]
        before, after = np.zeros(len(buf), dtype=bool), np.zeros(len(buf), dtype=bool)
        before[1:], after[:-1] = flag[:-1], flag[1:]
        cut = offsets[1:-1]
        before[cut[cut < len(buf)]] = False
        after[cut[cut > 0] - 1] = False
        self.buf = buf
        self.starts = np.flatnonzero(flag & ~before)
        self.ends = np.flatnonzero(flag & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, first_bytes: int | None = None) -> np.ndarray:
        """A 64-bit hash for each word (or its ``first_bytes``), equal for equal bytes wherever the word stands."""
        power, inverse = _both_powers(_BASE)
        ends = self.ends if first_bytes is None else np.minimum(self.ends, self.starts + first_bytes)
        out = np.empty(len(self.starts), dtype=np.uint64)
        i, n = 0, len(self.starts)
        while i < n:
            base = self.starts[i]
            j = int(np.searchsorted(ends, base + _TABLE, side="left"))
            if j <= i:  # one word longer than the table
                out[i] = self._long(self.starts[i], ends[i], power)
                i += 1
                continue
            part = self.buf[base:ends[j - 1]].astype(np.uint64) + np.uint64(1)
            part *= power[:len(part)]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part, out=sums[1:])
            a, b = self.starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * inverse[a]
            i = j
        return mix(out)

    def _long(self, start: int, end: int, power: np.ndarray) -> np.uint64:
        total, scale, step = 0, 1, len(power) - 1
        for a in range(start, end, step):
            part = self.buf[a:min(end, a + step)].astype(np.uint64) + np.uint64(1)
            total = (total + scale * int((part * power[:len(part)]).sum(dtype=np.uint64))) % (1 << 64)
            scale = scale * int(power[step]) % (1 << 64)
        return np.uint64(total)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; runs that leave the array have none."""
    power, inverse = _both_powers(_GRAM)
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, step = np.empty(n, dtype=np.uint64), _TABLE - size
    for a in range(0, n, step):
        b = min(n, a + step)
        part = words[a:b + size - 1] * power[:b - a + size - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        out[a:b] = (sums[size:] - sums[:-size]) * inverse[:b - a]
    return mix(out)


#: Rows of an Arrow batch of texts; texts are long, so a batch of Spark's usual 10,000 rows would take much memory.
BATCH_ROWS = 2000


def small_batches(spark) -> None:
    """Has the session send texts to Python in batches of at most ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its column ``text``, or the field of that name of ``row``, so that they are sent once."""
    return batch.column("text") if "text" in batch.schema.names else pa.compute.struct_field(batch.column("row"), "text")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column (nulls as empty texts) into blocks of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Block(buf[at[i]:at[j]], at[i:j + 1] - at[i], i)
        i = j
