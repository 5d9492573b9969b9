"""Near duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints. A bit is set if more than half of the XXH64 values (seed 42) of a text's word shingles,
repeats included, have it. A text with fewer words than a shingle is one shingle; without words the
fingerprint is zero, and it is linked like any other.

Links. Of two fingerprints that differ in at most 4 of 64 bits, one 32-bit half differs in at most 2,
so the Hamming balls of radius 1 around both halves meet. Each distinct fingerprint enters a table
under the 33 values of the ball of each half; fingerprints that meet there are compared in full.
Entries that could only repeat a meeting (the same bit flipped on both sides) are not looked at.

Size and skew. Documents are merged to distinct fingerprints first. A table entry shared by more than
``CROWD`` fingerprints is split by the same rule on quarters of the other half, then on eighths of the
rest; then at most 33 x 17 x 9 x 256 values can meet, whatever the data. Within an entry only links of
a spanning forest are written, not pairs, so components stay whole without squares of rows.

Rows with a null text count as empty texts; ``component_id`` ignores null ids unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.components import components
from flowloom.llm.textbytes import blocks, small_batches
from flowloom.session import durable

SEED = 42
CROWD = 2000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)


def fingerprint(text: bytes, shingle: int) -> int:
    """The unsigned fingerprint of a whole text."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)], dtype=np.uint64)
    of_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    set_ = (of_byte @ _BITS).ravel() * 2 > len(hashes)
    return int.from_bytes(np.packbits(set_, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a long) for every row; other columns are ignored."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for block in blocks(batch.column("text")) for t in block.texts()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, fp long")


def _forest(values: np.ndarray, distance: int) -> list[np.ndarray]:
    """Links of a spanning forest of the distinct values, each joining two that differ in at most ``distance`` bits."""
    out, rest = [], values
    while len(rest) > 1:
        reached, rest = [rest[:1]], rest[1:]
        while reached and len(rest):
            for at in reached.pop():
                near = np.bitwise_count(rest ^ at) <= distance
                if near.any():
                    hit, rest = rest[near], rest[~near]
                    out.append(np.stack([np.full(len(hit), at), hit], axis=1))
                    reached.append(hit)
    return out


def _entry_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        out = [link for a, b in zip(at, at[1:], strict=False) for link in _forest(flat[a:b], distance)]
        pairs = (np.concatenate(out) if out else np.empty((0, 2), dtype=np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _ball(rows: DataFrame, width: int) -> DataFrame:
    """Enters each row under the ball of radius 1 of both ``width``-bit segments of ``fp`` from bit ``low`` on.

    ``flip`` is the bit turned over, -1 for none; ``part`` is the segment's number under its parent.
    """
    probes = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * width + 1))))
    probes = probes.withColumn("part", F.expr(f"i div {width + 1}")).withColumn("flip", F.expr(f"cast(i % {width + 1} - 1 as int)"))
    value = f"(shiftrightunsigned(fp, cast(low + part * {width} as int)) & {(1 << width) - 1}L)"
    return probes.selectExpr("low", "part", "fp", "flip", f"xxhash64(key, part, {value} ^ if(flip < 0, 0L, shiftleft(1L, flip))) AS key")


def near_links(fps: DataFrame, distance: int = 4, crowd: int = CROWD) -> DataFrame:
    """``a``, ``b``: links that join all distinct ``fp`` of ``fps`` that differ in at most ``distance`` (4 or less) bits."""
    if distance > 4:
        raise ValueError("balls of radius 1 around halves cover distances up to 4")
    # each fingerprint becomes 66 probes, so they are dealt evenly first; a number keeps small tables from being put together
    even = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows, found = even.selectExpr("0L AS key", "0 AS low", "fp"), []
    for width in (32, 16, 8):
        probes = _ball(rows, width)
        # a meeting matters if two fingerprints stand there unturned or turned at different bits
        used = (probes.groupBy("key").agg(F.count("*").alias("n"), F.min("flip").alias("f0"), F.max("flip").alias("f1"))
                .filter("n > 1 AND (f0 <> f1 OR f0 = -1)").select("key", "n"))
        met = probes.join(used, "key")
        last = width == 8
        small = met if last else met.filter(F.col("n") <= crowd)
        lists = small.groupBy("key").agg(F.collect_list("fp").alias("fps"))
        found.append(lists.mapInArrow(lambda batches: _entry_links(batches, distance), "a long, b long"))
        if not last:  # the bits left are the other segment of the parent
            rows = met.filter(F.col("n") > crowd).selectExpr("key", f"cast(low + (1 - part) * {width} as int) AS low", "fp")
    return reduce(DataFrame.union, found)


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text",
                crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links) for every row."""
    rows = durable(fingerprints(docs, shingle, doc_id, text))
    unlike = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    root = components(near_links(unlike.select("fp"), distance, crowd)).select(F.col("a").alias("fp"), "root")
    member = unlike.join(root, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = member.join(smallest, "root").select("fp", "component_id")
    return rows.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
