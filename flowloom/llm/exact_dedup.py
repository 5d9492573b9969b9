"""Exact duplicates through an extendible-hash index on shared files.

Each text is read once, where it lies: its normalised form leaves a 64-bit key and its SHA-256 behind, and
only these are stored, exchanged and sent to Python, so no text's length counts in any later step.
A directory maps key prefixes to buckets; while a bucket holds more than ``capacity`` bytes of entries of distinct
texts, the directory doubles and the bucket splits on the next bit. Buckets are thus ranges of keys. Owner tasks
take whole buckets, walk them in key order and chain the entries of equal keys, telling them apart by their
digests. The index they write, one row a distinct text, is a table in the shared checkpoint folder; documents find
their group there by key and SHA-256.

Size and skew. Copies are merged within each Arrow batch before anything is exchanged, so a text that
makes up a third of all rows reaches its owner as one entry a batch, and the owner keeps one entry a
distinct text. The directory is at most ``1 << MAX_DEPTH`` numbers on the driver and in a broadcast.
A bucket still overfull at that depth is no special case: owners stream in key order and hold one
key's chain only. The last join is split by adaptive execution where one group is very large.

Nulls: a null text counts as empty. ``keep_id`` is the smallest non-null id of the group, null only if
there is none. Rows that repeat the id that stays are the same document and stay with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import durable

MAX_DEPTH = 18
#: Bytes of an entry: bucket, key, digest in hex, number of rows, id, and what Arrow adds.
ENTRY_BYTES = 96
BUCKET_BYTES = 1 << 20


def normal_text(text: str) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def directory(load: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket of each cell of the finest directory: the first cell of the key range it belongs to.

    ``load`` has the bytes in each cell; its length is a power of two, the directory's largest size.
    """
    cells = np.arange(len(load))
    bucket = np.zeros(len(load), dtype=np.int64)
    span = len(load)  # cells that share a directory entry; halves when the directory doubles
    while span > 1:
        full = np.repeat(load.reshape(-1, span).sum(axis=1) > capacity, span)
        if not full.any():
            break
        span //= 2
        bucket = np.where(full, cells // span * span, bucket)
    return bucket


def text_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``key``, ``text_sha256`` of the normalised text of every row."""
    normal = normal_text(text)
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(normal).alias("key"), F.sha2(normal, 256).alias("text_sha256"))


def _load(digests: DataFrame) -> np.ndarray:
    cell = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    held = digests.select("key").distinct().groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toArrow()
    load = np.zeros(1 << MAX_DEPTH, dtype=np.int64)
    load[held.column("cell").to_numpy()] = held.column("n").to_numpy() * ENTRY_BYTES
    return load


def _merged(entries: pa.Table) -> pa.Table:
    """One entry for each bucket, key and digest: the rows it stands for and their smallest id."""
    out = entries.group_by(["bucket", "key", "text_sha256"], use_threads=False).aggregate([("group_size", "sum"), ("keep_id", "min")])
    return out.select(["bucket", "key", "text_sha256", "keep_id_min", "group_size_sum"]).rename_columns(
        ["bucket", "key", "text_sha256", "keep_id", "group_size"])


def _to_batches(entries: pa.Table, rows: int = 4096) -> list[pa.RecordBatch]:
    return entries.combine_chunks().to_batches(max_chunksize=rows)


def exact_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_BYTES,
                digests: DataFrame | None = None) -> DataFrame:
    """The index: ``bucket``, ``key``, ``text_sha256``, ``keep_id``, ``group_size`` for each distinct normalised text.

    ``digests`` may give ``text_digests`` of the documents where the caller has them stored.
    """
    if digests is None:
        digests = durable(text_digests(docs, doc_id, text))
    bucket_of = directory(_load(digests), capacity)
    table = docs.sparkSession.sparkContext.broadcast(bucket_of.astype(np.int32))  # 1 MiB whatever the data
    schema = f"bucket int, key long, text_sha256 string, keep_id {dict(digests.dtypes)['doc_id']}, group_size long"

    def merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - MAX_DEPTH)).astype(np.int64)
            columns = [pa.array(table.value[cell]), batch.column("key"), batch.column("text_sha256"), batch.column("doc_id"),
                       pa.array(np.ones(len(batch), dtype=np.int64))]
            yield from _to_batches(_merged(pa.table(columns, ["bucket", "key", "text_sha256", "keep_id", "group_size"])))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries in key order; the last key's chain waits, merged, for the next batch."""
        chain = None
        for batch in batches:
            if not len(batch):
                continue
            new = pa.Table.from_batches([batch])
            last = batch.column("key")[len(batch) - 1]
            merged = _merged(pa.concat_tables([chain, new.cast(chain.schema)]) if chain is not None else new)
            open_ = pa.compute.equal(merged.column("key"), last)
            chain = merged.filter(open_)
            yield from _to_batches(merged.filter(pa.compute.invert(open_)))
        if chain is not None:
            yield from _to_batches(chain)

    owners = max(1, len(np.unique(bucket_of)))
    entries = digests.mapInArrow(merge_copies, schema).repartition(owners, "bucket").sortWithinPartitions("key")
    return durable(entries.mapInArrow(own, schema))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` for every row of ``docs``; other columns are ignored."""
    digests = durable(text_digests(docs, doc_id, text))
    index = exact_index(docs, doc_id, text, capacity, digests).select("key", "text_sha256", "keep_id", "group_size")
    found = digests.join(index, ["key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
