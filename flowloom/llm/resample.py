"""Importance resampling towards a target distribution, by hashed words and word pairs.

Features are single words and pairs in a row; a feature's bucket is a CRC-32 modulo the number of buckets. A bucket's gain is
the logarithm, in thousandths, of its smoothed share among the target's features over that among the corpus's. A document's
weight is the floored mean of the gains of its features, summed bit-sliced: bit ``i`` of all bucket counts of a document is
one plane of as many bits as buckets, bit ``j`` of all gains another; the ones in their AND, times 2^(i+j), add up to
the exact sum, the highest gain plane counting negative (two's complement).

The texts are read once: counts by document are stored, small beside the texts. Each task adds its bucket counts before one row a
bucket is exchanged. Only the gains (``BUCKETS`` numbers) pass the driver. Drawing is by weight plus Gumbel noise seeded by
the id, the best first. Scores are integers within a span set by the logarithms of 64-bit counts, so rows a score are a
table of under 2^18 rows; ranks are offsets by score plus a place among equal scores, where rows that repeat are
counted first. No task sorts more than the rows of a score.

Null and empty texts have no features and weight 0. Null ids draw noise as an empty id and come last among equal scores.
Rows that repeat an id and a text have equal scores and take places next to each other. Empty tables give no rows; an
empty target leaves all its counts 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.textbytes import ALNUM, Block, Words, blocks, small_batches
from flowloom.session import durable

BUCKETS = 10_000
SHARE = 25  # % of the documents long enough
MIN_WORDS = 20
SEED = 7
_LONG = 48
_PAGE = 256


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_STEP = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _on(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _STEP[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def _after(state: np.ndarray, words: Words, which: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of the words ``which``, one step for the words that have a further byte at a time."""
    starts, size = words.starts[which], words.ends[which] - words.starts[which]
    order = np.argsort(-size, kind="stable")
    out, n_long = state.copy(), int((size > _LONG).sum())
    for i in order[:n_long]:
        part = words.buf[starts[i]:starts[i] + size[i]].tobytes()
        out[i] = zlib.crc32(part, int(state[i] ^ _ONES)) ^ 0xFFFFFFFF
    order = order[n_long:]
    s, at = state[order], starts[order]
    reach = np.searchsorted(-size[order], -np.arange(_LONG), side="left")  # words with more than so many bytes
    for p in range(_LONG):
        n = reach[p]
        if not n:
            break
        s[:n] = _on(s[:n], words.buf[at[:n] + p])
    out[order] = s
    return out


def feature_counts(block: Block, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; text, bucket and count of every bucket that a text of the block has, in this order."""
    words = block.words(ALNUM, lower=True)
    n = words.counts()
    owner = np.repeat(np.arange(len(n)), n)
    every = np.arange(len(owner))
    one = _after(np.full(len(owner), _ONES), words, every)
    lead = every[:-1][owner[1:] == owner[:-1]] if len(owner) else every
    two = _after(_on(one[lead], np.uint32(0x20)), words, lead + 1)
    bucket = (np.concatenate([one, two]) ^ _ONES).astype(np.int64) % buckets
    key, count = np.unique(np.concatenate([owner, owner[lead]]) * buckets + bucket, return_counts=True)
    return n, key // buckets, key % buckets, count


def counted(docs: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``buckets`` and ``counts`` (sorted lists of the buckets met) for every row."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                n, owner, bucket, count = feature_counts(block, buckets)
                at = pa.array(np.searchsorted(owner, np.arange(len(block) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(block)), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(at, pa.array(count.astype(np.int64)))], ["doc_id", "n_words", "buckets", "counts"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_words long, buckets array<int>, counts array<long>")


def bucket_totals(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n``: features of all rows of ``counted`` by bucket; a task sends at most one row a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    return counts.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from two ``bucket_totals``."""
    def column(totals: DataFrame) -> np.ndarray:
        rows, out = totals.toArrow(), np.zeros(buckets, dtype=np.int64)
        out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        return out

    s, t = column(source), column(target)
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    ratio = (t + 1).astype(float) * whole_s / ((s + 1).astype(float) * whole_t)
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _planes(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int, buckets: int) -> list[np.ndarray]:
    """Plane ``i`` has, for each row, bit ``i`` of the value of every bucket; entries come sorted by row and bucket."""
    width = -(-buckets // 64)
    word = row * width + bucket // 64
    bit = np.uint64(1) << (bucket % 64).astype(np.uint64)
    out = []
    for i in range(int(value.max(initial=0)).bit_length()):
        here = np.flatnonzero((value >> i) & 1)
        plane = np.zeros(rows * width, dtype=np.uint64)
        if len(here):
            start = np.flatnonzero(np.diff(word[here], prepend=-1))
            plane[word[here][start]] = np.bitwise_or.reduceat(bit[here], start)
        out.append(plane.reshape(rows, width))
    return out


class GainPlanes:
    """Bit planes of the gains in two's complement."""

    def __init__(self, gain: np.ndarray):
        self.buckets, self.bits = len(gain), int(np.abs(gain).max(initial=1)).bit_length() + 1
        every = np.arange(len(gain))
        planes = _planes(np.zeros_like(every), every, gain & ((1 << self.bits) - 1), 1, len(gain))
        self.planes = [(j, p[0]) for j, p in enumerate(planes) if p.any()]

    def sums(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """For each row, the sum of count times gain."""
        total = np.zeros(rows, dtype=np.int64)
        for i, plane in enumerate(_planes(row, bucket, count, rows, self.buckets)):
            used = np.flatnonzero(plane.any(axis=1))
            plane = plane[used]
            for j, gain in self.planes:
                ones = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                total[used] += (-ones if j == self.bits - 1 else ones) << (i + j)
        return total


def weights(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` (floored mean gain) for every row of ``counted``."""
    shared = counts.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = GainPlanes(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                lists, count = part.column("buckets"), part.column("counts").flatten().to_numpy()
                n = np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(len(n)), n)
                features = np.bincount(owner, weights=count, minlength=len(n)).astype(np.int64)
                total = planes.sums(owner, lists.flatten().to_numpy().astype(np.int64), count, len(n))
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_words"), pa.array(features), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    return counts.mapInArrow(run, f"doc_id {dict(counts.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Weights of all rows of ``docs`` (``doc_id``, ``text``) towards the texts of ``target``."""
    source = durable(counted(docs, buckets))
    wanted = counted(target.select(F.lit(0).alias("doc_id"), "text"), buckets)
    return weights(source, gains(bucket_totals(source, buckets), bucket_totals(wanted, buckets), buckets))


def draw(weighted: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Adds ``score`` and, for the ``share`` percent of highest scores among rows of ``min_words`` or more, ``rank`` from 1."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    level = (noise.cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000 * F.ln(-F.ln(level)))
    scored = durable(weighted.withColumn("score", score))
    able = F.col("n_words") >= min_words
    every = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("page", F.floor(F.col("score") / _PAGE))
    higher = Window.orderBy(F.col("page").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_pages = Window.orderBy(F.col("page").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pages = every.groupBy("page").agg(F.sum("n").alias("m")).select(
        "page", F.coalesce(F.sum("m").over(higher), F.lit(0)).alias("before"), F.sum("m").over(all_pages).alias("able"))
    pages = pages.selectExpr("page", "before", f"able * {share} div 100 AS drawn")
    inside = Window.partitionBy("page").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = every.join(pages, "page").select(
        "score", "drawn", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("offset"))
    offsets = durable(offsets.filter("offset < drawn"))
    # a row a score: under 2^18 of them, see above
    best = scored.filter(able).join(F.broadcast(offsets), "score")
    once = best.groupBy("doc_id", "n_words", "n_features", "weight", "score", "offset", "drawn").agg(F.count("*").alias("n"))
    place = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    once = once.withColumn("offset", F.col("offset") + F.coalesce(F.sum("n").over(place), F.lit(0)))
    ranked = once.withColumn("rank", F.explode(F.sequence(F.col("offset") + 1, F.col("offset") + F.col("n"))))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    rest = scored.join(F.broadcast(offsets.select("score", F.lit(True).alias("best"))), "score", "left").filter(
        ~(able & F.col("best").isNotNull()))
    return ranked.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn."""
    return docs.join(drawn.filter("rank IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
