"""Document quality by Bradley-Terry ranking.

A document's strength is linear in features of its words and bytes. Weights come from preference pairs, a
good document over a bad one, by logistic loss on the difference of their features. Strengths are then cut
at a quantile: the one that tells best between the labels of a fold the weights haven't seen; the score is a
logistic function of strength that passes ``CUT`` there.

Every labelled row outside fold 0 is used: its features, a few numbers, are stored, and fits and the cut are sums over
those in tasks. Pairs are drawn inside blocks of some ``BLOCK_ROWS`` rows: each row of the class that is the larger there stands in
``PAIRS`` pairs, those of the other in as many or more; rows of a rare class stand in several blocks so that each has some.
Scoring is one pass over whole texts; documents stay where they are read.

Null and empty texts have all features 0. Without good or without bad labels every score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.labelled import logistic_fit_table, sigmoid, steady, training_features
from flowloom.llm.textbytes import ALNUM, PLAIN, Block, blocks, small_batches, text_of
from flowloom.session import durable

BLOCK_ROWS = 256
RARE_ROWS = 16
PAIRS = 8
CUT = 0.3
BIN_ROWS = 100_000
_CLASSES = np.stack([
    np.array([0x41 <= b <= 0x5A for b in range(256)]),
    np.array([0x30 <= b <= 0x39 for b in range(256)]),
    np.array([chr(b) in "#$%&*@^~=+<>_/\\" for b in range(256)]),
    np.array([chr(b) in "|" for b in range(256)]),
    np.array([chr(b) in "!?" for b in range(256)]),
    np.array([chr(b) in ".,;:" for b in range(256)]),
    np.array([b == 0x0A for b in range(256)]),
    np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)]),
])


def _per(amount: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return amount / np.maximum(1, whole)


def features(block: Block) -> np.ndarray:
    """A row of features for each text of the block."""
    size = np.diff(block.offsets)
    at = block.offsets
    share = []
    for member in _CLASSES:
        total = np.concatenate([[0], np.cumsum(member[block.buf])])
        share.append(_per(total[at[1:]] - total[at[:-1]], size))
    plain, words = block.words(PLAIN), block.words(ALNUM, lower=True)
    n_plain, n = plain.counts(), words.counts()
    text = np.repeat(np.arange(len(block)), n)
    h = words.hashes()
    order = np.lexsort((h, text))
    ts, hs = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (ts[1:] != ts[:-1]) | (hs[1:] != hs[:-1])
    unlike = np.bincount(ts[new], minlength=len(block))
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(h)))
    most = np.zeros(len(block))
    np.maximum.at(most, ts[start], run)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
    same = np.bincount(text[again], minlength=len(block))
    length = (words.ends - words.starts).astype(float)
    letters = np.bincount(text, weights=length, minlength=len(block))
    longest = np.zeros(len(block))
    np.maximum.at(longest, text, length)
    out = [*share, np.log1p(size), np.log1p(n), _per(letters, n), np.log1p(longest), _per(unlike, n), _per(most, n),
           _per(same, n), _per(n_plain, n), np.log1p(_per(n, 1 + share[6] * size))]
    return np.where(size[:, None] > 0, np.stack(out, axis=1), 0.0)


class Ranker:
    """Feature scaling, Bradley-Terry weights and the cut; its size is fixed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread, self.weights, self.slope, self.cut, self.quantile = mean, spread, None, 1.0, 0.0, 0.0

    def bent(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -4, 4)
        return np.concatenate([z, z * z], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.bent(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        return sigmoid(self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT)))


def _feature_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                x = features(block)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(block.first, len(block)) for c in keep], lists], [*keep, "x"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, x array<double>")


def _in_blocks(rows: DataFrame, n_good: int, n_bad: int, width: int) -> DataFrame:
    """``block``, ``good`` and ``bad``: the features of each block's rows, end to end."""
    rare = 1 if n_good <= n_bad else 0
    count = -(-(n_good + n_bad) // BLOCK_ROWS)
    copies = min(count, -(-RARE_ROWS * count // min(n_good, n_bad)))
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rare, copies - 1).otherwise(0))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(count)) + F.col("copy") * (count // copies)
    dealt = dealt.select(F.pmod(place, F.lit(count)).alias("block"), "doc_id", "label", "x")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        label, x = table.column("label").to_numpy(), np.array(table.column("x").to_pylist(), dtype=float).reshape(-1, width)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "good": pa.array([x[label == 1].ravel()], pa.list_(pa.float64())),
                         "bad": pa.array([x[label != 1].ravel()], pa.list_(pa.float64()))})

    return durable(dealt.groupBy("block").applyInArrow(run, "block long, good array<double>, bad array<double>"))


def _weights(ranker: Ranker, rows: DataFrame, n_good: int, n_bad: int) -> np.ndarray:
    """Bradley-Terry weights: pairs are drawn anew, and alike, in each round of the fit."""
    width = len(ranker.mean)

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(batch.num_rows):
            good, bad = (ranker.bent(batch.column(c)[k].values.to_numpy().reshape(-1, width)) for c in ("good", "bad"))
            if not len(good) or not len(bad):
                continue
            n, draw = PAIRS * max(len(good), len(bad)), np.random.default_rng(batch.column("block")[k].as_py())
            of_good, of_bad = (np.concatenate([draw.permutation(m) for _ in range(-(-n // m))])[:n] for m in (len(good), len(bad)))
            yield good[of_good] - bad[of_bad], np.ones(n)

    return logistic_fit_table(_in_blocks(rows, n_good, n_bad, width), pairs, 2 * width)


def _best_cut(rows: DataFrame, n: int, n_good: int) -> tuple[int, float, float]:
    """Of ``strength`` in order: how many rows to call bad for the fewest errors, the last one's strength and the next one's.

    Rows are ranked in bins of strength, each a window of its own after the counts of those below.
    """
    n_bins = n // BIN_ROWS
    edges = rows.select(F.percentile_approx("strength", [(k + 1) / (n_bins + 1) for k in range(n_bins)], 10_000)).first()[0] if n_bins else []
    at = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]).cast("array<double>"), lambda e: e < F.col("strength")))
    binned = rows.withColumn("bin", at)
    sizes = sorted(binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect())  # a row a bin
    below, so_far = [], (0, 0)
    for r in sizes:
        below.append((r.bin, *so_far))
        so_far = (so_far[0] + r.n, so_far[1] + r.good)
    below = rows.sparkSession.createDataFrame(below, "bin int, n_below long, good_below long")
    up = Window.partitionBy("bin").orderBy("strength", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = binned.join(F.broadcast(below), "bin").select("strength", (F.col("n_below") + F.count("*").over(up)).alias("place"),
                                                          (F.col("good_below") + F.sum("label").over(up)).alias("good"))
    wrong = 2 * F.col("good") - F.col("place") + (n - n_good)  # errors if all up to here are called bad
    ranked = durable(ranked.withColumn("wrong", wrong))
    best = ranked.agg(F.min_by(F.struct("place", "strength"), F.struct("wrong", "place")).alias("best")).first().best
    above = ranked.filter(F.col("place") == best.place + 1).first()
    return best.place, best.strength, best.strength if above is None else above.strength


def train_quality(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Learns from ``labels`` (``doc_id``, ``quality``) outside fold 0 and the texts of ``docs``."""
    small_batches(docs.sparkSession)
    rows = training_features(docs, labels, "quality", _feature_rows)
    groups = rows.groupBy((F.col("fold") == 4).alias("kept"), (F.col("label") == 1).alias("good")).count().collect()  # at most four
    counts = {(r.kept, r.good): r["count"] for r in groups}
    rows = rows.withColumn("label", (F.col("label") == 1).cast("int"))
    first, last = ([counts.get((kept, good), 0) for good in (True, False)] for kept in (False, True))
    both = [a + b for a, b in zip(first, last)]
    if not all(both):
        return Ranker(np.zeros(1), np.ones(1))
    width = len(rows.select("x").first().x)
    told = rows.agg(*[F.avg(F.col("x")[k]) for k in range(width)], *[F.stddev_pop(F.col("x")[k]) for k in range(width)]).first()
    told = steady(np.array(told, dtype=float))
    ranker = Ranker(told[:width], np.maximum(told[width:], 1e-9))
    seen, n_seen = (rows.filter("fold < 4"), first) if all(first) else (rows, both)
    ranker.weights = _weights(ranker, seen, *n_seen)
    test, n_test = (rows.filter("fold = 4"), last) if all(last) else (seen, n_seen)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(ranker.strength(x))], ["doc_id", "label", "strength"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    test = durable(test.mapInArrow(strengths, f"doc_id {kind}, label int, strength double"))
    place, strength, above = _best_cut(test, sum(n_test), n_test[0])
    ranker.quantile, ranker.cut = place / sum(n_test), (strength + above) / 2

    def points(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        s = batch.column("strength").to_numpy()
        yield np.stack([np.ones(len(s)), s], axis=1), batch.column("label").to_numpy().astype(float)

    ranker.slope = max(1e-3, float(logistic_fit_table(test, points, 2)[1]))
    return ranker


def score_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score`` (0 to 1, ``CUT`` at the learned quantile)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(text_of(batch)):
                score = shared.value.score(features(block))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(block.first, len(block)), pa.array(score)], ["row", "score"])

    return rows.mapInArrow(run, f"`row` {rows.schema['row'].dataType.simpleString()}, score double")
