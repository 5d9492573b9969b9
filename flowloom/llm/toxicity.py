"""Toxic passages as maximum-scoring segments.

Lexicon. Words and their first ``STEMS`` bytes, hashed to ``1 << BITS`` buckets, get the log-odds of
standing in toxic against clean documents, under a Dirichlet prior over (stands there, doesn't) that
follows the share of all documents of the corpus that have the bucket; the part that
``CONFIDENCE`` standard deviations leave of it is the score, so words with little evidence score nothing. A word counts by the
highest of its own score and those of its stems.

Scan. A word's score less ``DRIFT`` is summed along the text; one linear scan over the words of positive
score finds all maximal segments.

Calibration. The best segment of a clean text of ``n`` words follows an extreme-value law: its score,
scaled by the root of sum p(word) exp(lambda score) = 1 and less the logarithm of K n, is Gumbel. A
passage is significant if that many words of clean text hold fewer than ``E_VALUE`` such segments. The
sum of the standardised scores of a document's best passages (with the logarithm of their number's
factorial, as for sums of ordered extreme values; the number that makes most of it) tells how toxic it
is; its score is a logistic function of that sum, fitted on a fold that the lexicon hasn't seen, or on
all sampled rows where that fold lacks a class.

Corpus counts cover every document. The labelled rows used are a sample of at most ``TRAIN_ROWS``
(parameter), which bounds what is broadcast; the lexicon's size is fixed by ``BITS``.

Null and empty texts have no words and get the lowest score. Without toxic or without clean labels
every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.labelled import logistic_fit, sigmoid, training_sample
from flowloom.llm.textbytes import ALNUM, Block, blocks, mix, small_batches, text_of
from flowloom.session import durable

BITS = 21
STEMS = (4, 5, 6)
TRAIN_ROWS = 50_000
PRIOR = 0.5
PRIOR_DOCS = 10.0
CONFIDENCE = 1.96
DRIFT = 0.3
E_VALUE = 0.01


def _buckets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and its stems (a row for each kind), and where each text's words start."""
    words = block.words(ALNUM, lower=True)
    kinds = [words.hashes(), *[mix(words.hashes(size) + np.uint64(size)) for size in STEMS]]
    return (np.stack(kinds) >> np.uint64(64 - BITS)).astype(np.int64), words.first


def _counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``bucket``, ``all``, ``clean``, ``toxic``: documents with each bucket, in the corpus and among labels; bucket -1 has their numbers."""
    joined = docs.select("doc_id", "text").join(F.broadcast(sample.filter("fold < 4").select("doc_id", "label")), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros((3, 1 << BITS), dtype=np.int32), np.zeros(3, dtype=np.int64)
        for batch in batches:
            kind = batch.column("label").fill_null(-1).to_numpy() + 1
            total += [len(kind), (kind == 1).sum(), (kind == 2).sum()]
            for block in blocks(batch.column("text")):
                bucket, first = _buckets(block)
                text = np.repeat(np.arange(len(block)), np.diff(first))
                once = np.unique((text << BITS | bucket).ravel())
                of, bucket = kind[block.first + (once >> BITS)], once & ((1 << BITS) - 1)
                np.add.at(held[0], bucket, 1)
                for k in (1, 2):
                    np.add.at(held[k], bucket[of == k], 1)
        names = ["bucket", "all", "clean", "toxic"]
        yield pa.RecordBatch.from_arrays([pa.array([-1], type=pa.int32()), *[pa.array([n]) for n in total]], names)
        used = np.flatnonzero(held[0])
        for a in range(0, len(used), 100_000):
            part = used[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(h[part].astype(np.int64)) for h in held]], names)

    return (joined.mapInArrow(run, "bucket int, all long, clean long, toxic long").groupBy("bucket")
            .agg(F.sum("all").alias("all"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))


def _lexicon(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each bucket; and for the rate the scores that aren't 0 with their shares of clean words, then 0 and the rest.

    Scores are computed by Spark. What comes to the driver is at most one row a bucket, in fact the few with evidence.
    """
    counts = durable(counts)
    docs = counts.filter("bucket = -1").agg(*[F.sum(c).alias(c) for c in ("all", "clean", "toxic")]).first()
    n, n_clean, n_toxic = (docs[c] or 0 for c in ("all", "clean", "toxic"))
    rate = F.col("all") / max(1, n) * PRIOR_DOCS
    there, without = rate + PRIOR, PRIOR + PRIOR_DOCS - rate
    terms = counts.filter("bucket >= 0").select(
        "bucket", (F.col("toxic") + there).alias("a"), (F.col("clean") + there).alias("b"),
        (F.lit(n_toxic) - F.col("toxic") + without).alias("na"), (F.lit(n_clean) - F.col("clean") + without).alias("nb"))
    odds = F.log(F.col("a") / F.col("na")) - F.log(F.col("b") / F.col("nb"))
    sure = F.abs(odds) - CONFIDENCE * F.sqrt(sum(1 / F.col(c) for c in ("a", "b", "na", "nb")))
    scored = terms.select("bucket", "b", F.when(sure > 0, F.signum(odds) * sure).otherwise(0.0).alias("score"))
    told = scored.filter("score <> 0").toArrow()
    bucket, score, share = (told.column(c).to_numpy() for c in ("bucket", "score", "b"))
    rest = scored.filter("score = 0").agg(F.sum("b")).first()[0] or 0.0
    table = np.zeros(1 << BITS, dtype=np.float32)
    table[bucket] = score
    total = max(share.sum() + rest, 1e-9)
    return table, np.append(score, 0.0), np.append(share, rest) / total


def _rate(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share exp(rate (score - drift)) = 1."""
    step = score[share > 0] - DRIFT
    share = share[share > 0]
    low, high = 1e-3, 1e-3
    while high < 64 and (share * np.exp(np.minimum(high * step, 500))).sum() < 1:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * step, 500))).sum() < 1 else (low, mid)
    return high


def maximal_segments(place: list[int], gain: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments (start, stop, score) of a sequence, given its positive members.

    ``place``: their positions; ``gain``: their scores; ``before``: the sum of all members left of each. Candidates
    wait in a list. A new one looks for the nearest candidate that starts from a lower sum; if that one also ends
    on a lower sum the two join, and the joined one looks again. Each candidate is skipped or joined once.
    """
    kept: list[list] = []  # start, stop, sum before, sum after, nearest candidate with a lower sum before
    for i, g, left in zip(place, gain, before, strict=True):
        new = [i, i + 1, left, left + g, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, end - begin) for a, b, begin, end, _ in kept]


class Model:
    """Word scores and the calibration; its size is fixed."""

    def __init__(self, score: np.ndarray, rate: float):
        self.score, self.rate, self.log_k, self.weights = score, rate, 0.0, None

    def passages(self, block: Block) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Number of words and maximal segments of each text."""
        bucket, first = _buckets(block)
        step = self.score[bucket].max(axis=0).astype(np.float64) - DRIFT
        total = np.concatenate([[0.0], np.cumsum(step)])
        up = np.flatnonzero(step > 0)
        cut = np.searchsorted(up, first)
        for t in range(len(block)):
            own = up[cut[t]:cut[t + 1]]
            found = maximal_segments((own - first[t]).tolist(), step[own].tolist(), (total[own] - total[first[t]]).tolist()) if len(own) else []
            yield int(first[t + 1] - first[t]), found

    def standard(self, best: float, words: int) -> float:
        return self.rate * best - np.log(max(1, words)) - self.log_k

    def total(self, scores: list[float], words: int) -> float:
        """The largest sum of standardised scores over the best passages of a text."""
        if not scores:
            return self.standard(0.0, words)
        each = self.standard(1.0, words) + self.rate * (np.sort(np.array(scores))[::-1] - 1.0)
        each = each[:max(1, int((each > 0).sum()))]
        return float(np.cumsum(each + np.log(np.arange(1, len(each) + 1))).max())

    def chance(self, standard: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(standard))
        return sigmoid(self.weights[0] + self.weights[1] * _bent(standard))


def _bent(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(np.clip(x, -30, 30))) + np.maximum(0, np.log1p(np.maximum(0, x - 30)))


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from ``labels`` (``doc_id``, ``toxic``) outside fold 0 and the texts of ``docs``."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, "toxic", rows).persist()
    try:
        table, score, share = _lexicon(_counts(docs, sample))
        model = Model(table, _rate(score, share))
        fresh = sample.filter("fold = 4")

        def seen() -> tuple[np.ndarray, ...]:
            rows = docs.join(F.broadcast(fresh.select("doc_id", "label")), "doc_id").select("doc_id", "text", "label")
            got = _scan(rows, model, ["label"]).select("label", "n_words", "best", "total").toArrow()
            return tuple(got.column(c).to_numpy() for c in got.column_names)

        label, words, best, _ = seen()
        if not 0 < label.sum() < len(label):
            fresh = sample
            label, words, best, _ = seen()
        clean = (model.rate * best - np.log(np.maximum(1, words)))[(label == 0) & (best > 0)]
        model.log_k = float(clean.mean() - np.euler_gamma) if len(clean) else 0.0
        label, _, _, total = seen()
    finally:
        sample.unpersist()
    if len(label) and 0 < label.sum() < len(label):
        model.weights = logistic_fit(np.stack([np.ones(len(label)), _bent(total)], axis=1), label.astype(float))
    return model


def _scan(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            words, best, total, spans = [], [], [], []
            for block in blocks(text_of(batch)):
                for n, found in known.passages(block):
                    words.append(n)
                    best.append(max((s for _, _, s in found), default=0.0))
                    total.append(known.total([s for _, _, s in found], n))
                    spans.append([{"start": a, "stop": b, "score": s} for a, b, s in found
                                  if known.standard(s, n) > -np.log(E_VALUE)])
            chance = known.chance(np.array(total, dtype=float))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(words, type=pa.int64()), pa.array(best, type=pa.float64()),
                 pa.array(total, type=pa.float64()), pa.array(spans, type=kind), pa.array(chance, type=pa.float64())],
                [*keep, "n_words", "best", "total", "passages", "score"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, n_words long, best double, total double, passages array<struct<start:int,stop:int,score:double>>, score double")


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of ``docs``) with ``n_words``, ``best`` (best segment), ``total`` (see above), ``passages`` (significant ones), ``score`` (0 to 1)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return _scan(rows, model, ["row"])
