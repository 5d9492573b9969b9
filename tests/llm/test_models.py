import binascii
import random

import numpy as np
import pyarrow as pa
import pytest

from flowloom.llm import quality
from flowloom.llm.labelled import training_features
from flowloom.llm.quality import _feature_rows, _in_blocks, score_quality, train_quality
from flowloom.llm.queries import op6_toxicity, op9_quality
from flowloom.llm.textbytes import ALNUM, PLAIN, blocks, gram_hashes
from flowloom.llm.toxicity import maximal_segments, score_toxicity, train_toxicity


def held_out(spark, sf_dir, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    pairs = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s, _ in pairs if y], [s for y, s, _ in pairs if not y]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    return area, np.mean([y == p for y, _, p in pairs])


def test_toxicity_on_held_out_labels(spark):
    area, right = held_out(spark, "/root/testdata/sf0.1", op6_toxicity, "toxic")
    assert area > 0.94 and right > 0.97


def test_quality_on_held_out_labels(spark):
    area, right = held_out(spark, "/root/testdata/sf0.1", op9_quality, "quality")
    assert area > 0.99 and right > 0.98


def brute_segments(values):
    """Maximal segments by their definition: the best segment, then those of what lies left and right of it."""
    best = None
    for a in range(len(values)):
        total = 0
        for b in range(a, len(values)):
            total += values[b]
            if total > 0 and (best is None or total > best[2]):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, _ = best
    return brute_segments(values[:a]) + [best] + [(x + b, y + b, s) for x, y, s in brute_segments(values[b:])]


def test_all_maximal_segments():
    rnd = random.Random(7)
    for _ in range(300):
        values = [rnd.choice([-1, 1]) * rnd.random() for _ in range(rnd.randint(0, 25))]
        up = [i for i, v in enumerate(values) if v > 0]
        got = maximal_segments(up, [values[i] for i in up], [sum(values[:i]) for i in up])
        want = brute_segments(values)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


@pytest.mark.parametrize("train,score,label", [(train_toxicity, score_toxicity, "toxic"), (train_quality, score_quality, "quality")])
def test_odd_inputs(spark, docs_of, odd, train, score, label):
    docs = docs_of(odd)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (5, None), (None, 1), (7, 1), (8, 0), (999, 1)], f"doc_id long, {label} int")
    for own in (labels, labels.filter(f"{label} = 1"), labels.filter("false")):
        model = train(docs, own)
        rows = score(docs, model).collect()
        assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
        assert score(docs.filter("false"), model).count() == 0
    assert train(docs.filter("false"), labels) is not None


def test_word_hashes_follow_the_bytes_only():
    rnd = random.Random(9)
    texts = ["".join(rnd.choices("ab é\n|.", k=rnd.randint(0, 40))) for _ in range(200)] + [None, "", "x" * 200_000 + " y", "z" * 200_000]
    for member, cut in ((PLAIN, lambda t: t.encode().split()), (ALNUM, None)):
        seen = {}
        for limit in (1, 64, 1 << 20):
            for block in blocks(pa.array(texts), limit):
                words = block.words(member)
                spans = [block.buf[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
                for w, h in zip(spans, words.hashes().tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
                if cut:
                    own = [w for t in texts[block.first:block.first + len(block)] for w in cut(t or "")]
                    assert spans == own
        assert len(set(seen.values())) == len(seen)
    h = np.arange(50, dtype=np.uint64) % np.uint64(7)
    grams = gram_hashes(h, 3)
    assert len({*grams.tolist()}) == 7 and (grams[:-7] == grams[7:]).all()


@pytest.mark.parametrize("missing", [0, 1])
def test_calibration_fold_of_one_class(spark, docs_of, missing):
    of = {i: binascii.crc32(str(i).encode()) % 5 for i in range(400)}
    toxic = {i: int(i % 3 == 0) if f < 4 else 1 - missing for i, f in of.items()}
    docs = docs_of([(i, f"plain words about item {i} " * 3 + ("vile slur again and again" if y else "kind talk all day long")) for i, y in toxic.items()])
    labels = spark.createDataFrame([(i, y) for i, y in toxic.items() if of[i]], "doc_id long, toxic int")
    got = {r.row.doc_id: r.score for r in score_toxicity(docs, train_toxicity(docs, labels)).select("row", "score").collect()}
    held = [i for i, f in of.items() if f == 0]
    assert min(got[i] for i in held if toxic[i]) >= 0.5 > max(got[i] for i in held if not toxic[i])


def test_quality_reads_the_corpus_once_to_train(spark, docs_of):
    texts = docs_of([(i, f"text {i} of words " + "bad " * (i % 2)) for i in range(60)])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    train_quality(texts.mapInArrow(counted, texts.schema), labels)
    assert read.value == 60


def test_quality_learns_from_every_label(spark, docs_of):
    """Any labelled row tells: what the features' means are taken over, and which blocks pairs are drawn in."""
    n = 4000
    docs = docs_of([(i, f"text {i} of words " + "bad " * (i % 2) + "x" * (i % 50)) for i in range(n)])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(n)], "doc_id long, quality int")
    rows = training_features(docs, labels, "quality", _feature_rows)
    kept = {i for i in range(n) if binascii.crc32(str(i).encode()) % 5}
    assert {r.doc_id for r in rows.select("doc_id").collect()} == kept
    n_good = rows.filter("label = 1").count()
    blocks = _in_blocks(rows, n_good, len(kept) - n_good, 17).collect()
    assert len(blocks) > 1 and sum(len(b.good) + len(b.bad) for b in blocks) == 17 * len(kept) and all(b.good and b.bad for b in blocks)


def test_rare_class_stands_in_every_block(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "cast(id < 3 as int) as label", "array(double(id)) as x")
    blocks = _in_blocks(rows, 3, 2997, 1).collect()
    assert all(len(b.good) == 3 for b in blocks) and sum(len(b.bad) for b in blocks) == 2997


def test_cut_over_bins_is_the_cut_over_all(spark, monkeypatch):
    rnd = random.Random(3)
    pairs = [(rnd.choice([0.1, 0.2, 0.5, rnd.random()]), rnd.random()) for _ in range(500)]
    rows = [(i, int(s + 0.5 * r > 0.8), s) for i, (s, r) in enumerate(pairs)]
    table = spark.createDataFrame(rows, "doc_id long, label int, strength double")
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    y = np.array([r[1] for r in order])
    best = int(np.argmin(np.cumsum(y) + (1 - y).sum() - np.cumsum(1 - y)))
    want = (best + 1, order[best][2], order[min(best + 1, 499)][2])
    for size in (100_000, 40):
        monkeypatch.setattr(quality, "BIN_ROWS", size)
        assert quality._best_cut(table, 500, int(y.sum())) == want
