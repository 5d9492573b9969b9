from collections import Counter

import corpus_pipeline
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_simhash import classes, fingerprint


def test_stages_follow_each_other(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    kept = corpus_pipeline.toxicity(spark, docs, sf_small)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    clean = {r.doc_id for r in docs.collect() if labels.get(r.doc_id) == 0}
    assert len(clean & left) >= 0.97 * len(clean)

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    once = corpus_pipeline.exact(spark, docs, sf_small)
    want = {k[0] for k in exact_brute(rows) if k[3]}
    assert {r.doc_id for r in once.collect()} == want and once.columns == docs.columns

    near = corpus_pipeline.near(spark, docs, sf_small)
    fp = {i: fingerprint(t) for i, t in rows}
    root, least = classes(fp.values()), {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {r.doc_id for r in near.collect()} == set(least.values()) and near.columns == docs.columns

    items = [r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    spared = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, sf_small).collect()}
    assert {i for i, t in rows if any(x in t for x in items)} == {i for i, _ in rows} - spared


def test_run(spark, sf_small):
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, sf_small)
    ids = Counter(r.doc_id for r in out.collect())
    assert ids and max(ids.values()) == 1 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_documents(spark, docs_of, odd, sf_small):
    docs = docs_of(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).columns == docs.columns
        assert stage(spark, docs.filter("false"), sf_small).count() == 0
    left = corpus_pipeline.exact(spark, docs, sf_small).collect()
    assert Counter(r.doc_id for r in left) == Counter([1, 3, 4, 7, 8, 9])


def test_rows_that_share_an_id(spark, docs_of, sf_small):
    docs = docs_of([(3, "dup"), (5, "own"), (5, "dup"), (5, "own"), (None, "dup"), (None, "alone")])
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        left = Counter((r.doc_id, r.text) for r in stage(spark, docs, sf_small).collect())
        assert left == Counter([(3, "dup"), (5, "own"), (5, "own"), (None, "alone")])
