import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowloom.llm.bpe import Encoder, Shared, Vocabulary, bpe_decode, bpe_encode
from flowloom.llm.token_counts import context_totals, length_histogram, length_quantiles, totals_at

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def test_like_the_library_on_random_texts(library, vocabulary):
    rnd = random.Random(3)
    parts = ["a", "b", "th", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "'s", "'", "1", "é", "漢", "😀", "<|endoftext|>", "!", "​"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(4000)]
    texts += [p * 90 for p in parts] + ["ab=" * 3000, "", " ", "x" * 70 + " " + "y" * 64]
    for text, got in zip(texts, Encoder(vocabulary).encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert memoryview(got).cast("i").tolist() == ids
        assert vocabulary.decode(__import__("numpy").array(ids, dtype=int)).decode(errors="replace") == library.decode(ids, skip_special_tokens=False)


def test_memory_of_pieces_may_overflow(vocabulary, library, monkeypatch):
    monkeypatch.setattr("flowloom.llm.bpe.REMEMBERED", 3)
    encoder = Encoder(vocabulary)
    for text in ["one two three four", "five six one", "two five nine ten", "one one"]:
        assert memoryview(encoder.encode([text])[0]).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows_and_columns_pass(spark, docs_of, odd, library):
    docs, shared = docs_of(odd), Shared(spark, PATH)
    coded = bpe_encode(docs, shared)
    assert coded.columns == ["doc_id", "lang", "row", "score", "ids"]
    back = bpe_decode(coded, shared, text="row").collect()
    want = Counter((i, t or "") for i, t in odd)
    assert Counter((r.doc_id, r.row) for r in back) == want
    for r in back:
        assert list(r.ids) == library.encode(r.row, add_special_tokens=False).ids


def test_empty_table(spark, docs_of):
    shared = Shared(spark, PATH)
    assert bpe_decode(bpe_encode(docs_of([]), shared), shared).count() == 0
    assert context_totals(length_histogram(docs_of([]).selectExpr("1 AS n_tokens"))).count() == 0


def test_context_totals(spark):
    rnd = random.Random(5)
    lengths = [rnd.choice([0, 3, 7, 1023, 1024, 1025, rnd.randint(0, 9000)]) for _ in range(700)] + [None]
    rows = spark.createDataFrame([(n,) for n in lengths], "n_tokens int")
    totals = context_totals(length_histogram(rows))
    known = [n or 0 for n in lengths]
    got = {r.n_tokens: r for r in totals.collect()}
    assert set(got) == set(known)
    for n, r in got.items():
        upto, over = [x for x in known if x <= n], [x for x in known if x > n]
        assert (r.n_docs, r.docs_upto, r.docs_over) == (known.count(n), len(upto), len(over))
        assert (r.tokens_upto, r.tokens_over, r.truncated_total) == (sum(upto), sum(over), sum(min(x, n) for x in known))
        assert r.cum_share == pytest.approx(len(upto) / len(known))
    limits = spark.createDataFrame([(0,), (5,), (2000,), (10**6,)], "context_limit long")
    assert {r.context_limit: r.truncated_total for r in totals_at(totals, limits).collect()} == {
        x: sum(min(n, x) for n in known) for x in (0, 5, 2000, 10**6)}
    for r in length_quantiles(totals, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(n for n in known if sum(x <= n for x in known) >= r.share * len(known) - 1e-9)
