import random
import re

import pytest

from flowloom.llm import substring_dedup
from flowloom.llm.substring_dedup import _listed, _rows, _suffix_rows, repeated_spans, without_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(docs, window, prefix, crowd):
    got = without_spans(docs, repeated_spans(docs, window, prefix, crowd))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str)


@pytest.mark.parametrize("crowd", [0, 2, 12, 40, 4000])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(docs_of, crowd, seed):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choices("abcde", k=rnd.randint(4, 25))) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices("abcdefghij", k=rnd.randint(0, 9))) for _ in range(4)]
        rows.append((rnd.randint(0, 70), rnd.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(None, passages[0]), (500, passages[0]), (501, None), (502, ""), (503, "a " * 60), (504, "a " * 50), (505, "a")]
    assert run(docs_of(rows), 6, 3, crowd) == brute(rows, 6)


def test_production_window(docs_of, odd):
    rnd = random.Random(4)
    line = [f"w{rnd.randint(0, 10**6)}" for _ in range(400)]
    rows = [*odd, (100, " ".join(line)), (101, " ".join(line[30:80])), (102, "x " + " ".join(line[100:149])), (103, " ".join(line[200:260]) + " end"),
            (104, " ".join(line[:60] + ["new"] + line[61:])), (99, " ".join(line[390:])), (105, "word " * 60)]
    assert run(docs_of(rows), 50, 16, 4000) == brute(rows, 50)
    assert run(docs_of(rows), 50, 16, 0) == brute(rows, 50)


def test_empty(docs_of):
    assert run(docs_of([]), 50, 16, 4000) == []


def test_groups_are_bounded_by_suffixes(docs_of):
    """One document repeats a header 10,000 times, each time between other words; others share some of it."""
    rnd = random.Random(9)
    header = [f"h{i}" for i in range(20)]
    pages = [[*header, *(f"p{rnd.randint(0, 10**9)}" for _ in range(40))] for _ in range(10_000)]
    around = [f"a{i}" for i in range(20)] + header + [f"b{i}" for i in range(20)]
    rows = [(7, " ".join(w for page in pages for w in page)), (8, " ".join(pages[5] + ["end"])), (9, " ".join(pages[77][10:])),
            (10, " ".join(around)), (11, " ".join(["x", *around, "y"])), (12, " ".join(pages[3][15:] + pages[4][:45])), (None, " ".join(pages[6]))]
    listed = _listed(_rows(docs_of(rows), "doc_id", "text").filter("doc_id is not null"), 50, 16, 500)
    groups = _suffix_rows(listed, 50, 16).groupBy("key").count().toPandas()["count"]
    assert 2 <= groups.max() <= 500
    for crowd in (500, 4000):
        assert run(docs_of(rows), 50, 16, crowd) == brute(rows, 50)


def test_middle_lengths_are_used(docs_of):
    rnd = random.Random(3)
    shared = [f"s{i}" for i in range(30)]  # a window around it has its minimiser there about as often as not
    rows = [(i, " ".join([*(f"l{i // 2}x{k}" for k in range(40)), *shared, *(f"r{i // 2}x{k}" for k in range(40)), f"e{rnd.random()}"])) for i in range(60)]
    listed = _listed(_rows(docs_of(rows), "doc_id", "text"), 50, 16, 10)
    kinds = {(r.low, r.high) for r in _suffix_rows(listed, 50, 16).select("low", "high").distinct().collect()}
    assert len(kinds) > 1
    assert run(docs_of(rows), 50, 16, 10) == brute(rows, 50)


def test_null_ids_stay_out_of_exchanges(docs_of):
    rows = [(None, "a b c d e f g")] * 200 + [(1, "a b c d e f g"), (2, "a b c d e f g")]
    assert run(docs_of(rows), 6, 3, 4000) == brute(rows, 6)
    listed = _listed(_rows(docs_of(rows), "doc_id", "text").filter("doc_id is not null"), 6, 3, 4000)
    assert listed.filter("doc_id is null").isEmpty() and listed.count() == 2


@pytest.mark.parametrize("copies", [40, 80])
def test_copies_of_a_crowded_passage_are_few_rows(docs_of, copies):
    """A copy costs a row for many windows, and no copy but the first is taken apart into windows."""
    rnd = random.Random(6)
    line = [f"w{rnd.randint(0, 10**6)}" for _ in range(300)]  # 251 windows
    rows = [(i, " ".join(line)) for i in range(copies)] + [(i, " ".join([f"x{i}", *line[100:200], f"y{i}"])) for i in range(1000, 1004)]
    listed = _listed(_rows(docs_of(rows), "doc_id", "text").filter("doc_id is not null"), 50, 16, 10)
    stretches = substring_dedup._stretch_rows(listed, 50, 16)
    assert 0 < stretches.count() < 60 * len(rows)
    assert substring_dedup._windows(stretches).count() <= 251 + 4 * 53
    assert run(docs_of(rows), 50, 16, 10) == brute(rows, 50)


def test_stretches_of_repeating_words(docs_of):
    """One minimiser value all along: stretches are cut, shared only in part, and stand at many places."""
    rows = [(i, "a " * n + end) for i, (n, end) in enumerate([(700, ""), (130, "b"), (130, "b c"), (49, "b"), (700, "b " + "a " * 60), (0, "x " + "a " * 51)])]
    for crowd in (0, 2):
        assert run(docs_of(rows), 50, 16, crowd) == brute(rows, 50)
