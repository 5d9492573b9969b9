import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from flowloom.llm.filter_audit import contingency, failures, interactions
from flowloom.llm.quality_rules import clean_lines
from flowloom.llm.resample import GainPlanes, draw, drawn_documents, gains, importance_weights

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_texts(rnd, n):
    kinds = ["the cat sat on a mat.", "Home | News | Shop | Contact", "LOUD!! WORDS!! HERE!!", "x### y$$$ z%%%", "We use: privacy policy here.",
             "no stop at the end", "Ends well!  ", "\ta\x0bb\x0cc.\r", "", "é漢 😀 (so it is)", "same line."]
    return ["\n".join(rnd.choices(kinds, k=rnd.randint(0, 25))) for _ in range(n)]


def test_audit(spark, odd):
    rnd = random.Random(2)
    rows = [(i, t, None) for i, t in odd] + [(100 + i, " ".join(rnd.choices(["a", "B", "c$", "dd", "EE"], k=rnd.choice([0, 5, 199, 200, 250]))),
                                              rnd.choice(["en", "de", None])) for i in range(120)]
    rows += [(i + 1000, t, p) for i, t, p in rows[-60:]]
    marks = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i, _, _ in rows[::2] if i is not None] + [(5, 0, 1), (5, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, [1]) for i, t, p in rows], "doc_id long, text string, lang string, digest array<int>")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in interactions(contingency(failures(docs), labels)).collect()}

    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in marks if i is not None and q == 1}, {i for i, _, x in marks if i is not None and x == 1}
    parts = defaultdict(list)
    for i, t, p in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        parts[p or ""].append(({f for f, bad in fails.items() if bad}, i in good, i in toxic))
    assert len(got) == 600 * len(parts)
    for part, cells in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                total[f] += sum(f in x and not x & set(order[:k]) for x, _, _ in cells)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                out = [c for c in cells if f in c[0] and not c[0] & before]
                want = (sum(not c[0] & (before | {f}) for c in cells), len(out), sum(f in c[0] and bool(c[0] & before) for c in cells),
                        sum(c[0] == {f} for c in cells), sum(c[1] for c in out), sum(c[2] for c in out), total[f])
                assert got[part, "".join(order), k + 1] == want


def test_audit_of_two_filters_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, "p", [True, False]), (2, "p", [True, True]), (3, "p", [False, False])], "doc_id long, part string, failed array<boolean>")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost) for r in interactions(contingency(rows, labels, 2), "XY").collect()}
    assert got == {("XY", 1): (1, 2, 0, 1), ("XY", 2): (1, 0, 1, 0), ("YX", 1): (2, 1, 0, 1), ("YX", 2): (1, 1, 1, 0)}
    assert interactions(contingency(rows.filter("false"), labels, 2), "XY").count() == 0


def rule(line):
    words = WORD.findall(line)
    if len(line) <= 300 and "privacy policy" in line.lower():
        return "boilerplate"
    cells, noisy = sum(not w.strip("|»›•·") for w in words), sum(w.endswith(("###", "$$$", "%%%", "&&&", "***", "!!")) for w in words)
    if cells >= 2 and 4 * cells >= len(words):
        return "navigation"
    if noisy >= 2 and 3 * noisy >= len(words):
        return "noise"
    return None if line.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?…。！？\"')]}”’»" else "punctuation"


def test_rules(spark, docs_of, odd):
    texts = some_texts(random.Random(4), 150) + ["w " * 60 + ".", " ".join(map(str, range(80))) + " 1 2 3.", "a b a b a b a b " * 9]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)]
    got = {}
    for r in clean_lines(docs_of(rows)).collect():
        got.setdefault(r.row.doc_id, []).append(r)
        assert r.row.row == "x" and r.row.score == 0.5
    assert Counter(i for i, _ in rows) == Counter({i: len(r) for i, r in got.items()})
    for i, t in rows:
        t, r = t or "", got[i][0]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        triples = list(zip(w, w[1:], w[2:]))
        many = Counter(triples)
        covered = {j + k for j, x in enumerate(triples) if many[x] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        verdicts = [(x, rule(x)) for x in lines]
        assert {k: v for k, v in r.removed.items() if v} == Counter(v for _, v in verdicts if v)
        lost, whole = sum(len(x) for x, v in verdicts if v), sum(len(x) for x in lines)
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.lost_chars, r.line_chars, r.base_failed, r.kept) == (lost, whole, base, not base and 100 * lost <= 50 * whole)
        assert r.cleaned == "\n".join(x for x in t.split("\n") if not WORD.search(x) or not rule(x))
    assert clean_lines(docs_of([])).count() == 0
    assert clean_lines(docs_of([(1, "Read more.\nFine.")]), boilerplate=[], min_words=1).first().kept


def test_rules_are_native(spark, docs_of):
    plan = clean_lines(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not re.search("Python|Arrow|Pandas", plan)


def features(text):
    w = ALNUM.findall((text or "").translate(LETTERS))
    return w, [f for f in w] + [f"{a} {b}" for a, b in zip(w, w[1:])]


def resampled(rows, items, share=25, least=20):
    def buckets(fs):
        return Counter(zlib.crc32(f.encode()) % 10_000 for f in fs)

    s, t = Counter(), Counter()
    for _, x in rows:
        s += buckets(features(x)[1])
    for x in items:
        t += buckets(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10_000)}
    out = []
    for i, x in rows:
        w, fs = features(x)
        weight = sum(gain[b] * n for b, n in buckets(fs).items()) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[:share * len(able) // 100])}
    return [(*r, rank.get(id(r))) for r in out]


def test_resample(spark, docs_of, odd):
    rnd = random.Random(6)
    vocabulary = ["one", "Two", "trei", "é", "漢字", "x1", "y" * 70, "z" * 500, "q", "-", "..", "\x00"]
    rows = odd + [(100 + i, rnd.choice([" ", "-", "\n"]).join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for i in range(300)]
    rows += [rows[-1]] * 7 + [(None, rows[-1][1])] * 3
    items = ["one two trei x1", "é é é", None, ""]
    target = spark.createDataFrame([(k, x, "t") for k, x in enumerate(items)], "item_id long, text string, doc_id string")
    drawn = draw(importance_weights(docs_of(rows), target))
    got = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in drawn.collect())
    assert got == Counter(resampled(rows, items))
    chosen = {r.doc_id for r in drawn.collect() if r["rank"] is not None}
    assert {r.doc_id for r in drawn_documents(docs_of(rows), drawn).collect()} == chosen - {None}


def test_resample_of_nothing(spark, docs_of):
    target = spark.createDataFrame([], "item_id long, text string")
    assert draw(importance_weights(docs_of([]), target)).count() == 0
    row = draw(importance_weights(docs_of([(1, "a b")]), target), min_words=1, share=100).first()
    assert (row.n_features, row.weight, row["rank"]) == (3, math.floor(1000 * math.log(10003 / (2 * 10000))), 1)


def test_bit_slices():
    rnd = np.random.default_rng(1)
    gain = rnd.integers(-9000, 9000, 10_000)
    gain[:3] = [-(1 << 40), (1 << 40), 0]
    dense = rnd.integers(0, 3, (5, 10_000)) * rnd.integers(0, 100_000, (5, 10_000))
    dense[3] = 0
    row, bucket = np.nonzero(dense)
    assert GainPlanes(gain).sums(row, bucket, dense[row, bucket], 5).tolist() == (dense @ gain).tolist()
    assert GainPlanes(np.zeros(7, dtype=np.int64)).sums(np.array([0]), np.array([6]), np.array([5]), 2).tolist() == [0, 0]


def test_queries_over_whole_tables(spark, sf_small):
    from flowloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in QUERIES["op13_importance_resampling"](spark, sf_small).collect()}
    assert got == {(i, n, w, s, k) for i, _, n, w, s, k in resampled(rows, items)}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in QUERIES["op12_quality_rules"](spark, sf_small).collect() if not r.base_failed}
    assert all(kept[i] == (q == 1) for i, q in labels.items() if i in kept and q is not None)


def test_gains_need_no_target(spark):
    empty = spark.createDataFrame([], "bucket int, n long")
    one = spark.createDataFrame([(3, 2)], "bucket int, n long")
    assert gains(one, empty, 8)[3] == math.floor(1000 * math.log(10 / (3 * 8)))
    with pytest.raises(IndexError):
        gains(one, empty, 2)
