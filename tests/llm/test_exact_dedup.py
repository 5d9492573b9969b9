import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from flowloom.llm import exact_dedup
from flowloom.llm.exact_dedup import directory, exact_groups, exact_index


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        keep = min((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_against_brute_force(docs_of, odd):
    rnd = random.Random(2)
    rows = odd + [(i, rnd.choice(["a b", "a  b", "a\n\tb", " a b", "c", f"d{i}"])) for i in range(100, 400)] + [(None, "only null"), (None, None)]
    docs = docs_of(rows).repartition(5)
    for capacity in (1, 100, 8 << 20):
        assert got(exact_groups(docs, capacity=capacity)) == brute(rows)
    index = exact_index(docs, capacity=100).collect()
    assert len({r.bucket for r in index}) > 1 and len({(r.key, r.text_sha256) for r in index}) == len(index)


def test_empty(docs_of):
    assert exact_groups(docs_of([])).count() == 0


def test_directory_splits_only_overfull_buckets():
    load = np.array([5, 5, 0, 1, 0, 0, 0, 2])
    assert directory(load, 6).tolist() == [0, 1, 2, 2, 4, 4, 4, 4]
    assert directory(load, 100).tolist() == [0] * 8
    assert directory(load, 0).tolist() == [0, 1, 2, 3, 4, 4, 6, 7]


def test_texts_are_read_once_and_not_exchanged(docs_of, monkeypatch):
    plans, durable = [], exact_dedup.durable
    monkeypatch.setattr(exact_dedup, "durable", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or durable(df))
    rows = [(i, "long text " * 1000 + str(i % 7)) for i in range(50)]
    assert got(exact_groups(docs_of(rows), capacity=100)) == brute(rows)
    reading, index = plans
    assert "sha2" in reading and "Repartition" not in reading and "MapInArrow" not in reading
    assert "MapInArrow" in index and "regexp_replace" not in index and "text#" not in index
