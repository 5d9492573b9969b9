import random
import re
from collections import defaultdict

import pytest
import xxhash

from flowloom.llm.simhash import near_groups, near_links


def fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, distance=4):
    values, parent = sorted(set(values)), {}
    for v in values:
        parent[v] = v

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def check(docs, rows, **more):
    fp = {t: fingerprint(t) for _, t in rows}
    root = classes(fp.values())
    least = defaultdict(list)
    for i, t in rows:
        if i is not None:
            least[root[fp[t]]].append(i)
    want = sorted(((i, f"{fp[t]:016x}", min(least[root[fp[t]]], default=None)) for i, t in rows), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(docs, **more).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("crowd", [1, 3, 2000])
def test_documents(docs_of, odd, crowd):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choices(words, k=120) for _ in range(5)]
    rows = [*odd, (None, "only here"), (600, "One two"), (601, "one  TWO")]
    for i in range(120):
        text = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((1000 + rnd.randint(0, 100), " ".join(text)))
    check(docs_of(rows), rows, crowd=crowd)


@pytest.mark.parametrize("crowd", [1, 4, 10**6])
def test_links_join_all_that_are_near(spark, crowd):
    rnd = random.Random(8)
    values = set()
    for _ in range(6):
        v = rnd.getrandbits(64)
        for _ in range(60):
            v ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 5, 6])))
            values.add(v)
    low = rnd.getrandbits(64)
    values |= {low ^ x for x in range(0, 256, 3)} | {0, (1 << 64) - 1, 1 << 63}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    links = near_links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), 4, crowd).collect()
    back = {s: v for v, s in signed.items()}
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in links:
        a, b = back[r.a], back[r.b]
        assert (a ^ b).bit_count() <= 4
        parent[root(b)] = root(a)
    want, got = defaultdict(set), defaultdict(set)
    for v, r in classes(values).items():
        want[r].add(v)
    for v in values:
        got[root(v)].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty(docs_of):
    assert near_groups(docs_of([])).count() == 0
