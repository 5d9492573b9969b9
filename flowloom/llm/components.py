"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import durable


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one batch, replaced by a star around the smallest member of each of its components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        star = [(v, root(v)) for v in list(parent)]
        star = np.array([s for s in star if s[0] != s[1]], dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(star[:, 0]), pa.array(star[:, 1])], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``a``, ``root`` (the smallest reachable value) for each value that appears in a link between two different values.

    ``links`` has the long columns ``a`` and ``b``. Each round is written to the shared checkpoint folder; rounds
    grow with the logarithm of the longest chain. Every value keeps a single link to its smallest neighbour per
    round and minima are combined before the exchange, so a value with very many links is no bottleneck.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = durable(edges.mapInArrow(_local_forest, "a long, b long").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select("a", F.col("b").alias("root"))
