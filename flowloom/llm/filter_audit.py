"""How filters of a corpus overlap: what each removes at each place of every order in which they may be applied.

A document's failures are a cell of a 2 x 2 x ... x 2 tensor, one axis a filter. Documents are counted by part and cell where
they are read, so a part of any size arrives as at most 2^filters rows. One contraction then answers every step of every order:
along each axis it selects pass, fail or all.

The five filters of ``failures`` look at whole texts: A too few words, B too few unlike words, C too many capitals, D a forbidden
symbol, E the text of a smaller id. For E only the digests and ids of texts are exchanged; copies meet as one row a digest and
task, and the join that tells the first of them from the rest has the id in its key, so a group of copies spreads over tasks.

Null texts are empty texts; a null part is the part ''. A row with a null id passes E (it is neither smaller nor larger) and has no
label. Rows that repeat an id and a text count each, none as the copy of another. Of several labels of an id the largest
counts. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.quality_rules import has_any, words_of
from flowloom.session import durable

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_UNLIKE = 50  # % of words
MAX_CAPITALS = 3  # % of code points
FORBIDDEN = "#$%&*|"
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
_PARTS = 64


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id``, ``part`` and ``failed`` (array of booleans, in the order of ``FILTERS``) for every row."""
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[part], F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"))
    n, size = F.size("words"), F.length("text")
    capitals = size - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    own = durable(rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (n < MIN_WORDS).alias("a"),
        (100 * F.size(F.array_distinct("words")) < MIN_UNLIKE * n).alias("b"), (100 * capitals > MAX_CAPITALS * size).alias("c"),
        has_any(F.col("text"), [*FORBIDDEN]).alias("d")))
    first = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    told = own.filter("doc_id IS NOT NULL").join(first, ["digest", "doc_id"], "left").withColumn("e", F.col("first").isNull())
    rest = own.filter("doc_id IS NULL").withColumn("e", F.lit(False))
    columns = ["doc_id", "part", F.array(*[F.col(f.lower()) for f in FILTERS]).alias("failed")]
    return told.select(*columns).unionByName(rest.select(*columns))


def contingency(failed: DataFrame, labels: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """``part`` and ``cells``: for each cell met its number (the first filter is the highest bit), documents, good and toxic ones."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    cell = sum(F.col("failed")[i].cast("int") * (1 << (filters - 1 - i)) for i in range(filters))
    rows = failed.select("doc_id", "part", cell.alias("cell"))
    told = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").drop("doc_id")
    rest = rows.filter("doc_id IS NULL").select("part", "cell", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    cells = told.unionByName(rest).groupBy("part", "cell").agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")])
    return cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))


class Orders:
    """All orders of the filters and, for each step of each, what it selects along every axis."""

    def __init__(self, filters: str):
        self.orders = list(permutations(range(len(filters))))
        self.names = ["".join(filters[f] for f in o) for o in self.orders]
        self.at = np.array(self.orders).ravel()
        k = len(filters)
        steps = [(f, set(o[:i])) for o in self.orders for i, f in enumerate(o)]

        def pick(choose) -> np.ndarray:
            return np.array([[choose(axis, f, before) for axis in range(k)] for f, before in steps], dtype=np.int64)

        self.kept = pick(lambda x, f, before: _PASS if x == f or x in before else _ALL)
        self.removed = pick(lambda x, f, before: _FAIL if x == f else _PASS if x in before else _ALL)
        self.failing = pick(lambda x, f, before: _FAIL if x == f else _ALL)
        self.alone = pick(lambda x, f, before: _FAIL if x == f else _PASS)

    def count(self, tensors: np.ndarray, selected: np.ndarray) -> np.ndarray:
        """The sums of each tensor (first axis) over what each step selects."""
        axes = ascii_lowercase[:selected.shape[1]]
        return np.einsum(f"z{axes},{','.join('y' + x for x in axes)}->zy", tensors, *selected.transpose(1, 0, 2), optimize=True)


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from ``contingency``; documents of the part in each column:

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed earlier), ``unique_fails`` (fail its filter
    only), ``good_lost`` and ``toxic_lost`` (labelled ones of those removed), ``shapley`` (removed by its filter, over all orders).
    """
    k = len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(filters)
        steps = len(orders.at)
        for batch in batches:
            for low in range(0, batch.num_rows, _PARTS):
                names, lists = batch.column("part").slice(low, _PARTS), batch.column("cells").slice(low, _PARTS)
                flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                cell = flat.field("cell").to_numpy()
                n, good, toxic = (np.zeros((len(lists), 1 << k), dtype=np.int64) for _ in range(3))
                for tensor, c in ((n, "n"), (good, "good"), (toxic, "toxic")):
                    tensor[owner, cell] = flat.field(c).to_numpy()
                n, good, toxic = (t.reshape(-1, *[2] * k) for t in (n, good, toxic))
                removed = orders.count(n, orders.removed)
                share = np.stack([removed[:, orders.at == f].sum(axis=1) for f in range(k)], axis=1)
                out = {"kept": orders.count(n, orders.kept), "removed": removed, "redundant": orders.count(n, orders.failing) - removed,
                       "unique_fails": orders.count(n, orders.alone), "good_lost": orders.count(good, orders.removed),
                       "toxic_lost": orders.count(toxic, orders.removed), "shapley": share[:, orders.at]}
                part = names.take(pa.array(np.repeat(np.arange(len(lists)), steps)))
                order = pa.array(np.tile(np.repeat(np.array(orders.names, dtype=object), k), len(lists)), pa.string())
                step = pa.array(np.tile(np.arange(steps) % k + 1, len(lists)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part, order, step, *[pa.array(v.ravel()) for v in out.values()]],
                                                 ["part", "filter_order", "step", *out])

    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return cells.mapInArrow(run, f"part string, filter_order string, step int, {counts}")
