"""Repeated passages by prefix-partitioned suffix trees.

A word goes if a window of ``window`` words over it also starts in a document with a smaller id.

Which suffixes. Every window contains its smallest ``PREFIX``-word hash (minimiser) at the same place in
each document it stands in. So only suffixes that start at minimisers are kept, and of these only such
whose prefix occurs in two documents at least: no shared window is lost, and most text is never moved.

Groups. Suffixes are partitioned by their first ``PREFIX`` words. A group holds at most ``CROWD`` unlike suffixes of
all documents, however many a document has of them, each with the ``WINDOW - PREFIX`` words before and the ``window`` words from its start.
Where more suffixes share a prefix, it is lengthened: windows that begin at most half of the ``WINDOW - PREFIX`` words before
the suffix share that many words more with it on its right, the other windows on its left, so each suffix goes into two
groups that agree in a run of about ``(WINDOW + PREFIX) / 2`` words and look at their half of the windows only.
Where more than ``CROWD`` suffixes share such a run too, it is lengthened to the whole window: such suffixes are grouped by
full windows. Up to ``STRETCH`` consecutive windows travel as one row, cut where their distance from their minimiser says, which
is the same in all copies. Equal stretches are counted together first and only unlike ones are taken apart into windows. Spark
aggregates both before it exchanges them. So no group outgrows memory. A window's own words decide which way it goes, so all its
copies go the same way.

Trees. In a group, sorted suffixes with the lengths of their common prefixes are the suffix tree, its
internal nodes being runs of suffixes that agree for so many words; the words before the starts give a
second tree. For each ``before`` words left of the start, suffixes under the same node ``window - before``
deep and the same left node ``before`` deep share a window; the smallest document id under both
decides. Whole Arrow batches of groups are handled together, the prefix being the top of the tree.

Words are compared by 64-bit hashes of their bytes, windows under lengthened prefixes by 128 bits.

Ids are whole numbers or text of such. Null and empty texts have no words. Documents with a null id have no smaller and no larger id: they
keep all words and take none from others, and stay out of all exchanges. Rows that repeat an id don't act on each other, whether their
texts are equal or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.textbytes import PLAIN, Words, blocks, gram_hashes, mix, small_batches
from flowloom.session import durable

WINDOW = 50
PREFIX = 16
CROWD = 4000
STRETCH = 8


def _slide(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[:have - size], values[size - have:]) if have < size else values


def _halves(window: int, prefix: int) -> list[tuple[int, int]]:
    """Both halves of the distances at which a window may begin before its minimiser."""
    middle = (window - prefix + 1) // 2
    return [(0, middle - 1), (middle, window - prefix)] if middle else [(0, window - prefix)]


class Anchors:
    """Minimisers of the windows of a block: word indices ``at``, prefix hashes ``key``, text numbers ``text``."""

    def __init__(self, words: Words, window: int, prefix: int):
        n, span = len(words.starts), window - prefix + 1
        self.words, self.hashes, self.window, self.prefix = words, words.hashes(), window, prefix
        self.at = np.empty(0, dtype=np.int64)
        if n >= window:
            end = np.repeat(words.first[1:], words.counts())  # of the text of each word
            index = np.arange(n)
            grams = np.where((index + prefix <= end)[:n - prefix + 1], gram_hashes(self.hashes, prefix), ~np.uint64(0))
            lowest = np.where((index + window <= end)[:n - window + 1], _slide(grams, span, np.minimum), np.uint64(0))
            pad = np.zeros(span - 1, dtype=np.uint64)
            self.lowest = lowest
            self.at = np.flatnonzero(_slide(np.concatenate([pad, lowest, pad]), span, np.maximum) == grams)
            self.at = self.at[self.at + prefix <= end[self.at]]
            self.key = grams[self.at]
            self.grams = grams
        else:
            self.key = np.empty(0, dtype=np.uint64)
        self.text = np.searchsorted(words.first, self.at, side="right") - 1

    def run(self, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the texts of the minimisers have ``size`` words from ``start`` on, and hashes of these words."""
        fits = (start >= self.words.first[self.text]) & (start + size <= self.words.first[self.text + 1])
        out = np.zeros(len(start), dtype=np.uint64)
        if fits.any():
            out[fits] = gram_hashes(self.hashes, size)[start[fits]] if size else 0
        return fits, out

    def longer(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """What all windows that begin ``low`` to ``high`` words before a minimiser share: whether the text has these words, and
        32 bits of their hash (with the prefix's own hash they tell a group)."""
        fits, out = self.run(self.at - low, self.window - high + low)
        return fits, out >> np.uint64(32)

    def longer_key(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The same as one value; ``_longer_key`` is it in Spark."""
        fits, bits = self.longer(low, high)
        return fits, self.key ^ (bits << np.uint64(32)) ^ np.uint64(low + 1)

    def contexts(self) -> np.ndarray:
        """Equal values for minimisers between equal words as far as any window reaches; at a text's edges each has its own."""
        reach = self.window - self.prefix
        inside, left = self.run(self.at - reach, reach)
        fits, right = self.run(self.at, self.window)
        return np.where(inside & fits, mix(left) ^ right, mix(self.at.astype(np.uint64)))


def _longer_key(half: int, low: int) -> Column:
    bits = F.shiftleft(F.col(f"long{half}").cast("bigint"), 32)
    return F.col("key").bitwiseXOR(bits).bitwiseXOR(F.lit(low + 1).cast("bigint"))


def _prefixes(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """Distinct ``key``, ``long0``, ``long1`` of each document: its minimiser prefixes and the longer runs around them
    (null where the text has none), each with the number ``n`` of suffixes that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_numpy(), batch.column("row_id").to_numpy()
            for block in blocks(batch.column("text")):
                found = Anchors(block.words(PLAIN), window, prefix)
                longer = [found.longer(*half) for half in _halves(window, prefix)]
                longer += [(np.zeros(len(found.at), dtype=bool), np.zeros(len(found.at), dtype=np.uint64))] * (2 - len(longer))
                runs = [bits | fits.astype(np.uint64) << np.uint64(32) for fits, bits in longer]
                sorts = [found.text, found.key, *runs, found.contexts()]
                order = np.lexsort(sorts[::-1])
                moved = np.ones((len(sorts), len(order)), dtype=bool)
                for i, values in enumerate(sorts):
                    moved[i, 1:] = values[order[1:]] != values[order[:-1]]
                place = np.flatnonzero(moved[:-1].any(axis=0))
                unlike = np.concatenate([[0], np.cumsum(moved.any(axis=0))])
                first = order[place]
                of = found.text[first] + block.first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.key[first].view(np.int64)),
                     *[pa.array(bits[first].astype(np.uint32).view(np.int32), mask=~fits[first]) for fits, bits in longer],
                     pa.array(ids[of]), pa.array(rows[of]), pa.array(np.diff(unlike[np.append(place, len(order))]).astype(np.int32))],
                    ["key", "long0", "long1", "doc_id", "row_id", "n"])

    return docs.select("doc_id", "row_id", "text").mapInArrow(
        run, "key long, long0 int, long1 int, doc_id long, row_id long, n int")


def _mark(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One value for a text of a block and a prefix; a rare clash only adds a suffix to look at."""
    return key ^ mix(text.astype(np.uint64) + np.uint64(1))


def _repeated(batches: Iterator[pa.RecordBatch], column: str, window: int, prefix: int):
    """Blocks with their document and row ids, minimisers, and a function that marks those whose key is in the document's list
    ``column``."""
    for batch in batches:
        batch = batch.filter(batch.column(column).is_valid())
        ids, rows = batch.column("doc_id").to_numpy(), batch.column("row_id").to_numpy()
        for block in blocks(batch.column("text")):
            lists = batch.column(column).slice(block.first, len(block))
            wanted = _mark(np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy()),
                           lists.flatten().to_numpy().view(np.uint64))
            found = Anchors(block.words(PLAIN), window, prefix)
            own = slice(block.first, block.first + len(block))
            yield block, ids[own], rows[own], found, lambda key, at=found, wanted=wanted: np.isin(_mark(at.text, key), wanted)


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Marked suffixes with the words around their start that windows of their group may hold; equal ones of a document
    together. ``low`` and ``high`` say which windows the group looks at."""
    for block, ids, rows, found, is_marked in _repeated(batches, "few", window, prefix):
        data, words = block.buf.tobytes(), found.words
        places: dict[tuple, list[int]] = {}
        whole = (0, window - prefix), np.ones(len(found.at), dtype=bool), found.key
        for (low, high), fits, key in [whole, *[(half, *found.longer_key(*half)) for half in _halves(window, prefix)]]:
            marked = fits & is_marked(key)
            at, text = found.at[marked], found.text[marked]
            first, last = words.first[text], words.first[text + 1]
            a, b = np.maximum(first, at - high), np.minimum(last, at + window - low)
            for item in zip(text.tolist(), key[marked].view(np.int64).tolist(), (at - a).tolist(),
                            words.starts[a].tolist(), words.ends[b - 1].tolist(), (at - first).tolist(), strict=True):
                places.setdefault((*item[:3], low, high, data[item[3]:item[4]]), []).append(item[5])
        keys = list(places)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[1] for k in keys], type=pa.int64()), *[pa.array(v[[k[0] for k in keys]] if keys else [], type=pa.int64()) for v in (ids, rows)],
             *[pa.array([k[i] for k in keys], type=pa.int32()) for i in (2, 3, 4)], pa.array([k[5] for k in keys], type=pa.binary()),
             pa.array(list(places.values()), type=pa.list_(pa.int32()))],
            ["key", "doc_id", "row_id", "before", "low", "high", "words", "places"])


def _stretches(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Windows whose minimiser is marked for the half in which they begin, by 128-bit hashes: stretches of consecutive
    ones, once for each document with all the places where they begin. Of equal stretches of a block the first has the windows."""
    most = min(STRETCH, window)
    halves = _halves(window, prefix)
    for _, ids, own, found, is_marked in _repeated(batches, "many", window, prefix):
        words, n = found.words, len(found.hashes)
        hits = np.zeros((len(halves), n + window), dtype=bool)
        for hit, half in zip(hits, halves, strict=True):
            fits, key = found.longer_key(*half)
            hit[found.at[fits & is_marked(key)]] = True
        start = np.empty(0, dtype=np.int64)
        if hits.any():
            span = window - prefix + 1
            start = np.flatnonzero(_slide(hits.any(axis=0)[:n + span - 1 - prefix + 1], span, np.logical_or)[:n - window + 1])
            start = start[found.lowest[start] > 0]
            lowest = found.lowest[start]  # is its minimiser a marked one?
            ok = np.zeros(len(start), dtype=bool)
            for hit, (low, high) in zip(hits, halves, strict=True):
                for step in range(low, high + 1):
                    here = start + step
                    ok |= hit[here] & (found.grams[here] == lowest)
            start = start[ok]
        back = np.zeros(len(start), dtype=np.int64)  # words from a window's start to its first minimiser
        for step in range(window - prefix if len(start) else 0, -1, -1):
            back[found.grams[start + step] == found.lowest[start]] = step
        text = np.searchsorted(words.first, start, side="right") - 1
        h1, h2 = (gram_hashes(h, window)[start] if len(start) else start.astype(np.uint64)
                  for h in (found.hashes, mix(found.hashes ^ np.uint64(0x5851F42D4C957F2D))))
        new = np.ones(len(start), dtype=bool)
        new[1:] = (np.diff(start) != 1) | (np.diff(text) != 0) | (np.diff(back // most) != 0)
        index = np.arange(len(start))
        new |= (index - np.maximum.accumulate(np.where(new, index, 0))) % most == 0
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(start)))
        # the first and the last window hold all words of a stretch
        r1, r2 = (mix(h[first] ^ mix(h[first + size - 1] + size.astype(np.uint64))) for h in (h1, h2))
        order = np.lexsort((first, text[first], r2, r1))
        unlike = np.ones(len(order), dtype=bool)
        unlike[1:] = np.logical_or.reduce([v[order[1:]] != v[order[:-1]] for v in (r1, r2)])
        row = unlike.copy()
        row[1:] |= np.diff(text[first][order]) != 0
        one, known = order[row], ~unlike[row]
        starts = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(row), len(order)).astype(np.int32)),
                                          pa.array((start - words.first[text])[first][order].astype(np.int32)))
        told = np.where(known, 0, size[one])
        ends = np.cumsum(told)
        at = np.repeat(first[one] - ends + told, told) + np.arange(told.sum())
        windows = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], ends]).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)) for h in (h1, h2)], ["h1", "h2"]), mask=pa.array(known))
        of = text[first][one]
        yield pa.RecordBatch.from_arrays(
            [pa.array(r1[one].view(np.int64)), pa.array(r2[one].view(np.int64)), pa.array(ids[of]), pa.array(own[of]), starts, windows],
            ["r1", "r2", "doc_id", "row_id", "starts", "windows"])


def _tree(sequence: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the rows of ``sequence`` under ``key``, and the length each shares with the one before (-1: another key)."""
    rows = np.ascontiguousarray(np.concatenate([key[:, None], sequence], axis=1).astype(">u8"))
    order = np.argsort(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), kind="stable")
    same = rows[order[1:]] == rows[order[:-1]]
    shared = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)) - 1
    return order, np.concatenate([[-1], shared])


def _nodes(tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """The node at ``depth`` above each row."""
    order, shared = tree
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def _covered(table: pa.Table, window: int, prefix: int) -> pa.RecordBatch:
    """Word ranges of documents that windows shared with a smaller id cover, for whole groups of suffixes."""
    reach = window - prefix
    doc, owner = table.column("doc_id").to_numpy(), table.column("row_id").to_numpy()
    before, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("before", "low", "high"))
    words = next(blocks(table.column("words"), 1 << 40)).words(PLAIN)
    hashes, n = np.append(words.hashes(), np.uint64(0)), len(doc)
    after, start = words.counts() - before, words.first[:-1] + before
    place = np.arange(window)
    right = hashes[np.where(place < after[:, None], start[:, None] + place, -1)]
    place = np.arange(reach)
    left = hashes[np.where(place < before[:, None], start[:, None] - 1 - place, -1)]
    key = table.column("key").to_numpy().view(np.uint64)
    right_tree, left_tree = _tree(right, key), _tree(left, key)
    shared = np.zeros((n, reach + 3), dtype=bool)
    for back in range(reach + 1):
        rows = np.flatnonzero((before >= back) & (after >= window - back) & (low <= back) & (back <= high))
        if not len(rows):
            continue
        node = _nodes(right_tree, window - back)[rows] * (n + 1) + _nodes(left_tree, back)[rows]
        _, group = np.unique(node, return_inverse=True)
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc[rows])
        shared[rows, back + 1] = least[group] < doc[rows]
    edge = np.diff(shared.astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)  # back = first .. end - 1
    places = table.column("places").combine_chunks()
    count = places.value_lengths().to_numpy().astype(np.int64)
    flat, base = places.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(count)])[:-1]
    times = count[row]
    run = np.repeat(np.arange(len(row)), times)
    at = flat[base[row][run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)]
    return pa.RecordBatch.from_arrays(
        [pa.array(owner[row][run]), pa.array((at - end[run] + 1).astype(np.int32)), pa.array((at - first[run] + window).astype(np.int32))],
        ["row_id", "start", "stop"])


def _trees(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Suffixes in key order; the last key's group waits for the next batch."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        whole = pa.compute.not_equal(table.column("key"), batch.column("key")[len(batch) - 1])
        held, table = table.filter(pa.compute.invert(whole)), table.filter(whole)
        if len(table):
            yield _covered(table, window, prefix)
    if held is not None:
        yield _covered(held, window, prefix)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row_id`` names a document by id and text; null for a null id."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("row_id"), "text")


def _wanted(keys: DataFrame, crowd: int) -> DataFrame:
    """``key``, ``crowded`` of the keys that stand in two documents at least."""
    return (keys.groupBy("key").agg(F.sum("n").alias("n"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
            .filter("d0 < d1").select("key", (F.col("n") > crowd).alias("crowded")))


def _listed(docs: DataFrame, window: int, prefix: int, crowd: int) -> DataFrame:
    """Documents with the keys of their groups (``few``) and those that even the longer runs leave crowded (``many``)."""
    small_batches(docs.sparkSession)
    keys = durable(_prefixes(docs, window, prefix))
    rest = F.col("crowded")
    shared = durable(keys.join(_wanted(keys, crowd), "key").select(
        "doc_id", "row_id", "n", "crowded", F.when(~rest, F.col("key")).alias("key"),
        F.when(rest, F.array_compact(F.array(*[_longer_key(i, low) for i, (low, _) in enumerate(_halves(window, prefix))]))).alias("longer")))
    longer = shared.filter("crowded").select("doc_id", "row_id", "n", F.explode("longer").alias("key"))
    lists = (shared.filter("not crowded").select("row_id", "key", "crowded")
             .union(longer.join(_wanted(longer, crowd), "key").select("row_id", "key", "crowded"))
             .groupBy("row_id").agg(F.collect_set(F.when(~rest, F.col("key"))).alias("few"),
                                    F.collect_set(F.when(rest, F.col("key"))).alias("many")))
    return docs.join(lists, "row_id").select("doc_id", "row_id", "text", "few", "many")


def _suffix_rows(listed: DataFrame, window: int, prefix: int) -> DataFrame:
    """The suffixes that trees are made of; a tree holds the rows of one ``key``."""
    return listed.select("doc_id", "row_id", "text", "few").mapInArrow(
        lambda b: _suffixes(b, window, prefix),
        "key long, doc_id long, row_id long, before int, low int, high int, words binary, places array<int>")


def _stretch_rows(listed: DataFrame, window: int, prefix: int) -> DataFrame:
    return listed.select("doc_id", "row_id", "text", "many").mapInArrow(
        lambda b: _stretches(b, window, prefix),
        "r1 long, r2 long, doc_id long, row_id long, starts array<int>, windows array<struct<h1: long, h2: long>>")


def _windows(stretches: DataFrame) -> DataFrame:
    """The windows of unlike stretches with their places in them and the smallest and largest document id of their stretch."""
    unlike = (stretches.filter("r1 is not null and r2 is not null").groupBy("r1", "r2")
              .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("windows", ignorenulls=True).alias("windows")))
    return (unlike.select("r1", "r2", "least", "most", F.posexplode("windows").alias("place", "of"))
            .select("r1", "r2", "place", "of.h1", "of.h2", "least", "most"))


def _crowded_spans(stretches: DataFrame, window: int) -> DataFrame:
    """``row_id``, ``spans`` of stretches with windows that a document of smaller id has."""
    windows = _windows(stretches)
    least = windows.groupBy("h1", "h2").agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first < last")
    # "first <= least" always holds, as keys are never null: both sides then need the same rows and columns and read one exchange
    shared = (windows.join(least, ["h1", "h2"]).filter("first <= least and first < most").groupBy("r1", "r2")
              .agg(F.collect_list(F.struct("place", "first")).alias("shared")))
    found = stretches.select("r1", "r2", "doc_id", "row_id", "starts").join(shared, ["r1", "r2"])
    found = found.withColumn("places", F.transform(F.filter("shared", lambda w: w["first"] < F.col("doc_id")), lambda w: w["place"]))
    # no two windows of a stretch lie further apart than a window is long, so all between them is covered
    low, high = F.array_min("places"), F.array_max("places")
    spans = F.transform("starts", lambda at: F.struct((at + low).alias("start"), (at + high + window).alias("stop")))
    return found.filter(F.size("places") > 0).select("row_id", spans.alias("spans"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, crowd: int = CROWD,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id`` (a hash of id and text), ``spans``: word ranges (``start``, ``stop``) of each document that windows of
    documents with smaller ids repeat.

    Ranges may overlap. Documents without such a range, and null ids, have no row.
    """
    listed = _listed(_rows(docs, doc_id, text).filter("doc_id is not null"), window, prefix, crowd)
    groups = _suffix_rows(listed, window, prefix).repartition("key").sortWithinPartitions("key")
    few = groups.mapInArrow(lambda b: _trees(b, window, prefix), "row_id long, start int, stop int")
    many = _crowded_spans(_stretch_rows(listed, window, prefix), window)
    few = few.select("row_id", F.array(F.struct("start", "stop")).alias("spans"))
    return few.union(many).groupBy("row_id").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def without_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words outside the spans, joined by one space) for every row."""
    docs = _rows(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for word_spans, value in zip(batch.column("spans"), batch.column("text"), strict=True):
                words = (value.as_py() or "").encode().split()
                total.append(len(words))
                if word_spans.values is not None:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    start, stop = (word_spans.values.field(i).to_numpy() for i in (0, 1))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, stop, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    words = [words[i] for i in np.flatnonzero(~out).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()),
                 pa.array(kept, type=pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    found = docs.filter("doc_id is not null").join(spans, "row_id", "left").select("doc_id", "text", "spans")
    unnamed = docs.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    return found.union(unnamed).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
