"""Benchmark leaks, also re-parameterised ones, by canonical templates.

Canonical form. Lower-cased words; runs of numbers inside a sentence become one number slot, units after a number a unit
slot, runs of names one name slot. Capital letters don't tell names for certain, so each text has three readings,
judged apart: no word is a name (``PLAIN``), capitalised words inside a sentence are (``INSIDE``), all capitalised
words are (``CAPITALS``: also those that open a sentence or have further capitals). A window is ``WINDOW``
consecutive members of a reading; a benchmark item's windows are its template. Windows of more than half slots say
too little and are left out. Where ``CAPITALS`` has fewer windows than ``INSIDE``, coverage is of the latter's number.

Join. Window hashes of the benchmark are broadcast in blocks of at most ``BLOCK_WINDOWS`` (the texts are read
once a block), texts keep the windows found there, and these join the benchmark's windows by hash.

Check. Hits of a text and an item are chained in the order of both; between two hits of a chain their distance may
drift by ``DRIFT`` members (words put in or left out). A chain with at least ``COVERAGE`` of the item's windows is a
leak if its slots are consistent: each value of the item stands for one value of the text and the other way round;
where they aren't, the hits of each single distance are judged alone. ``verbatim`` tells that all slots have the
item's own values. An item's first and last slot may be the end or the start of a longer run in the text; if it has
another value there, the slot is left out of the check. A chain below ``COVERAGE`` is a leak if ``RUN`` members in a row have the item's own values.

Near copies of short items. A word put in, left out or changed breaks up to ``WINDOW`` windows, most of those of a short item. Items
of under ``LONG_ITEM`` members therefore have a second template in windows of ``SHORT_WINDOW`` members (readings ``PLAIN`` and
``INSIDE``), looked at where the first finds no leak. There a chain counts by the members that its windows cover: ``COVERAGE`` of
those in the template, and ``WINDOW`` members or all; what the first found inconsistent isn't taken up, unless verbatim.

Items of fewer than ``WINDOW`` members have one window of their size, if it has ``SHORTEST`` members at least. Items
without any telling window are looked for word by word (``EXACT``: numbers keep their values, operators between words
count), and as a whole or in runs of ``RUN`` words. They need ``EXACT_SHORTEST`` words and operators; shorter ones can't
be told from chance and match nothing. Null and empty texts and items match nothing;
rows with null ids can be leaks and carry the null. Repeated rows and items are each compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.textbytes import ALNUM, Block, Words, blocks, gram_hashes, mix, small_batches
from flowloom.session import durable

WINDOW = 8
SHORT_WINDOW = 5
LONG_ITEM = 32
SHORTEST = 4
EXACT_SHORTEST = 3
COVERAGE = 0.5
DRIFT = WINDOW
RUN = 13
PLAIN, INSIDE, CAPITALS, EXACT = 0, 1, 2, 3
SHORT = {4: PLAIN, 5: INSIDE}  # the same in short windows
BLOCK_WINDOWS = 1 << 20

#: Units that follow a number; a parameter.
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h", "hour", "hours", "minute", "minutes",
         "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro",
         "euros", "cent", "cents", "mph", "kmh", "meter", "meters", "metre", "metres", "mile", "miles", "pound", "pounds", "gb", "mb", "kb")
_NUMBER, _NAME, _UNIT = np.uint64(0xA11CE5), np.uint64(0xB0B5), np.uint64(0xC0DE)
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_STOP = np.array([chr(b) in ".!?:\n" for b in range(256)])
_OPERATOR = np.zeros(256, dtype=np.uint64)
_OPERATOR[list(b"+-*/=<>^%|&~")] = mix(np.arange(1, 13, dtype=np.uint64))
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x20000)])


def _initials(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether words of UTF-8 text begin with a capital letter."""
    at = [raw[np.minimum(starts + k, len(raw) - 1)].astype(np.int64) for k in range(4)]
    low = [b & 0x3F for b in at]
    code = np.where(at[0] < 0x80, at[0], np.where(at[0] < 0xE0, (at[0] & 0x1F) << 6 | low[1], np.where(
        at[0] < 0xF0, (at[0] & 0xF) << 12 | low[1] << 6 | low[2], (at[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3])))
    return _CAPITAL[np.minimum(code, len(_CAPITAL) - 1)]


def _unit_hashes() -> np.ndarray:
    return np.sort(np.concatenate([b.words(ALNUM).hashes() for b in blocks(pa.array([" ".join(UNITS)]))]))


class Template:
    """Canonical members of the texts of a block, from its words and their hashes: hashes, kinds (0 word, 1 number, 2 unit, 3 name), word ranges."""

    def __init__(self, block: Block, words: Words, h: np.ndarray, units: np.ndarray, reading: int):
        raw = block.buf
        self.words = words
        n, starts, ends = len(words.starts), words.starts, words.ends
        number = _DIGIT[raw[starts]] if n else np.zeros(0, dtype=bool)
        upper = _initials(raw, starts) if n and reading != PLAIN else np.zeros(n, dtype=bool)
        if reading == INSIDE:
            count = np.concatenate([[0], np.cumsum(_UPPER[raw])])
            upper &= ~((count[ends] - count[starts] > 1))  # words in capitals are no names here
        opens = np.zeros(n, dtype=bool)  # a sentence
        opens[words.first[:-1][words.first[:-1] < n]] = True
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        if n:
            opens[1:] |= stops[starts[1:]] > stops[ends[:-1]]
        ends_run = np.zeros(n, dtype=bool)  # a stop before other than a letter or digit: 3.5 and 12:30 are one number
        if n:
            full = _STOP[raw] & ~np.append(ALNUM[raw[1:]], False) | (raw == 0x0A)
            seen = np.concatenate([[0], np.cumsum(full)])
            ends_run[1:] = seen[starts[1:]] > seen[ends[:-1]]
        name = upper & ~number
        if reading == INSIDE:
            name &= ~opens
        text = np.repeat(np.arange(len(block)), words.counts())
        unit = np.zeros(n, dtype=bool)
        unit[1:] = number[:-1] & (text[1:] == text[:-1]) & np.isin(h[1:], units) & ~number[1:]
        kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
        keep = np.ones(n, dtype=bool)
        keep[1:] = ~((kind[1:] == kind[:-1]) & ((kind[1:] == 1) | (kind[1:] == 3)) & (text[1:] == text[:-1])
                     & ~np.where(kind[1:] == 1, ends_run[1:], opens[1:]))
        at = np.flatnonzero(keep)
        self.kind, self.text = kind[at], text[at]
        self.hash = np.where(self.kind == 1, _NUMBER, np.where(self.kind == 2, _UNIT, np.where(self.kind == 3, _NAME, h[at])))
        self.start, self.stop = at, np.append(at[1:], n)
        self.stop = np.where(np.append(self.text[1:] == self.text[:-1], False), self.stop, words.first[self.text + 1]) if len(at) else self.stop
        self.first = np.searchsorted(self.text, np.arange(len(block) + 1))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of each telling window of ``size`` members inside one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        slots = np.concatenate([[0], np.cumsum(self.kind > 0)])
        good = (self.text[size - 1:] == self.text[:n]) & ((slots[size:] - slots[:-size]) * 2 <= size)
        at = np.flatnonzero(good)
        return at, gram_hashes(self.hash, size)[at]

    def slots(self, at: int, size: int, data: bytes) -> list[str]:
        """Values of the slots of a window."""
        out = []
        for i in (at + np.flatnonzero(self.kind[at:at + size])).tolist():
            words = range(int(self.start[i]), int(self.stop[i]))
            out.append(b" ".join(data[self.words.starts[w]:self.words.ends[w]] for w in words).decode())
        return out


class Exact(Template):
    """The words of the texts of a block as they are, with the operators between them."""

    def __init__(self, block: Block, words: Words, h: np.ndarray):
        self.words = words
        n = len(words.starts)
        self.text, self.first = np.repeat(np.arange(len(block)), words.counts()), words.first
        self.start, self.stop, self.kind = np.arange(n), np.arange(1, n + 1), np.zeros(n, dtype=int)
        seen = np.zeros(len(block.buf) + 1, dtype=np.uint64)
        np.cumsum(_OPERATOR[block.buf], out=seen[1:])
        self.hash = np.zeros(max(0, 2 * n - 1), dtype=np.uint64)
        self.hash[::2], self.hash[1::2] = h, seen[words.starts[1:]] - seen[words.ends[:-1]]
        inside = self.text[1:] == self.text[:-1]
        self.length = words.counts() + np.bincount(self.text[1:][inside & (self.hash[1::2] > 0)], minlength=len(block))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.text) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.text[size - 1:] == self.text[:n])
        return at, gram_hashes(self.hash, 2 * size - 1)[::2][at]


_SALT = np.array([0, 0x5A17000000000001, 0x5A17000000000002, 0x5A17000000000003, 0x5A17000000000004, 0x5A17000000000005], dtype=np.uint64)
_WINDOWS = "`key` {kind}, reading int, size int, place int, total int, word int, past int, edge int, h long, slots array<string>"


def _own_window(members: int, reading: int) -> int:
    """The window size of an item in a reading, 0 for no windows."""
    if reading in SHORT:
        return SHORT_WINDOW if SHORT_WINDOW < members < LONG_ITEM else 0
    return min(WINDOW, members) if members >= (1 if reading == EXACT else SHORTEST) else 0


def _in_windows(form: Template, at: np.ndarray, size: int, texts: int) -> np.ndarray:
    """For each text, the number of members in windows that begin at the sorted places ``at``."""
    fresh = np.diff(at, prepend=-size).clip(max=size)
    return np.bincount(form.text[at], weights=fresh, minlength=texts).astype(int)


def _edges(form: Template, at: np.ndarray, size: int) -> np.ndarray:
    """1 where a window's first slot is the first member of its text, 2 where its last slot is the last member, 3 for both."""
    if not len(at):
        return at
    first, last = at == form.first[form.text[at]], at + size == form.first[form.text[at] + 1]
    return (first & (form.kind[at] > 0)) + 2 * (last & (form.kind[at + size - 1] > 0))


def _template_windows(rows: DataFrame, sizes: list[tuple[int, int]] | None, wanted=None) -> DataFrame:
    """Windows of the texts of ``rows`` (``key``, ``text``): of each of ``sizes`` (reading, size), or of an item's own size if that is short.

    With ``wanted`` (a broadcast of sorted hashes) only windows found there.
    """
    units = _unit_hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = None
        if wanted is not None:
            quick = np.zeros(1 << 20, dtype=bool)
            quick[wanted.value >> np.uint64(44)] = True
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows_out: list[tuple] = []
                totals = np.zeros((6, len(block)), dtype=int)
                forms: dict[int, Template] = {}
                words = block.words(ALNUM, lower=True)
                hashes = words.hashes()
                for reading in (PLAIN, INSIDE, CAPITALS, EXACT, *SHORT) if sizes is None else sorted({r for r, _ in sizes}):
                    like = SHORT.get(reading, reading)
                    if like not in forms:
                        forms[like] = Exact(block, words, hashes) if like == EXACT else Template(block, words, hashes, units, like)
                    form = forms[like]
                    data, members = form.words.buf.tobytes(), np.diff(form.first)
                    if sizes is None and reading == EXACT:
                        members = np.where((totals.sum(axis=0) == 0) & (form.length >= EXACT_SHORTEST), members, 0)
                    own_size = np.array([_own_window(m, reading) for m in members.tolist()], dtype=int) if sizes is None else None
                    for size in sorted(set(own_size.tolist()) - {0} if sizes is None else {k for r, k in sizes if r == reading}):
                        at, h = form.windows(size)
                        h = mix(h ^ _SALT[reading])
                        if quick is not None:
                            hit = np.flatnonzero(quick[h >> np.uint64(44)])
                            hit = hit[np.isin(h[hit], wanted.value)]
                            at, h = at[hit], h[hit]
                        if sizes is None:
                            own = own_size[form.text[at]] == size
                            at, h = at[own], h[own]
                        text = form.text[at]
                        totals[reading] += _in_windows(form, at, size, len(block)) if reading in SHORT else np.bincount(text, minlength=len(block))
                        rows_out += zip(text.tolist(), [reading] * len(at), [size] * len(at), (at - form.first[text]).tolist(),
                                        (form.start[at] - form.words.first[text]).tolist(), (form.stop[at + size - 1] - form.words.first[text]).tolist(),
                                        _edges(form, at, size).tolist(), h.view(np.int64).tolist(), [form.slots(a, size, data) for a in at.tolist()], strict=True)
                totals[CAPITALS] = np.maximum(totals[CAPITALS], totals[INSIDE])
                columns = list(zip(*rows_out, strict=True)) or [[]] * 9
                text = pa.array(columns[0], type=pa.int64())
                total = totals[np.array(columns[1], dtype=int), np.array(columns[0], dtype=int)]
                ints = dict(zip(("reading", "size", "place", "word", "past", "edge"), columns[1:7], strict=True)) | {"total": total}
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(block.first, len(block)).take(text),
                     *[pa.array(ints[c], type=pa.int32()) for c in ("reading", "size", "place", "total", "word", "past", "edge")],
                     pa.array(columns[7], type=pa.int64()), pa.array(columns[8], type=pa.list_(pa.string()))],
                    ["key", "reading", "size", "place", "total", "word", "past", "edge", "h", "slots"])

    return rows.mapInArrow(run, _WINDOWS.format(kind=rows.dtypes[0][1]))


def _trimmed(hit: dict) -> dict:
    """Longer runs at the item's edges cut to the item's value, or null if that isn't at their end (start)."""
    for bit, at in ((1, 0), (2, -1)):
        if hit["edge"] & bit:
            own, slot = hit["own"][at].split(" "), hit["slots"][at].split(" ")
            if len(slot) > len(own):
                hit["slots"][at] = hit["own"][at] if own == (slot[-len(own):] if bit == 1 else slot[:len(own)]) else None
    return hit


class Chain:
    """Hits of one occurrence, in the order of the text and of the item."""

    def __init__(self, hit: dict):
        self.hits = [hit]

    def follows(self, hit: dict) -> bool:
        last = self.hits[-1]
        return hit["d"] > last["d"] and hit["i"] > last["i"]

    def coverage(self) -> float:
        """Share of the item's windows; in short windows, of the members in them."""
        if self.hits[0]["reading"] in SHORT:
            return self.covered() / self.hits[0]["total"]
        return len({h["i"] for h in self.hits}) / self.hits[0]["total"]

    def covered(self) -> int:
        """Members of the item in hit windows."""
        n = past = 0
        for i, size in sorted({(h["i"], h["size"]) for h in self.hits}):
            n, past = n + max(0, i + size - max(i, past)), max(past, i + size)
        return n

    def pairs(self) -> set[tuple[str, str]]:
        """Values of the item and of the text in the same slots."""
        return {p for h in self.hits for p in zip(h["own"], h["slots"], strict=True) if p[1] is not None}

    def consistent(self) -> bool:
        pairs = self.pairs()
        return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})

    def verbatim(self) -> bool:
        return all(h["own"] == h["slots"] for h in self.hits)

    def alone(self) -> list[Chain]:
        """The hits of each distance."""
        out: dict[int, Chain] = {}
        for h in self.hits:
            if (c := out.get(h["d"] - h["i"])) is not None:
                c.hits.append(h)
            else:
                out[h["d"] - h["i"]] = Chain(h)
        return list(out.values())

    def runs(self) -> list[Chain]:
        """Hits over at least ``RUN`` members in a row with the item's own values."""
        out, long = [], []
        for part in self.alone():
            past = -1
            for h in part.hits:
                if h["own"] != h["slots"]:
                    continue
                if h["i"] <= past:
                    out[-1].hits.append(h)
                else:
                    out.append(Chain(h))
                past = h["i"] + h["size"]
        for c in out:
            if c.hits[-1]["i"] + c.hits[-1]["size"] - c.hits[0]["i"] >= RUN:
                long.append(c)
        return long


def _chains(hits: list[dict]) -> list[Chain]:
    """All hits in chains, each hit in one; a chain is open under its last distance."""
    done: list[Chain] = []
    open_: dict[int, Chain] = {}
    hits = sorted(hits, key=lambda h: (h["d"], h["i"]))
    a = 0
    while a < len(hits):
        b = a
        while b < len(hits) and hits[b]["d"] == hits[a]["d"]:
            b += 1
        late = []
        for h in hits[a:b]:  # those that keep their distance first
            c = open_.get(h["d"] - h["i"])
            if c is not None and c.follows(h):
                c.hits.append(h)
            else:
                late.append(h)
        for h in late:
            shift = h["d"] - h["i"]
            near = [s for k in range(1, DRIFT + 1) for s in (shift - k, shift + k) if s in open_ and open_[s].follows(h)]
            if shift in open_:
                done.append(open_.pop(shift))
            if near:
                c = open_.pop(near[0])
                c.hits.append(h)
            else:
                c = Chain(h)
            open_[shift] = c
        a = b
    return done + list(open_.values())


def _judged(hits: list[dict], coverage: float) -> tuple[list[Chain], list[Chain]]:
    """The leaks among the hits of a text and an item in one reading, and what only inconsistent slots keep from being one."""
    out, torn = [], []
    single = {c.hits[0]["d"] - c.hits[0]["i"]: c for c in Chain.alone(_all(hits))}
    used: set[int] = set()
    left: list[Chain] = []
    for c in _chains(hits):
        if c.coverage() >= coverage and c.consistent():
            out.append(c)
            used |= {h["d"] - h["i"] for h in c.hits}
        else:
            left.append(c)
    for shift, c in single.items():  # as above without drift
        if shift not in used and c.coverage() >= coverage:
            used.add(shift)
            (out if c.consistent() else torn).append(c)
    for c in left:
        if c.coverage() >= coverage:
            torn.append(c)
        elif not used & {h["d"] - h["i"] for h in c.hits}:
            out += c.runs()
    return out, torn


def _leaks(readings: dict[int, dict], coverage: float) -> list[Chain]:
    """The leaks in any reading; where names inside sentences are inconsistent, reading them as words doesn't mend it."""
    judged = {r: _judged(list(hits.values()), coverage) for r, hits in readings.items() if r != EXACT and r not in SHORT}
    if EXACT in readings:
        alone = _all(list(readings[EXACT].values())).alone()
        judged[EXACT] = ([x for c in alone for x in ([c] if c.coverage() == 1 else c.runs())], [])
    torn = judged[INSIDE][1] if INSIDE in judged else []
    every_torn = [t for _, some in judged.values() for t in some]
    found = _merged([c for r, (leaks, _) in judged.items() for c in leaks
                    if r != PLAIN or not any(t.coverage() > c.coverage() and _overlap(t, c) for t in torn)])
    return found or _merged([
        c for r in SHORT if r in readings for c in _chains(list(readings[r].values()))
        if c.covered() >= max(coverage * c.hits[0]["total"], min(c.hits[0]["total"], WINDOW)) and c.consistent()
        and (c.verbatim() or not any(_overlap(t, c) for t in every_torn))])


def _all(hits: list[dict]) -> Chain:
    c = Chain(hits[0])
    c.hits = sorted(hits, key=lambda h: (h["d"], h["i"]))
    return c


def _overlap(a: Chain, b: Chain) -> bool:
    return min(a.hits[-1]["past"], b.hits[-1]["past"]) > max(a.hits[0]["word"], b.hits[0]["word"])


def _merged(leaks: list[Chain]) -> list[Chain]:
    """The best of the leaks that overlap in the text."""
    out: list[Chain] = []
    for c in sorted(leaks, key=lambda c: (-c.coverage(), c.verbatim())):
        if not any(_overlap(c, o) for o in out):
            out.append(c)
    return out


def _keyed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``text`` and a key that tells apart texts which share an id."""
    return rows.select(F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(f"`{text}`").alias("of")).alias("key"), F.col(f"`{text}`").alias("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", item_id: str = "item_id",
               text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each leak: ``doc_id``, ``item_id``, ``coverage`` (best occurrence), ``occurrences``, ``verbatim``."""
    spark = docs.sparkSession
    small_batches(spark)
    items = durable(_template_windows(_keyed(benchmark, item_id, text), None))
    sizes = [tuple(r) for r in items.select("reading", "size").distinct().collect()]  # at most WINDOW for a reading
    hashes = items.select("h").distinct()
    parts = -(-hashes.count() // block_windows)
    texts = _keyed(docs, doc_id, text)
    hits = None
    for part in range(parts):
        some = hashes.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) == part).toArrow().column("h").to_numpy()
        wanted = spark.sparkContext.broadcast(np.sort(some.view(np.uint64)))
        found = _template_windows(texts, sizes, wanted)
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = texts.filter("false").selectExpr("key", "0 AS reading", "0 AS size", "0 AS place", "0 AS total", "0 AS word", "0 AS past", "0 AS edge", "0L AS h", "array('') AS slots")
    joined = hits.alias("d").join(items.alias("b"), ["h", "reading", "size"]).select(
        F.col("d.key.id").alias("doc_id"), F.col("d.key.of").alias("doc_of"), F.col("b.key.id").alias("item_id"), F.col("b.key.of").alias("item_of"),
        F.col("d.place").alias("d"), F.col("b.place").alias("i"), "reading", "size", "b.total", "b.edge", "d.word", "d.past", F.col("b.slots").alias("own"), F.col("d.slots").alias("slots"))
    kinds = dict(joined.dtypes)

    def judge(group: pa.Table) -> pa.Table:
        readings: dict[int, dict] = {}
        for h in group.drop_columns(["doc_id", "doc_of", "item_id", "item_of"]).to_pylist():
            readings.setdefault(h["reading"], {})[h["d"], h["i"]] = _trimmed(h)
        leaks = _leaks(readings, coverage)
        first = group.slice(0, 1 if leaks else 0).select(["doc_id", "item_id"])
        for name, kind, value in (("coverage", pa.float64(), max((c.coverage() for c in leaks), default=0.0)), ("occurrences", pa.int64(), len(leaks)),
                                  ("verbatim", pa.bool_(), any(c.verbatim() for c in leaks))):
            first = first.append_column(name, pa.array([value] * first.num_rows, type=kind))
        return first

    leaks = joined.groupBy("doc_id", "doc_of", "item_id", "item_of").applyInArrow(
        judge, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, coverage double, occurrences long, verbatim boolean")
    return leaks.groupBy("doc_id", "item_id").agg(
        F.max("coverage").alias("coverage"), F.sum("occurrences").alias("occurrences"), F.max("verbatim").alias("verbatim"))
