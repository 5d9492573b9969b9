"""Licence text by matching statistics on a generalised suffix automaton.

The automaton holds the words of all licence templates and base phrases. Texts stream through it: after
each word its state is the longest suffix of the text so far that stands in some template (the matching
statistic). Where a match can't be made longer it is noted, if it has ``MIN_MATCH`` words; matches of one
template whose places rise in text and template alike are chained over small gaps into a covered span.
A span that covers enough of a template gives its label; spans of several templates over the same words
leave only the one covered best.

Words outside the vocabulary of the templates reset the automaton, so whole blocks of text are cut with
NumPy to the runs of words inside it, and only these are walked. The automaton is broadcast; its size is that
of the templates given.

Null and empty texts have no words and no labels. Repeated rows are scanned alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.textbytes import ALNUM, blocks, small_batches

MIN_MATCH = 2
MAX_GAP = 6
COVERED = 0.75

#: Base phrases and their labels; fixed values.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Well-known public licence notices (label, text); a parameter of the operator.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
    ("reserved", "no part of this publication may be reproduced without prior written permission"),
]


class Automaton:
    """Generalised suffix automaton over word numbers, with the template places that end in each state."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in templates]
        texts = [text.lower().encode().split() for _, text in templates]
        base = [phrase.encode().split() for phrase in phrases]
        self.sizes = [len(t) for t in texts]
        self.least = min([MIN_MATCH, *map(len, base)])
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts + base for w in t))}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(texts + base):
            state = 0
            for place, w in enumerate(words):
                state = self._extend(state, self.number[w], ends)
                if t < len(texts):
                    ends[state].add((t, place + 1))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]
        self.base_labels = list(phrases.values())
        own = {}
        for p, words in enumerate(base):
            state = 0
            for w in words:
                state = self.step[state][self.number[w]]
            own.setdefault(state, []).append((p, len(words)))
        self.base: list[list[tuple[int, int]]] = [[] for _ in self.size]
        for state in range(1, len(self.size)):
            at = state
            while at > 0:
                self.base[state] += own.get(at, [])
                at = self.link[at]
        words = list(self.number)
        hashes = np.concatenate([b.words(ALNUM).hashes() for b in blocks(pa.array([" ".join(w.decode() for w in words)]))])
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[hashes >> np.uint64(48)] = True
        self.vocabulary = np.sort(hashes)

    def _state(self, size: int, step: dict[int, int], link: int, ends: list) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        ends.append(set())
        return len(self.size) - 1

    def _split(self, above: int, w: int, ends: list) -> int:
        """The state of exactly one word more than ``above`` on ``w``, cut out of a longer one if need be."""
        to = self.step[above][w]
        if self.size[to] == self.size[above] + 1:
            return to
        copy = self._state(self.size[above] + 1, dict(self.step[to]), self.link[to], ends)
        self.link[to] = copy
        while above >= 0 and self.step[above].get(w) == to:
            self.step[above][w] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, w: int, ends: list) -> int:
        if w in self.step[last]:  # an earlier template has it
            return self._split(last, w, ends)
        new = self._state(self.size[last] + 1, {}, 0, ends)
        while last >= 0 and w not in self.step[last]:
            self.step[last][w] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, w, ends)
        return new

    def walk(self, numbers: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Matches (start, stop, state) that can't be made longer, and base phrases (start, phrase), of a run of words."""
        state = length = 0
        matches, found = [], []
        for i, w in enumerate(numbers):
            if w not in self.step[state] and length >= MIN_MATCH:
                matches.append((i - length, i, state))
            while state and w not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.step[state]:
                state, length = self.step[state][w], length + 1
                found += [(i + 1 - k, p) for p, k in self.base[state] if k <= length]
            else:
                length = 0
        if length >= MIN_MATCH:
            matches.append((len(numbers) - length, len(numbers), state))
        return matches, found

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Covered spans (start, stop, label, share of the template) from the matches of a text in order."""
        open_: dict[int, list[list[int]]] = {}  # by template: start, stop, place in template, words covered
        done = []
        for start, stop, state in matches:
            for t, end in self.ends[state]:
                begin, chains = end - (stop - start), open_.setdefault(t, [])
                done += [(t, *c) for c in chains if start - c[1] > MAX_GAP]
                chains[:] = [c for c in chains if start - c[1] <= MAX_GAP]
                goes_on = [c for c in chains if start >= c[1] and 0 <= begin - c[2] <= MAX_GAP]
                if goes_on:
                    best = max(goes_on, key=lambda c: c[3])
                    best[1:] = [stop, end, best[3] + stop - start]
                else:
                    chains.append([start, stop, end, stop - start])
        done += [(t, *c) for t, chains in open_.items() for c in chains]
        full = sorted(((n / self.sizes[t], n, -a, b, t) for t, a, b, _, n in done if n / self.sizes[t] >= COVERED), reverse=True)
        kept: list[tuple[int, int, str, float]] = []
        for share, _, a, b, t in full:
            if all(b <= x or -a >= y for x, y, _, _ in kept):
                kept.append((-a, b, self.labels[t], share))
        return sorted(kept)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row ``doc_id``, ``n_words``, ``phrases`` (start and label of each place of a base phrase) and
    ``spans`` (start, stop, label and covered share of each licence passage, in words from 0)."""
    known = docs.sparkSession.sparkContext.broadcast(Automaton(templates or TEMPLATES, phrases or BASE_PHRASES))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    small_batches(docs.sparkSession)
    phrase_type = pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = known.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = block.words(ALNUM, lower=True)
                h = words.hashes()
                maybe = np.flatnonzero(auto.known[h >> np.uint64(48)])
                maybe = maybe[np.isin(h[maybe], auto.vocabulary)]
                text = np.searchsorted(words.first, maybe, side="right") - 1
                new = np.ones(len(maybe), dtype=bool)
                new[1:] = (maybe[1:] != maybe[:-1] + 1) | (text[1:] != text[:-1])
                start = np.flatnonzero(new)
                size = np.diff(np.append(start, len(maybe)))
                phrases_of: list[list] = [[] for _ in range(len(block))]
                matches_of: list[list] = [[] for _ in range(len(block))]
                data = words.buf.tobytes()
                for s, n in zip(start[size >= auto.least].tolist(), size[size >= auto.least].tolist(), strict=True):
                    a, t = int(maybe[s]), int(text[s])
                    numbers = [auto.number.get(data[x:y], -1) for x, y in zip(words.starts[a:a + n], words.ends[a:a + n], strict=True)]
                    base = a - int(words.first[t])
                    matches, found = auto.walk(numbers)
                    matches_of[t] += [(x + base, y + base, z) for x, y, z in matches]
                    phrases_of[t] += [{"start": x + base, "label": auto.base_labels[p]} for x, p in found]
                spans = [[dict(zip(("start", "stop", "label", "share"), s, strict=True)) for s in auto.spans(m)] for m in matches_of]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(block)), pa.array(words.counts().astype(np.int64)),
                     pa.array(phrases_of, type=phrase_type), pa.array(spans, type=span_type)], ["doc_id", "n_words", "phrases", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_words long, phrases array<struct<start:int,label:string>>, "
                                "spans array<struct<start:int,stop:int,label:string,share:double>>")


def license_report(scanned: DataFrame) -> DataFrame:
    """One row a document: numbers, first and last place of base phrases, labels, and the largest covered share as ``score``."""
    base = F.array_sort(F.array_distinct("phrases.label"))
    both = F.array_sort(F.array_distinct(F.concat("phrases.label", "spans.label")))
    share = F.greatest(F.coalesce(F.array_max("spans.share"), F.lit(0.0)), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").cast("long").alias("first_word"), F.array_max("phrases.start").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), share.alias("score"), "spans")
