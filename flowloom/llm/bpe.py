"""Byte-level BPE encoding and decoding with a public vocabulary.

A pre-token's bytes are the leaves of a segment tree that holds, at each position, the rank of the
pair starting there. The root is the leftmost pair of lowest rank; a merge is three point updates
(the pair, its left neighbour, the byte that vanished), each logarithmic in the length, until the
root holds no pair. Short pre-tokens run in step, one NumPy operation updating the same tree level
of many trees; long ones use the same tree in plain lists.

Pre-tokens repeat, so each task remembers a bounded number of them. Texts are handled whole,
documents stay where they are read (no shuffle), and the vocabulary is broadcast: its size is that
of the vocabulary file, whatever the data.

Null texts count as empty; an empty text has no tokens and decodes to the empty text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.textbytes import Block, blocks, small_batches

#: The pattern by which byte-level BPE of this kind cuts text before merging. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 80_000
_NONE = np.int32(1 << 30)
_SHORT = 64
_SLOTS = 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins for the 256 bytes in vocabulary files: themselves if printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, token bytes and special tokens; plain arrays, so that it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        alphabet, ids = _byte_alphabet(), model["model"]["vocab"]
        size = max([*ids.values(), *(t["id"] for t in model["added_tokens"])]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.zeros(256, dtype=np.int32)
        for c, b in alphabet.items():
            self.of_byte[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self._index(np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64))
        self.lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)

    def _index(self, keys: np.ndarray) -> None:
        self.slot_key = np.full(_SLOTS, -1, dtype=np.int64)
        self.slot_rank = np.zeros(_SLOTS, dtype=np.int32)
        self.rank_of = {}
        slots = self._slot(keys)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            if key in self.rank_of:
                continue
            self.rank_of[key] = rank
            while self.slot_key[slot] != -1:
                slot = (slot + 1) % _SLOTS
            self.slot_key[slot], self.slot_rank[slot] = key, rank

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` for pairs that don't merge or have a side below 0."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(len(key), _NONE, dtype=np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(key[open_])
        while len(open_):
            found = self.slot_key[slot]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_rank[slot[hit]]
            on = ~hit & (found != -1)
            open_, slot = open_[on], (slot[on] + 1) % _SLOTS
        return out

    def merge_short(self, words: list[bytes], width: int) -> list[bytes]:
        """Merges words of at most ``width`` bytes (a power of two), all trees in step."""
        n = len(words)
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        place = np.arange(width, dtype=np.int32)
        token = np.where(place < size[:, None], self.of_byte[raw], -1).astype(np.int32)
        after = np.where(place + 1 < size[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int32)
        rank = self.ranks(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width:2 * width - 1] = np.where(rank < _NONE, rank % _NONE * width + place[:-1], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        row = np.arange(n)
        while True:
            row = row[tree[row, 1] < _NONE]
            if not len(row):
                break
            root = tree[row, 1]
            at, new = root % width, self.merged[root // width]
            gone = after[row, at]
            follow, prior = after[row, gone], before[row, at]
            token[row, at] = new
            token[row, gone] = -1
            after[row, at] = follow
            has = follow >= 0
            before[row[has], follow[has]] = at[has]
            right = np.where(has, token[row, follow], -1)
            left = np.where(prior >= 0, token[row, prior], -1)
            both = self.ranks(np.concatenate([new, left]), np.concatenate([right, new]))
            mine, theirs = both[:len(row)], both[len(row):]
            tree[row, width + at] = np.where(mine < _NONE, mine % _NONE * width + at, _NONE)
            tree[row, width + gone] = _NONE
            some = prior >= 0
            tree[row[some], width + prior[some]] = np.where(theirs < _NONE, theirs % _NONE * width + prior, _NONE)[some]
            rows = np.concatenate([row, row, row[some]])
            node = np.concatenate([at, gone, prior[some]]) + width
            while True:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                if node[0] == 1:
                    break
        flat, count = token[token >= 0].tobytes(), (token >= 0).sum(axis=1) * 4
        end = np.cumsum(count).tolist()
        return [flat[a:b] for a, b in zip([0, *end], end, strict=False)]

    def merge_long(self, word: bytes) -> bytes:
        """The same merges over one word of any length, the tree in a list."""
        token = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(token)
        width = 1 << (n - 1).bit_length()
        none, get, merged = (1 << 60), self.rank_of.get, self.merged
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int | None) -> None:
            node = width + i
            tree[node] = none if rank is None else rank * width + i
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            at, rank = tree[1] % width, tree[1] // width
            gone = after[at]
            token[at], after[at] = int(merged[rank]), after[gone]
            token[gone] = -1
            put(gone, None)
            if after[at] >= 0:
                before[after[at]] = at
                put(at, get(token[at] << 32 | token[after[at]]))
            else:
                put(at, None)
            if before[at] >= 0:
                put(before[at], get(token[before[at]] << 32 | token[at]))
        return np.array([t for t in token if t >= 0], dtype=np.int32).tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word as the bytes of 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        widths = np.array([1 << max(1, (len(w) - 1).bit_length()) for w in words])
        for width in np.unique(widths).tolist():
            where = np.flatnonzero(widths == width).tolist()
            if width > _SHORT:
                for i in where:
                    out[i] = self.merge_long(words[i])
                continue
            step = max(1, (1 << 18) // width)
            for a in range(0, len(where), step):
                some = where[a:a + step]
                for i, ids in zip(some, self.merge_short([words[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        length = self.lengths[ids]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        at = np.repeat(self.offsets[ids] - (end - length), length)
        return self.blob[at + np.arange(total)].tobytes()


class Encoder:
    """Encodes texts with a bounded memory of pieces seen before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PATTERN)
        #: where two white-space characters touch, pieces between single ones don't stand alone
        self.tangled = re.compile(r"\s\s")
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """Strings whose encodings in a row are that of ``text``.

        A pre-token may begin with one space and holds no other white space unless it is nothing else.
        So where no two white-space characters touch, each line feed is a pre-token, and the lines, cut
        before each space, fall into whole pre-tokens.
        """
        if self.tangled.search(text):
            return self.pattern.findall(text)
        pieces: list[str] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                pieces.append("\n")
            head, *rest = line.split(" ")
            if head:
                pieces.append(head)
            pieces += [" " + r for r in rest]
        return pieces

    def _words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; letters with at most one mark behind need no pattern."""
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():
            return [piece]
        if body[-1:] in {".", ",", "!"} and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def _parts(self, text: str) -> list[str | int]:
        if self.special is None or not self.special.search(text):
            return self._pieces(text)
        out: list[str | int] = []
        for part in self.special.split(text):
            known = self.vocabulary.special.get(part)
            out += self._pieces(part) if known is None else [known]
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Puts the encodings of ``pieces`` into the young memory."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        unseen = pieces.difference(self.young)
        back = unseen.intersection(self.old)
        self.young.update((p, self.old[p]) for p in back)
        new = list(unseen - back)
        if not new:
            return
        words = [self._words(p) for p in new]
        unlike = list({w for some in words for w in some})
        ids = dict(zip(unlike, self.vocabulary.merge([w.encode() for w in unlike]), strict=True))
        for p, some in zip(new, words, strict=True):
            self.young[p] = ids[some[0]] if len(some) == 1 else b"".join([ids[w] for w in some])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as the bytes of 32-bit integers."""
        parts = [self._parts(t) for t in texts]
        seen: set = set()
        for p in parts:
            seen.update(p)
        special = {i: np.int32(i).tobytes() for i in self.vocabulary.special.values() if i in seen}
        seen.difference_update(special)
        self._learn(seen)
        get = (self.young | special).__getitem__ if special else self.young.__getitem__
        return [b"".join(map(get, p)) for p in parts]


_encoders: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """One encoder for each Python worker, reused by its later tasks."""
    if shared.value_key not in _encoders:
        _encoders.clear()
        _encoders[shared.value_key] = Encoder(shared.broadcast.value)
    return _encoders[shared.value_key]


class Shared:
    """A broadcast vocabulary; its size is fixed by the vocabulary file."""

    def __init__(self, spark, path: str):
        self.broadcast = spark.sparkContext.broadcast(Vocabulary(path))
        self.value_key = path


def _beside(df: DataFrame, drop: tuple[str, ...], **columns: str) -> tuple[DataFrame, list[str]]:
    """``row`` (the columns of ``df`` but ``drop``) beside the columns an operator reads."""
    keep = [c for c in df.columns if c not in drop]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    return df.select(row.alias("row"), *[F.col(f"`{c}`").alias(name) for name, c in columns.items()]), keep


def _encoded(block: Block, encoder: Encoder) -> pa.ListArray:
    coded = encoder.encode([t.decode() for t in block.texts()])
    at = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)))


def _decoded(lists: pa.ListArray, vocabulary: Vocabulary) -> pa.Array:
    ids = (np.empty(0, dtype=np.int32) if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in lists)
    return pa.array([vocabulary.decode(i).decode("utf-8", errors="replace") for i in ids], type=pa.string())


def bpe_encode(df: DataFrame, vocabulary: Shared, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` but ``text``, and ``ids``: the token ids of the whole text (array of int).

    With ``decoded`` also a column of that name, decoded from the ids in the same pass. Columns of these names
    are replaced. Nulls in other columns pass unchanged.
    """
    held, keep = _beside(df, (text, ids, decoded or ids), text=text)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            for block in blocks(batch.column("text")):
                lists = _encoded(block, encoder)
                columns = {"row": batch.column("row").slice(block.first, len(block)), "ids": lists}
                if decoded:
                    columns["text"] = _decoded(lists, encoder.vocabulary)
                yield pa.RecordBatch.from_pydict(columns)
        encoder.young, encoder.old = {}, {}  # an idle worker holds no memory that other stages need

    fields = [T.StructField("row", held.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    out = held.mapInArrow(run, T.StructType(fields + [T.StructField("text", T.StringType())] * bool(decoded)))
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("ids").alias(ids),
                      *([F.col("text").alias(decoded)] if decoded else []))


def bpe_decode(df: DataFrame, vocabulary: Shared, ids: str = "ids", text: str = "text") -> DataFrame:
    """All rows of ``df`` with ``text``, decoded from ``ids``; bytes that are no UTF-8 become U+FFFD.

    A column of the name ``text`` is replaced. A null list decodes to the empty text.
    """
    held, keep = _beside(df, (text,), ids=ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _decoded(batch.column("ids"), vocabulary.broadcast.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "text"])

    fields = [T.StructField("row", held.schema["row"].dataType), T.StructField("text", T.StringType())]
    return held.mapInArrow(run, T.StructType(fields)).select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("text").alias(text))
