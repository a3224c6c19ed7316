"""Encoding of a corpus with a public byte-level BPE tokenizer, in numpy.

Texts are split by the tokenizer's public pattern. The distinct pieces of a batch go, by length, into padded matrices of byte ids.
Every round, each row merges its leftmost pair of least rank: ranks come from a hash table of pairs by open addressing, only the
two pairs beside a merge are looked up anew, rows close up by one column, and rows without a pair left to merge are taken out.
Pieces longer than LONG merge all equal pairs of the least rank at once, from the left, which comes to the same, since a pair
with a merged id never has a lower rank than the merge itself.

Defined results: null and empty texts have an empty list; whole texts are encoded, of whatever length; strings of special
tokens are ordinary text. Vocabulary files are read on the driver from a path that is a parameter, and broadcast: their size is
that of the vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(np.iinfo(np.int32).max)
LONG = 256
#: Distinct pieces that a Python worker remembers, and characters that it encodes at once.
REMEMBERED, AT_ONCE = 200_000, 4_000_000


def byte_names() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable in Latin-1, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], free = chr(free), free + 1
    return names


class Vocabulary:
    """ids of bytes, and a hash table of pairs: (left id, right id) -> (rank, merged id)."""

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray, merged: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        keys = pairs[:, 0].astype(np.uint64) << np.uint64(32) | pairs[:, 1].astype(np.uint64)
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4)))))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(size, NONE)
        self.merged = np.append(merged.astype(np.int32), np.int32(-1))
        slots = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # each round, the first key that wants a free slot gets it and the others move on by one
            free = self.keys[slots[left]] == self.keys.dtype.type(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slots[left], return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self.keys[slots[left[won]]] = keys[left[won]]
            self.ranks[slots[left[won]]] = left[won]
            left = left[~won]
            slots[left] = (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they do not merge; a negative id is padding."""
        out = np.full(left.shape, NONE)
        real = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = left.ravel()[real].astype(np.uint64) << np.uint64(32) | right.ravel()[real].astype(np.uint64)
        slots = self._slot(keys)
        flat = out.ravel()
        while len(real):
            seen = self.keys[slots]
            hit = seen == keys
            flat[real[hit]] = self.ranks[slots[hit]]
            on = ~hit & (seen != np.uint64(0xFFFFFFFFFFFFFFFF))
            real, keys, slots = real[on], keys[on], (slots[on] + 1) & self.mask
        return flat.reshape(left.shape)


def load(path: str | Path) -> Vocabulary:
    """A vocabulary from a file of the tokenizers library (byte-level BPE, .json)."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, names = model["vocab"], byte_names()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
    return Vocabulary(np.array([vocab[names[b]] for b in range(256)]), pairs, np.array([vocab[a + b] for a, b in merges], np.int64))


class Encoder:
    """Encodes lists of texts; remembers pieces up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        import regex

        self.v, self.split = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]]."""
        if len(self.known) > REMEMBERED:
            self.known, self.ids = {}, []
        known, codes, ends, new = self.known, [], [0], []
        for text in texts:
            for piece in self.split(text) if text else ():
                if (c := known.get(piece)) is None:
                    c = known[piece] = len(known)
                    new.append(piece)
                codes.append(c)
            ends.append(len(codes))
        self.ids.extend(self.pieces(new))
        lengths = np.fromiter((len(x) for x in self.ids), np.int64, len(self.ids))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pool = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)
        at = np.array(codes, np.int64)
        sizes = lengths[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[at] - upto[:-1], sizes) + np.arange(upto[-1])
        return upto[np.array(ends)], pool[take]

    def pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter((len(b) for b in raw), np.int64, len(raw))
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(raw)
        wide = 1
        while wide <= LONG:
            at = np.flatnonzero((sizes <= wide) & (sizes > wide // 2))
            for some in np.array_split(at, max(1, len(at) * wide // 2_000_000)):
                if len(some):
                    flat = self.v.byte_ids[np.frombuffer(b"".join(raw[i] for i in some), np.uint8)]
                    matrix = np.full((len(some), wide), np.int32(-1))
                    matrix[np.arange(wide) < sizes[some][:, None]] = flat
                    self._merge(matrix, some, out)
            wide *= 2
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._merge_long(self.v.byte_ids[np.frombuffer(raw[i], np.uint8)])
        return out

    def _merge(self, m: np.ndarray, owner: np.ndarray, out: list[np.ndarray]) -> None:
        ranks = self.v.rank(m[:, :-1], m[:, 1:])
        while len(m):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(m)), at]
            else:
                least = np.full(len(m), NONE)
            if len(done := np.flatnonzero(least == NONE)):
                sizes = (m[done] >= 0).sum(axis=1)
                for i, row, size in zip(owner[done], m[done], sizes, strict=True):
                    out[i] = row[:size]
                on = least != NONE
                m, ranks, owner = m[on], ranks[on], owner[on]
                if not len(m):
                    return
                at, least = at[on], least[on]
            rows, columns = np.arange(len(m)), np.arange(m.shape[1] - 1)
            m[rows, at] = self.v.merged[least]
            m = np.take_along_axis(m, columns + (columns > at[:, None]), axis=1)
            if not m.shape[1] - 1:
                ranks = np.empty((len(m), 0), np.int32)
                continue
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.v.rank(m[before, at[before] - 1], m[before, at[before]])
            after = np.flatnonzero(at < m.shape[1] - 1)
            ranks[after, at[after]] = self.v.rank(m[after, at[after]], m[after, at[after] + 1])

    def _merge_long(self, x: np.ndarray) -> np.ndarray:
        while len(x) > 1:
            ranks = self.v.rank(x[:-1], x[1:])
            if (least := ranks.min()) == NONE:
                break
            at = np.flatnonzero(ranks == least)
            if x[at[0]] == x[at[0] + 1]:  # pairs in a run overlap: every other one counts
                run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
                first = np.searchsorted(run, run)
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            x = x.copy()
            x[at] = self.v.merged[least]
            x = np.delete(x, at + 1)
        return x.astype(np.int32)


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    yield some


def encode(df: DataFrame, key: Column, text: Column, path: str | Path, only_counts: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows (key, extra..., ids array<int>), or with only_counts (key, extra..., n_tokens bigint), one per row of df, without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    extra = extra or {}
    rows = df.select(key.alias("key"), *(c.alias(n) for n, c in extra.items()), text.alias("text"))
    schema = rows.drop("text").schema.add(*(("n_tokens", T.LongType()) if only_counts else ("ids", T.ArrayType(T.IntegerType()))))

    last_name = schema.names[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            done = 0
            for texts in _chunks(batch.column("text").to_pylist()):
                offsets, ids = encoder.encode(texts)
                kept = [c.slice(done, len(texts)) for c in batch.columns[:-1]]
                done += len(texts)
                last = pa.array(np.diff(offsets), pa.int64()) if only_counts else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept, last], names=[*batch.schema.names[:-1], last_name])

    return rows.mapInArrow(run, schema)


def vocabulary_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer in the folder that spark.plinth.tokenizers names, else in the default one."""
    return f"{spark.conf.get('spark.plinth.tokenizers', DEFAULT_FOLDER)}/{name}"
