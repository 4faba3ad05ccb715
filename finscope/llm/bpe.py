"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens by the tokenizer's pattern. Tier one is a
minimal perfect hash over the vocabulary: a pre-token that is a token as it
stands costs one hash and one comparison. Tier two merges the bytes of the
others, held as a linked list, in the order of a heap of (rank, place).

Defined cases: null text encodes as empty (no ids); each row is encoded by
itself, so ids, ties and repeats don't matter; other columns pass through and
new ones replace equally named ones; a text of any length is handled in
stretches that end between pre-tokens, so memory doesn't grow with it.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from finscope.llm.shared import appended, mixed

#: Characters of a text that are split into pre-tokens at a time.
STRETCH = 1 << 20
#: No alternative of the pattern looks further than this past the end of its match.
LOOKAHEAD = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass
class PerfectHash:
    """Hash-and-displace: a bucket's displacement sends all its keys to slots of their own; as many slots as keys."""

    displacement: np.ndarray
    keys: list[bytes]
    values: np.ndarray

    STEP = np.uint64(0x9E3779B97F4A7C15)

    @classmethod
    def build(cls, table: dict[bytes, int], per_bucket: int = 4, tries: int = 512) -> PerfectHash:
        keys = list(table)
        n, n_buckets = len(keys), len(keys) // per_bucket + 1
        h = cls.hashed(keys)
        bucket = (h % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        displacement, taken, slot_of = np.zeros(n_buckets, np.uint64), np.zeros(n, bool), np.zeros(n, np.int64)
        for b in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            first = 0
            while len(own):
                d = np.arange(first, first + tries, dtype=np.uint64)
                slots = cls._slots(h[own][None, :], d[:, None], n)
                ordered = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    displacement[b], slot_of[own] = d[k], slots[k]
                    taken[slots[k]] = True
                    break
                first += tries
        placed = np.argsort(slot_of)
        return cls(displacement, [keys[i] for i in placed], np.array([table[keys[i]] for i in placed], np.int64))

    @staticmethod
    def hashed(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @classmethod
    def _slots(cls, h, d, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(h + d * cls.STEP) % np.uint64(n)).astype(np.int64)

    def find(self, pieces: list[bytes]) -> list[int]:
        """The value of each piece, -1 where it is no key."""
        if not pieces or not self.keys:
            return [-1] * len(pieces)
        h = self.hashed(pieces)
        slots = self._slots(h, self.displacement[(h % np.uint64(len(self.displacement))).astype(np.int64)], len(self.keys))
        keys = self.keys
        return [v if keys[s] == p else -1 for s, v, p in zip(slots.tolist(), self.values[slots].tolist(), pieces)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merges of the least rank first, leftmost among equals."""
    n, rank_of = len(piece), ranks.get
    # A part is known by its first byte: after[i] is where it ends, pair[i] the rank of it and the next one, or -1.
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [rank << 32 | i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        first = pop(heap)
        i = first & 0xFFFFFFFF
        if pair[i] != first >> 32:
            continue  # one of the two has grown or gone since
        j = after[i]
        end = after[j]
        after[i], pair[j] = end, -1
        if end < n:
            before[end] = i
            rank = pair[i] = rank_of(piece[i : after[end]], -1)
            if rank >= 0:
                push(heap, rank << 32 | i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            rank = pair[h] = rank_of(piece[h:end], -1)
            if rank >= 0:
                push(heap, rank << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


#: What Python takes for an entry of a dict with its two small objects, besides their contents.
ENTRY = 200


class Coder:
    """Encoder of one task. `known` holds what was resolved lately, `keep` bytes besides what the text at hand needs."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, pattern: str, keep: int = 128 << 20):
        self.ranks, self.table, self.keep = ranks, table, keep
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def pieces(self, text: str, start: int = 0):
        """Lists of the pre-tokens of text[start:], in order."""
        step, n = STRETCH, len(text)
        while start < n:
            end = min(n, start + step)
            found = self.split.findall(text[start:end] if start or end < n else text)
            if end < n:
                rest = end - start
                while found and rest > end - start - LOOKAHEAD:  # what touches the end may go on
                    rest -= len(found.pop())
                while found and found[-1].isspace():  # white space may go on, too
                    rest -= len(found.pop())
                if not found:
                    step *= 2
                    continue
                end = start + rest
            yield found
            start, step = end, STRETCH

    def learn(self, pieces) -> None:
        wanted = set(pieces)
        if self.held > self.keep:  # those that came first go
            for old in list(islice(self.known, len(self.known) // 2)):
                self.held -= ENTRY + len(old) + len(self.known.pop(old))
        new = list(wanted.difference(self.known))
        raw = [p.encode() for p in new]
        known, ranks = self.known, self.ranks
        for piece, own, rank in zip(new, raw, self.table.find(raw)):
            ids = known[piece] = rank.to_bytes(4, "little") if rank >= 0 else b"".join([i.to_bytes(4, "little") for i in merged(own, ranks)])
            self.held += ENTRY + len(piece) + len(ids)

    def encode(self, pieces: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self.learn(pieces)
            return b"".join(map(self.known.__getitem__, pieces))


@lru_cache(maxsize=1)
def _built(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    ranks = read_ranks(path)
    return ranks, PerfectHash.build(ranks)


class Tokenizer:
    """Ranks and perfect hash, built once on the driver and sent to the executors; its size is that of the vocabulary file."""

    def __init__(self, spark, path: str, pattern: str, keep: int = 128 << 20):
        self.shared = spark.sparkContext.broadcast(_built(path))
        self.pattern, self.keep = pattern, keep

    def coder(self) -> Coder:
        """A new encoder; it and what it has resolved go with the task."""
        return Coder(*self.shared.value, self.pattern, self.keep)

    def bytes_of(self):
        """A function from ids (binary) to the bytes that they stand for."""
        ranks, _ = self.shared.value
        token = dict(zip(ranks.values(), ranks)).__getitem__
        return lambda ids: b"".join(map(token, np.frombuffer(ids or b"", "<u4").tolist()))


def encoded(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", decode: bool = False) -> DataFrame:
    """docs with `ids` (binary: little-endian unsigned 32-bit integers) and `n_tokens` (long), and if asked for with `decoded` (binary), made from the ids in the same pass."""

    def start():
        coder = tokenizer.coder()
        back = tokenizer.bytes_of() if decode else None

        def work(batch: pa.RecordBatch):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ids = [b"".join(map(coder.encode, coder.pieces(t))) if t else b"" for t in texts]
            more = [pa.array(list(map(back, ids)), pa.binary())] if decode else []
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), *more]

        return work

    return appended(docs, "ids binary, n_tokens long" + ", decoded binary" * decode, start)


def decoded(df: DataFrame, tokenizer: Tokenizer, ids_col: str = "ids") -> DataFrame:
    """df with `decoded` (binary), the bytes that the ids stand for; null ids give empty bytes."""

    def start():
        back = tokenizer.bytes_of()

        def work(batch: pa.RecordBatch):
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            return [pa.array(list(map(back, ids)), pa.binary())]

        return work

    return appended(df, "decoded binary", start)
