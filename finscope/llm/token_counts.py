"""Token counts that follow edits without encoding a document again.

Each document keeps a segment tree over its pre-tokens: a leaf holds a few
consecutive pre-tokens, and every node the characters and tokens below it. An
edit re-encodes from the leaf before it to the first leaf start, after it, at
which old and new pre-tokens fall together; leaves and the sums above them are
then updated.

Defined cases: null text counts as empty; edits are in code points of the old
text, and those that are null, reversed or out of range are cut to it; edits
that overlap an earlier one lose the overlapped part; each row is counted by
itself, so ids, ties and repeats don't matter; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from finscope.llm.bpe import LOOKAHEAD, Coder, Tokenizer
from finscope.llm.shared import appended

#: Pre-tokens in a leaf when a tree is built.
LEAF = 16


class CountTree:
    """Sums of characters and tokens over leaves; node 1 is the root, leaf i is node size + i."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.n = len(chars)
        self.size = 1 << max(0, (self.n - 1).bit_length()) if self.n else 1
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + self.n, 0] = chars
        self.sums[self.size : self.size + self.n, 1] = tokens
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def of(cls, coder: Coder, text: str) -> CountTree:
        chars, tokens = [], []
        for found in coder.pieces(text):
            if not coder.known.keys() >= (new := set(found)):
                coder.learn(new)
            starts = range(0, len(found), LEAF)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            counts = np.fromiter(map(len, map(coder.known.__getitem__, found)), np.int64, len(found)) // 4
            chars.append(np.add.reduceat(lengths, starts))
            tokens.append(np.add.reduceat(counts, starts))
        none = np.zeros(0, np.int64)
        return cls(np.concatenate(chars or [none]), np.concatenate(tokens or [none]))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character at `place`; the last one for places beyond."""
        node, start, place = 1, 0, min(place, int(self.sums[1, 0]) - 1)
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            node, start, place = (2 * node, start, place) if place < left else (2 * node + 1, start + left, place - left)
        return node - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def cleaned(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits within the text, in order, without overlaps."""
    out, done = [], 0
    for start, end, new in sorted((e["start"] or 0, e["end"] or 0, e["new"] or "") for e in edits or [] if e):
        start, end = max(done, min(start, length)), min(max(end, start), length)
        if end >= start and (end > start or new):
            out.append((start, end, new))
            done = max(done, end)
    return out


def edited_text(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def apply_edits(tree: CountTree, coder: Coder, text: str, edits: list[tuple[int, int, str]]) -> tuple[CountTree, int]:
    """(the tree of the edited text, pre-tokens that were encoded again). `edits` come from `cleaned`."""
    new_text, again = edited_text(text, edits), 0
    if not tree.n:
        tree = CountTree.of(coder, new_text)
        return tree, tree.tokens
    settled, k, shift = [], 0, 0  # changed leaves; edits taken in, and by how much they move what follows

    def taken() -> int:
        """Take in the next edit; where its new text ends."""
        nonlocal k, shift
        start, end, new = edits[k]
        k, shift = k + 1, shift + len(new) - (end - start)
        return end + shift

    while k < len(edits):
        first, leaf_start = tree.leaf_at(max(0, edits[k][0] - LOOKAHEAD))
        leaf, at = first, leaf_start + shift
        places, chars, tokens = coder.split.finditer(new_text, at), 0, 0
        behind = taken()
        while True:
            if at >= behind:
                old = at - shift
                while leaf < tree.n and leaf_start < old:
                    leaf_start += int(tree.sums[tree.size + leaf, 0])
                    leaf += 1
                if k < len(edits) and edits[k][0] - LOOKAHEAD < old:
                    behind = taken()
                    continue
                if leaf_start == old:
                    break
            if (found := next(places, None)) is None:
                leaf = tree.n
                break
            piece = found.group()
            at += len(piece)
            chars += len(piece)
            tokens += len(coder.encode([piece])) // 4
            again += 1
        settled.append((first, leaf, (chars, tokens)))
    for first, last, (chars, tokens) in settled:
        tree.set(first, chars, tokens)
        for leaf in range(first + 1, last):
            tree.set(leaf, 0, 0)
    return tree, again


def pattern_edits(docs: DataFrame, pattern: str, new: str, text_col: str = "text") -> DataFrame:
    """docs with `edits` (array of start, end, new): one replacement for each match of the pattern, as a redaction makes them."""

    def start():
        find = re.compile(pattern).finditer

        def work(batch: pa.RecordBatch):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            edits = [[{"start": m.start(), "end": m.end(), "new": new} for m in find(t or "")] for t in texts]
            return [pa.array(edits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("new", pa.string())])))]

        return work

    return appended(docs, "edits array<struct<start: bigint, end: bigint, new: string>>", start)


def counted(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text") -> DataFrame:
    """docs with `n_tokens` (long) and the tree's leaves, `leaf_chars` and `leaf_tokens` (arrays of long), to be stored and edited later."""

    def start():
        coder = tokenizer.coder()

        def work(batch: pa.RecordBatch):
            trees = [CountTree.of(coder, t or "") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            leaves = [t.sums[t.size : t.size + t.n] for t in trees]
            of = lambda k: pa.array([x[:, k] for x in leaves], pa.list_(pa.int64()))
            return [pa.array([t.tokens for t in trees], pa.int64()), of(0), of(1)]

        return work

    return appended(docs, "n_tokens long, leaf_chars array<bigint>, leaf_tokens array<bigint>", start)


def recounted(state: DataFrame, tokenizer: Tokenizer, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """state (a text, its edits, and the leaves that `counted` made) with its counts after the edits.

    n_edits, n_tokens_edited, n_reencoded (pre-tokens encoded again) and the new leaves.
    """

    def start():
        coder = tokenizer.coder()

        def work(batch: pa.RecordBatch):
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            done = []
            for text, edits, chars, tokens in zip(column(text_col), column(edits_col), column("leaf_chars"), column("leaf_tokens")):
                text = text or ""
                edits = cleaned(edits, len(text))
                if not edits:
                    done.append((0, sum(tokens or []), 0, chars or [], tokens or []))
                    continue
                tree = CountTree(np.array(chars or [], np.int64), np.array(tokens or [], np.int64))
                tree, again = apply_edits(tree, coder, text, edits)
                leaves = tree.sums[tree.size : tree.size + tree.n]
                done.append((len(edits), tree.tokens, again, leaves[:, 0], leaves[:, 1]))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            return [pa.array(list(x), kind) for x, kind in zip(zip(*done), kinds)] if done else [pa.array([], kind) for kind in kinds]

        return work

    return appended(state, "n_edits long, n_tokens_edited long, n_reencoded long, leaf_chars array<bigint>, leaf_tokens array<bigint>", start)
