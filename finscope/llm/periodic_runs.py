"""Periodic runs: stretches of a text that repeat a few words over and over.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least `repeats` periods and `least` words, which neither
neighbour extends. Runs are found by a suffix automaton with link-cut access:

* a first look at the gaps between equal words leaves only the stretches that
  can hold a run: of a run of period q and length n, the first n - q words all
  recur after q words or fewer, and q is at most a (repeats - 1)-th of n - q;
* of each such stretch, and as many words after it as a period can have, a
  suffix automaton is built; its suffix links are a tree, and the suffixes of
  the first i words are the path from their state to the root;
* word after word, that path is exposed in a link-cut tree and coloured with i.
  A part of it that had the colour j holds the suffixes last seen at j; its
  deepest state is as long as what ends alike at i and at j. Where that is no
  shorter than i - j there is a square of that period;
* a square is taken where the word behind it doesn't go on with the period. With
  three periods or more the run's own period is then the nearest earlier end of
  its suffixes (a nearer one would make the period smaller), and the length is
  exact, so each run is found once, at its last word.

Defined cases: a null or empty text has no word and no run; documents don't
meet, so ties, repeated rows and ids, null or not, are each row's own; columns
named like the new ones are replaced. A document is worked by one task; the
automaton takes about a kilobyte for each word of a stretch that may hold a run.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from finscope.llm.shared import appended

#: Fixed by the contract.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rounds in which stretches are narrowed; stopping early leaves more to the automaton and changes nothing else.
ROUNDS = 64

FIELDS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[str]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def candidates(ids: np.ndarray, repeats: int, least: int) -> list[tuple[int, int]]:
    """[first, end) of the stretches in which the words of a run before its last period can lie."""
    n, share = len(ids), repeats - 1
    shortest = min(max(least - q, share * q) for q in range(1, least + 1))
    if n <= shortest:
        return []
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, n, np.int64)  # to the next equal word; too far where there is none
    alike = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][alike]] = (order[1:] - order[:-1])[alike]
    near = gap * share <= n
    for _ in range(ROUNDS):
        edges = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
        first, end = edges[::2], edges[1::2]
        size = end - first
        kept = near & (gap * share <= _spread(first, end, size, n)) & (_spread(first, end, size, n) >= shortest)
        if (kept == near).all():
            break
        near = kept
    edges = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _spread(first, end, values, n: int) -> np.ndarray:
    """values at the places of their stretches, 0 elsewhere."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, values)
    np.subtract.at(steps, end, values)
    return np.cumsum(steps[:-1])


class SuffixAutomaton:
    """States from 1, the root; `length` of a state's longest string, `link` to its longest suffix elsewhere, `ends`: the state of the first i + 1 symbols."""

    def __init__(self, symbols) -> None:
        self.length, self.link, self.after, self.ends = [0, 0], [0, 0], [{}, {}], []
        length, link, after = self.length, self.link, self.after
        last = 1
        for symbol in symbols:
            new = self._state(length[last] + 1, {})
            at = last
            while at and symbol not in after[at]:
                after[at][symbol] = new
                at = link[at]
            if not at:
                link[new] = 1
            else:
                to = after[at][symbol]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    twin = self._state(length[at] + 1, after[to].copy())
                    link[twin] = link[to]
                    link[to] = link[new] = twin
                    while at and after[at].get(symbol) == to:
                        after[at][symbol] = twin
                        at = link[at]
            self.ends.append(new)
            last = new

    def _state(self, length: int, after: dict) -> int:
        self.length.append(length)
        self.link.append(0)
        self.after.append(after)
        return len(self.length) - 1


class LinkCutTree:
    """A rooted tree in parts: each a path downwards of one colour, kept as a splay tree by depth whose root knows the colour."""

    def __init__(self, parent: list[int]) -> None:
        self.parent = list(parent)  # within a splay tree, and from its root on to the tree above
        self.left, self.right, self.colour = ([0] * len(parent) for _ in range(3))

    def _splay(self, x: int) -> None:
        """x becomes the root of its splay tree."""
        parent, left, right, colour = self.parent, self.left, self.right, self.colour
        while True:
            p = parent[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = parent[p]
            inner = g and (left[g] == p or right[g] == p)
            for y in ((p if (left[g] == p) == (left[p] == x) else x), x) if inner else (x,):
                up = parent[y]
                over = parent[up]
                if over and left[over] == up:
                    left[over] = y
                elif over and right[over] == up:
                    right[over] = y
                else:
                    colour[y] = colour[up]
                if left[up] == y:
                    below = left[up] = right[y]
                    right[y] = up
                else:
                    below = right[up] = left[y]
                    left[y] = up
                if below:
                    parent[below] = up
                parent[up] = y
                parent[y] = over

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from node to the root one colour; (colour before, deepest node of it on the path) of each part, from below."""
        parts, below, x = [], 0, node
        while x:
            self._splay(x)
            parts.append((self.colour[x], x))
            deeper = self.right[x]
            if deeper:  # goes on as a part of its own
                self.colour[deeper] = self.colour[x]
            self.right[x] = below
            below, x = x, self.parent[x]
        self._splay(node)
        self.colour[node] = colour
        return parts


def squares(symbols, repeats: int):
    """(last place, period, how many symbols before and with it equal those a period earlier), where that is at least repeats - 1 periods."""
    automaton = SuffixAutomaton(symbols)
    tree, length = LinkCutTree(automaton.link), automaton.length
    for i, state in enumerate(automaton.ends):
        for before, deepest in tree.access(state, i + 1):
            if before and length[deepest] >= (repeats - 1) * (i + 1 - before):
                yield i, i + 1 - before, length[deepest]


def runs_of(ids: np.ndarray, repeats: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if repeats < 3:
        raise ValueError("The nearest earlier end is the period of runs of three periods or more only.")
    n, out = len(ids), []
    for first, end in candidates(ids, repeats, least):
        symbols = ids[first : min(n, end + (end - first) // (repeats - 1))].tolist()
        for at, period, alike in squares(symbols, repeats):
            last, size = first + at, alike + period
            start = last - size + 1
            goes_on = last + 1 < n and ids[last + 1] == ids[last + 1 - period]
            began = start and ids[start - 1] == ids[start - 1 + period]  # found whole in the stretch before
            if size >= least and start < end and not goes_on and not began:
                out.append((start, size, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def analysed(text: str | None, repeats: int, least: int) -> tuple[int, list[tuple[int, int, int]], str]:
    """(number of words, runs, words that are left when of each run only the first period stays)."""
    words = WORD.findall(text or "")
    runs = runs_of(numbered(words), repeats, least)
    if runs:
        drop = np.zeros(len(words), bool)
        for start, size, period in runs:
            drop[start + period : start + size] = True
        kept = [w for w, gone in zip(words, drop.tolist()) if not gone]
    else:
        kept = words
    return len(words), runs, " ".join(kept)


def found(docs: DataFrame, text_col: str = "text", repeats: int = 4, least: int = 6) -> DataFrame:
    """docs with n_words, `runs` (by start, then period; words are numbered from 0) and `collapsed`, the words left, joined by one space.

    A word is left out where a run holds it after that run's first period.
    """

    def start():
        def work(batch):
            sizes, runs, left, offsets = [], [], [], [0]
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                n, own, kept = analysed(text, repeats, least)
                sizes.append(n)
                runs += own
                offsets.append(len(runs))
                left.append(kept)
            columns = np.array(runs, np.int64).reshape(-1, 3)
            made = pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], fields=list(_RUN))
            return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made), pa.array(left, pa.string())]

        return work

    return appended(docs, FIELDS, start)
