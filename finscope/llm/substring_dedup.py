"""Substring dedup by suffix trees over groups of suffixes that share a prefix.

Suffixes (the words from a window's start on) can only share a deep node of the
corpus's suffix tree if they share what `repeats` calls an anchor, so the first
prefixes are the anchors' words. Groups that would not fit in memory are split by
longer prefixes: the words common to a slice of neighbouring windows, in the end
the whole window (`prefixes`). Each group's tree is built top down, a node for
each place where suffixes part or end together; those at a depth of a window or
more are the repeats, and where their suffixes also differ before, they are
maximal. A run of windows that is equal in several documents is one suffix with a
count, so what is copied unchanged is a node as well. The first deep node on a
suffix's way down knows the least doc_id below: the window is a repeat in every
document of a greater id.

Defined cases: null text has no words; a text shorter than a window is kept; a
very long text is cut into parts that share what a window covers; a null id comes
after all others, and rows without an id never remove each other; rows of one id
never remove each other, whether their texts are the same or not (ties have no
order, so both stay); an empty table gives an empty result; other columns are
dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.llm import repeats
from finscope.llm.anchors import covered
from finscope.llm.shared import identified


@dataclass
class DeepNodes:
    """Internal nodes of a depth of at least a window; locus is each suffix's first one on the way down, or -1."""

    depth: list[int]
    suffix: list[int]
    places: list[int]
    maximal: list[bool]
    locus: np.ndarray


def deep_nodes(word: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, least_depth: int, places: np.ndarray | None = None, all_nodes: bool = True) -> DeepNodes:
    """The compressed suffix tree of each group, as far as it is deep.

    word: ids of the words of all texts end to end; starts, ends: of suffixes;
    places: how often each suffix occurs. A node is where suffixes part, or where
    several end. Without all_nodes the tree is left at the first one of each suffix.
    """
    places = np.ones(len(starts), np.int64) if places is None else places
    # What stands before a suffix tells whether its node is maximal; at the start of a text that is different for all.
    before = np.where(np.isin(starts, np.concatenate([[0], np.unique(ends)])), -1 - np.arange(len(starts)), word[np.maximum(starts - 1, 0)] if len(word) else 0)
    out = DeepNodes([], [], [], [], np.full(len(starts), -1, np.int64))
    active, at, size, d = np.arange(len(starts)), group, int(word.max(initial=0)) + 2, 0
    while len(active):
        _, at = np.unique(at, return_inverse=True)
        inner = np.bincount(at, places[active]) > 1  # the others are leaves
        keep = inner[at]
        active, at = active[keep], at[keep]
        if not len(active):
            break
        over = starts[active] + d >= ends[active]
        symbol = np.where(over, 0, word[np.minimum(starts[active] + d, len(word) - 1)] + 1)
        child = at * size + symbol
        if d >= least_depth:
            _, one = np.unique(child, return_index=True)
            branches = np.bincount(at[one], minlength=len(inner)) > 1
            branches[at[over]] = True
            for node in np.flatnonzero(branches) if all_nodes else ():
                own = active[at == node]
                out.depth.append(d)
                out.suffix.append(int(own[0]))
                out.places.append(int(places[own].sum()))
                out.maximal.append(len(np.unique(before[own])) > 1)
            here = branches[at] & (out.locus[active] < 0)
            out.locus[active[here]] = at[here] + d * len(starts)
            if not all_nodes:
                over |= branches[at]
        active, at, d = active[~over], child[~over], d + 1
    return out


def maximal_repeats(texts: list[list], length: int) -> set[tuple]:
    """Every sequence of at least `length` units that occurs twice or more in the texts and that no longer one always contains."""
    ids: dict = {}
    word = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
    stop = np.cumsum(list(map(len, texts)))
    ends = np.repeat(stop, list(map(len, texts)))
    nodes = deep_nodes(word, np.arange(len(word)), ends, np.zeros(len(word), np.int64), length)
    flat = [w for t in texts for w in t]
    return {tuple(flat[s : s + d]) for s, d, m in zip(nodes.suffix, nodes.depth, nodes.maximal) if m}


def repeats_in_groups(groups, shapes, least, n, pieces, length: int):
    """The windows under a deep node, each with the least doc_id there (see `repeats.by_group`)."""
    ids: dict[bytes, int] = {}
    split = [p.split(b" ") for p in pieces]
    word = np.array([ids.setdefault(w, len(ids)) for s in split for w in s], np.int64)
    stop = np.cumsum(list(map(len, split)))
    base = stop - np.array(list(map(len, split)))
    windows, place = shapes >> 16, shapes & 0xFFFF
    owner = np.repeat(np.arange(len(pieces)), windows)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    # Within a group, equal windows have the anchor at the same offset.
    group = groups[owner] * (length + 1) + place[owner] - index
    locus = deep_nodes(word, base[owner] + index, stop[owner], group, length, n[owner], all_nodes=False).locus
    deep = np.flatnonzero(locus >= 0)
    _, node = np.unique(locus[deep], return_inverse=True)
    low = np.full(int(node.max(initial=-1)) + 1, repeats.LAST)
    np.minimum.at(low, node, least[owner[deep]])
    return owner[deep], index[deep], low[node]


def prefixes(length: int) -> list[int]:
    """Widths of the slices by which groups that are too large are split; the prefix that a slice's windows share is longer, the narrower it is."""
    return [w for w in (3, 1) if w < length]


def deduped(docs: DataFrame, length: int = 13, group: int = 512, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) for each document.

    Removes each word covered by `length` consecutive words that also start in a
    document of a smaller id. spans: removed runs of words (start, end) in the
    input; group: the most different runs whose suffixes make one tree.
    """
    unit = repeats.Words(length, k or max(1, (length + 1) // 3 + (length > 4)))
    rows = identified(docs, id_col, text_col)
    cand = repeats.candidates(rows, unit, across=True)
    runs = repeats.distinct_runs(cand)
    pieces = repeats.run_texts(rows, runs, unit)
    marks = repeats.marks_of(runs, pieces, unit, lambda *x: repeats_in_groups(*x, length), group, prefixes(length))
    found = repeats.marked_places(cand, marks, lambda m: m["least"] < F.col("who"))

    def finish(text, hits):
        words = unit.units(text)
        if not len(hits):
            return len(words), 0, [], b" ".join(words).decode()
        gone = covered(*repeats.stretches(hits), length, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
        return len(words), int(gone.sum()), spans, b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()

    return repeats.found_by_document(rows, found, finish, "n_words long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept_text string")
