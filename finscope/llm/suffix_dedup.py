"""Exact dedup of long byte strings by sorting suffixes with bucket-pointer refinement.

Suffixes are first put in buckets by their leading q bytes. A bucket whose
suffixes agree in their first d bytes is then refined by sorting them on the
identifiers of the buckets that they are in d bytes further on, and the parts are
refined again. Identifiers are updated in place and used by all later
refinements: a part is as much deeper as the bucket that was pointed to, so
depths multiply where that one is refined already. A bucket is left alone when it
has one suffix, or is as deep as a repeat must be.

Only suffixes in groups with a common anchor (see `repeats`) are sorted, each
group in one task, and equal runs of them count as one with a number of places.
Groups too large for a task are split by all the bytes that a slice of
neighbouring suffixes has in common.

Defined cases: null text is empty; a text shorter than `length` is kept; a very
long text is cut into parts that share what a window covers; rows of one id with
the same text are two places, so what they hold is repeated, and so it is for
rows without an id (ties: every place of a repeat is removed, the first one
too); an empty table gives an empty result; other columns are dropped, whatever
their names. Spans are bytes of the UTF-8 form, and may cut a character.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from finscope.llm import repeats
from finscope.llm.anchors import covered
from finscope.llm.shared import identified

#: Bytes of the initial buckets; they and how many there are fill a 64-bit word.
Q = 7
#: Depth of a bucket whose suffixes have ended.
WHOLE = 1 << 40


def refined_buckets(raw: np.ndarray, ends: np.ndarray, align: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their buckets, bucket of each place); buckets have one place, or places that agree in `length` bytes.

    raw: all texts end to end; ends: for each place, where its text ends; align:
    places of different numbers are never in one bucket.
    """
    n = len(raw)
    left = ends - np.arange(n)
    padded = np.concatenate([raw, np.zeros(Q, np.uint8)]).astype(np.uint64)
    gram = np.zeros(n, np.uint64)
    for i in range(Q):
        gram = gram << np.uint64(8) | np.where(i < left, padded[i : i + n], np.uint64(0))
    gram = gram << np.uint64(8) | np.minimum(left, Q + 1).astype(np.uint64)
    # A place that no other is aligned with is a bucket from the start.
    alone = np.bincount(align, minlength=1)[align] == 1
    met = np.flatnonzero(~alone)
    order = np.concatenate([np.flatnonzero(alone), met[np.lexsort((gram[met], align[met]))]])
    new = np.ones(n, bool)
    new[1:] = (gram[order[1:]] != gram[order[:-1]]) | (align[order[1:]] != align[order[:-1]])
    start = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    # A bucket is known by the place of its first suffix in the order.
    bucket, depth = np.empty(n, np.int64), np.zeros(n, np.int64)
    bucket[order] = start[own]
    depth[start] = np.where(left[order[start]] <= Q, WHOLE, Q)
    many = np.diff(np.append(start, n)) > 1
    active = np.flatnonzero((many & (depth[start] < length))[own])
    while len(active):
        place = order[active]
        old = bucket[place]
        pointer = bucket[place + depth[old]]
        by = np.lexsort((pointer, old))
        place, old, pointer = place[by], old[by], pointer[by]
        order[active] = place
        new = np.ones(len(active), bool)
        new[1:] = (old[1:] != old[:-1]) | (pointer[1:] != pointer[:-1])
        first = np.flatnonzero(new)
        own = np.cumsum(new) - 1
        deeper = depth[old[first]] + depth[pointer[first]]
        bucket[place] = active[first][own]
        depth[active[first]] = deeper
        many = np.diff(np.append(first, len(active))) > 1
        active = active[(many & (deeper < length))[own]]
    return order, bucket


def repeated_windows(groups, shapes, least, n, pieces, length: int):
    """The windows that occur more than once (see `repeats.by_group`)."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array(list(map(len, pieces)))
    stop = np.cumsum(sizes)
    base = stop - sizes
    windows, place = shapes >> 16, shapes & 0xFFFF
    # Equal windows of a group have the anchor at the same offset; so have all later places of them.
    offset = np.arange(len(raw)) - np.repeat(base + place, sizes)
    low = int(offset.min())
    align = np.repeat(groups, sizes) * (int(offset.max()) - low + 1) + offset - low
    order, bucket = refined_buckets(raw, np.repeat(stop, sizes), align, length)
    run = np.repeat(np.arange(len(pieces)), sizes)
    inside = np.arange(len(raw)) < (base + windows)[run]
    w = order[inside[order]]
    # Neighbours in different buckets can still agree as far as a window goes, where a pointer led further.
    step = min(8, length)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(raw), np.uint64)
    for i in range(step):
        word |= padded[i : i + len(raw)] << np.uint64(8 * i)
    apart = bucket[w[1:]] != bucket[w[:-1]]
    open_ = np.flatnonzero(apart & (align[w[1:]] == align[w[:-1]]))
    for at in [*range(0, length - step, step), length - step]:
        open_ = open_[word[w[open_] + at] == word[w[open_ + 1] + at]]
    apart[open_] = False
    kind = np.cumsum(np.concatenate([[False], apart])) if len(w) else w
    again = np.sort(w[np.bincount(kind, n[run[w]])[kind] > 1])
    owner = run[again]
    return owner, again - base[owner], np.zeros(len(again), np.int64)


def deduped(docs: DataFrame, length: int = 400, group: int = 512, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each document.

    Removes each byte covered by a string of `length` bytes that also starts
    anywhere else. spans: maximal removed runs (start, end); kept: the other
    bytes; group: the most different runs that are sorted together.
    """
    unit = repeats.Bytes(length, k or max(1, length // 3))
    rows = identified(docs, id_col, text_col)
    cand = repeats.candidates(rows, unit, across=False)
    runs = repeats.distinct_runs(cand)
    pieces = repeats.run_texts(rows, runs, unit)
    marks = repeats.marks_of(runs, pieces, unit, lambda *x: repeated_windows(*x, length), group, [w for w in (32, 4, 1) if w < length])
    found = repeats.marked_places(cand, marks)

    def finish(text, hits):
        raw = unit.units(text)
        if not len(hits):
            return len(raw), 0, [], raw
        gone = covered(*repeats.stretches(hits), length, len(raw))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
        return len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()

    return repeats.found_by_document(rows, found, finish, "n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary")
