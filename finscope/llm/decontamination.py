"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. Every document is looked
through for the n-grams of every test item; how many documents hold each n-gram
is counted over the whole corpus, and an item's seeds are those not far more
frequent than its median one, so that its rare n-grams are seeds however often
the item itself has been copied. Where a document holds a seed, the item is aligned
with the words around it: +2 a match, -1 a mismatch or gap, as a share of what
the item scores against itself. From `min_score` on the document is
contaminated, which also catches paraphrased and edited copies.

Documents are never shuffled. The items go to the tasks in blocks of bounded
size, and a larger benchmark takes more passes.

Defined cases: null or empty documents hold nothing; null items, and items of
fewer than n words, which chance would find anywhere, are never found; equal
items are each reported; repeated rows are judged row by row; other columns pass
through, and a clashing `leaks` is replaced; an empty benchmark finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.llm import anchors
from finscope.llm.shared import appended, portions, utf8

#: Characters of benchmark text that go to a task at a time.
BLOCK = 1 << 24
MATCH, OTHER = 2, -1

_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[97:123] = _INNER[128:] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each row) of lower-case UTF-8 rows set end to end."""
    inner = _INNER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inner[:-1]]) & ~edge[:-1]
    after = np.concatenate([inner[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~after) + 1
    s = anchors.sums(anchors.BYTE[raw])
    h = anchors.mixed(anchors.span(s, start, end, start) + (end - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, offsets))


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(column))


@dataclass
class Items:
    """Test items of one block: word hashes end to end, and where each n-gram is."""

    ids: list
    word: np.ndarray
    first: np.ndarray
    size: np.ndarray
    grams: np.ndarray  # sorted, distinct
    slot: np.ndarray  # places of grams[i] are place[slot[i]:slot[i + 1]]
    place: np.ndarray  # (item, word) of each n-gram
    bits: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str], n: int) -> Items:
        raw, offsets = lowered(pa.array(texts, pa.string()))
        word, size = words(raw, offsets)
        first = np.cumsum(size) - size
        item = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(word)) - first[item] if len(word) else np.zeros(0, np.int64)
        h = anchors.grams(word, n)
        inside = np.flatnonzero(at[: len(h)] + n <= size[item[: len(h)]])
        grams, own = np.unique(h[inside], return_inverse=True)
        order = np.argsort(own, kind="stable")
        slot = np.searchsorted(own[order], np.arange(len(grams) + 1))
        place = np.stack([item[inside][order], at[inside][order]], axis=1) if len(inside) else np.zeros((0, 2), np.int64)
        return cls(ids, word, first, size, grams, slot, place, cls.bitmap(grams))

    @staticmethod
    def bitmap(grams: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << max(16, (32 * len(grams)).bit_length()), bool)
        bits[grams & np.uint64(len(bits) - 1)] = True
        return bits

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, number of the n-gram) of those of h that the items have."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[h & np.uint64(len(self.bits) - 1)])
        own = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        good = self.grams[own] == h[at]
        return at[good], own[good]

    def rare(self, frequency: np.ndarray, times: int = 8) -> Items:
        """Only the seeds: each item's n-grams in at most `times` as many documents as its median one."""
        if not len(self.grams):
            return self
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.slot))
        own = frequency[gram]
        median = np.zeros(len(self.ids))
        order = np.lexsort([own, self.place[:, 0]])
        items, start, count = np.unique(self.place[order, 0], return_index=True, return_counts=True)
        median[items] = own[order][start + count // 2]
        keep = own <= times * np.maximum(median[self.place[:, 0]], 1)
        kept, slot_of = np.unique(gram[keep], return_inverse=True)
        slot = np.searchsorted(slot_of, np.arange(len(kept) + 1))
        return Items(self.ids, self.word, self.first, self.size, self.grams[kept], slot, self.place[keep], self.bitmap(self.grams[kept]))


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, column where it ends) of each row of items against the same row of texts.

    Padding has values that match nothing. One step for each word of the items,
    over all rows at once; gaps along a text are a running maximum.
    """
    n, width = texts.shape
    columns = np.arange(width, dtype=np.int32)
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        score = np.where(items[:, i : i + 1] == texts, MATCH, OTHER).astype(np.int32)
        now = np.maximum(np.maximum(above[:, :-1] + score, above[:, 1:] + OTHER), 0)
        now = np.maximum.accumulate(now - OTHER * columns, axis=1) + OTHER * columns
        at = now.argmax(axis=1)
        top = now[np.arange(n), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
        above[:, 1:] = now
    return best, end


def _matrix(values: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    at = first[:, None] + np.arange(int(size.max(initial=0)))
    inside = np.arange(int(size.max(initial=0))) < size[:, None]
    return np.where(inside, values[np.minimum(at, max(0, len(values) - 1))], np.uint64(pad))


def aligned(own: Items, word: np.ndarray, row_first: np.ndarray, row_size: np.ndarray, row: np.ndarray, at: np.ndarray, gram: np.ndarray, min_score: float):
    """(row, item, score, first word, word after the last) of each alignment that counts; words are counted within the row."""
    many = np.diff(own.slot)[gram]
    which = np.repeat(np.arange(len(gram)), many)
    places = own.place[np.repeat(own.slot[gram], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
    item, row, diagonal = places[:, 0], row[which], at[which] - places[:, 1]
    slack = np.maximum(4, own.size[item] // 2)
    low, high = np.maximum(0, diagonal - slack), np.minimum(row_size[row], diagonal + own.size[item] + slack)
    # Windows of an item in a row that overlap are one window.
    order = np.lexsort([low, item, row])
    row, item, low, high = row[order], item[order], low[order], high[order]
    group = np.cumsum(np.concatenate([[False], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])) if len(row) else row
    reach = np.maximum.accumulate(high + group * (int(row_size.max(initial=0)) + 1)) - group * (int(row_size.max(initial=0)) + 1) if len(row) else high
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (low[1:] > reach[:-1])]) if len(row) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    row, item, low = row[start], item[start], low[start]
    high = np.maximum.reduceat(high, start) if len(start) else high
    found = []
    order = np.argsort(high - low, kind="stable")
    for part in np.array_split(order, max(1, ceil(int((high - low).sum()) / 200_000))) if len(order) else []:
        r, i, a = row[part], item[part], low[part]
        size = high[part] - a
        items, texts = _matrix(own.word, own.first[i], own.size[i], 1), _matrix(word, row_first[r] + a, size, 2)
        score, end = align(items, texts)
        share = score / (MATCH * own.size[i])
        good = np.flatnonzero(share >= min_score)
        if not len(good):
            continue
        # The same backwards, over the words up to the end, tells where the alignment begins.
        backwards = np.where(np.arange(texts.shape[1]) <= end[good, None], texts[good], np.uint64(2))[:, ::-1]
        _, begin = align(items[good][:, ::-1], backwards)
        begin = texts.shape[1] - 1 - begin
        found += zip(r[good].tolist(), i[good].tolist(), share[good].tolist(), (a[good] + begin).tolist(), (a[good] + end[good] + 1).tolist())
    return sorted(found)


def _scan(column: pa.Array, n: int):
    """(first row, word hashes, first word and words of each row, row and place of each n-gram, its hash) for portions of a column."""
    raw, offsets = lowered(column)
    for a, b in portions(offsets, anchors.PORTION):
        own = offsets[a : b + 1] - offsets[a]
        word, size = words(raw[offsets[a] : offsets[b]], own)
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(b - a), size)
        at = np.arange(len(word)) - first[row]
        h = anchors.grams(word, n)
        inside = at[: len(h)] + n <= size[row[: len(h)]]
        yield a, word, first, size, row[: len(h)][inside], at[: len(h)][inside], h[inside]


def _frequencies(docs: DataFrame, shared, n: int) -> np.ndarray:
    """How many documents hold each n-gram of the items; one row for each n-gram and task is shuffled."""

    def work(batches):
        own = shared.value
        total = np.zeros(len(own.grams), np.int64)
        for batch in batches:
            for _, _, _, size, row, _, h in _scan(batch.column(0), n):
                at, gram = own.hits(h)
                pairs = np.unique(gram * len(size) + row[at]) // max(1, len(size))
                total += np.bincount(pairs, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    found = docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(shared.value.grams), np.int64)
    out[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, min_score: float = 0.4, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with `leaks`: the items found in each, best score first (item_id, score, first_word, end_word); empty for a clean document."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    blocks = max(1, ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK))
    fields = "leaks array<struct<item_id: bigint, score: double, first_word: bigint, end_word: bigint>>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    out = docs
    for block in range(blocks):
        held = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").toPandas()
        own = Items.of([None if x != x else int(x) for x in held["item_id"]], held["text"].tolist(), n)
        seeds = own.rare(_frequencies(docs.select(F.col(text_col).alias("text")), spark.sparkContext.broadcast(own), n))
        shared = spark.sparkContext.broadcast(seeds)

        def start(shared=shared):
            seeds = shared.value

            def work(batch: pa.RecordBatch):
                found = [[] for _ in range(batch.num_rows)]
                for base, word, first, size, row, at, h in _scan(batch.column(batch.schema.get_field_index(text_col)), n):
                    hit, gram = seeds.hits(h)
                    for r, i, score, a, b in aligned(seeds, word, first, size, row[hit], at[hit], gram, min_score):
                        found[base + r].append({"item_id": seeds.ids[i], "score": score, "first_word": a, "end_word": b})
                return [pa.array([sorted(x, key=lambda y: (-y["score"], y["item_id"] or 0, y["first_word"])) for x in found], kind)]

            return work

        before = [F.col("leaks").alias("_before")] if block else []
        out = appended(out.select(*[c for c in out.columns if c != "leaks"], *before), fields, start, rows=1000)
        if block:
            out = out.withColumn("leaks", F.concat("_before", "leaks")).drop("_before")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with the columns they had."""
    return with_leaks(docs, benchmark, **options).where(F.size("leaks") == 0).select(*docs.columns)
