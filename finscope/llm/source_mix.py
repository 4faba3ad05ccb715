"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

* Targets: sources by code point, null last, weigh `weights` in turn and share
  `share` times all words. No target is above `limit` times its source's words;
  what is over goes to the others by weight.
* The mix has as many blocks of `block` words as the targets hold. They go to
  the sources, one by one, each to the highest target / (2 x blocks so far + 1).
* A source is dealt by a hash of the id into shards of about `shard_words`
  words. Its blocks go to its shards in the same way, over groups of `fan`
  shards where there are more, so every shard has an integer quota.
* The documents of a shard, in an order drawn by the seed, are laid end to end
  `limit` times over and cut into blocks. The quota's blocks are drawn evenly
  from a seeded start, so no document gives more than `limit` times its words,
  and how many words it gives follows from where it begins and ends: no row is
  made for a block.

A block has 64 words, less where the least target has under 256 such blocks:
then a 256th of that target. What is worked in one task: the table of the
sources (a row each), the shards of a group, the documents of a shard.

Defined cases: a null or empty text has no words and gives none; a null source
is one of its own; rows that share an id are ordered by size and text, and rows
alike in all of it change nothing if they change places; a source without words
has the target 0; without any words all is 0; other columns are not read.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscope.llm.shared import written

WEIGHTS = (5, 2, 1)
#: Fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"


def apportioned(votes: np.ndarray, seats: int, limits: np.ndarray) -> np.ndarray:
    """Seats of each by highest votes / (2 x seats so far + 1), at most `limits`; ties go to the first."""
    votes, limits = np.asarray(votes, np.float64), np.asarray(limits, np.int64)
    seats = min(int(seats), int(limits[votes > 0].sum()))
    given = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return given
    surely = lambda level: np.where(votes > 0, np.minimum(np.minimum((votes / level + 1) / 2, 2.0**62).astype(np.int64), limits), 0)
    low, high = 0.0, float(votes.max()) * 2
    for _ in range(200):  # to the lowest quotient at which no more seats go than there are
        level = (low + high) / 2
        if level in (low, high):
            break
        if int(surely(level).sum()) > seats:
            low = level
        else:
            high = level
    given = surely(high * (1 + 1e-12))
    heap = [(-votes[i] / (2 * given[i] + 1), i) for i in np.flatnonzero((votes > 0) & (given < limits)).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < limits[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def targets(sizes: list[int], weights: list[int], share: float, limit: int) -> list[Fraction]:
    """Words that each source should give: in proportion to the weights, at most limit x its size, share x all in sum."""
    left, out = Fraction(share) * sum(sizes), [Fraction(0)] * len(sizes)
    rest = sorted(range(len(sizes)), key=lambda i: Fraction(limit * sizes[i], weights[i]))
    weight = sum(weights)
    for k, i in enumerate(rest):
        if limit * sizes[i] * weight >= left * weights[i]:  # from here on none is above
            for j in rest[k:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = Fraction(limit * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def _sources(sizes: DataFrame, weights, share: float, limit: int, block: int, least_blocks: int) -> DataFrame:
    """sizes (source, source_size) with target, block and seats."""

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["source"].to_pylist(), table["source_size"].to_pylist()), key=lambda r: (r[0] is None, r[0] or ""))
        own = [n for _, n in rows]
        goal = targets(own, [weights[i % len(weights)] for i in range(len(rows))], share, limit)
        least = min([t for t in goal if t > 0], default=Fraction(block))
        size = max(1, min(block, int(least // least_blocks)))
        seats = apportioned(np.array([float(t) for t in goal]), round(sum(goal) / size), np.array([-(-limit * n // size) for n in own], np.int64))
        return pa.table({"source": pa.array([s for s, _ in rows], pa.string()), "source_size": pa.array(own, pa.int64()), "target": pa.array([float(t) for t in goal], pa.float64()), "block": pa.array([size] * len(rows), pa.int64()), "seats": pa.array(seats, pa.int64())})

    return sizes.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(work, "source string, source_size long, target double, block long, seats long")


def _dealt(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children (parent columns, child, words, most, seats of the parent) with the child's own seats."""
    kept = [*parent, child]

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by(child)
        seats = apportioned(table["words"].to_numpy(), table["seats"][0].as_py(), table["most"].to_numpy())
        return table.select([*kept, "words", "most"]).append_column("seats", pa.array(seats, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in children.select(*kept, "words", "most").schema) + ", seats long"
    return children.select(*kept, "words", "most", "seats").groupBy(*parent).applyInArrow(work, schema)


def _same(a: DataFrame, b: DataFrame, *keys: str) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2, seed: int = 42, block: int = 64, least_blocks: int = 256, shard_words: int = 1 << 20, fan: int = 1024) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, taken) of every row: `taken` of its words go into the mix, repeats counted."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = written(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("text_key")), "sizes")
    sources = written(_sources(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit, block, least_blocks), "sources")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words)))
    rows = rows.join(sources.drop("seats"), _same(rows, sources, "source"), "left").drop(sources["source"])
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), shards))

    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("block").alias("block")).where("words > 0")
    cells = written(cells.withColumns({"most": F.ceil(F.col("words") * limit / F.col("block")).cast("long"), "part": F.expr(f"shard div {fan}")}), "shards")
    parts = cells.groupBy("source", "part").agg(F.sum("words").alias("words"), F.sum("most").alias("most"))
    own = sources.select("source", "seats")
    parts = _dealt(parts.join(own, _same(parts, own, "source")).drop(own["source"]), ["source"], "part").select("source", "part", "seats")
    quotas = _dealt(cells.join(parts, _same(cells, parts, "source", "part")).drop(parts["source"], parts["part"]), ["source", "part"], "shard")

    order = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ends", F.sum("size").over(order))
    quotas = quotas.select("source", "shard", "words", "most", "seats")
    rows = rows.join(quotas, _same(rows, quotas, "source", "shard"), "left").drop(quotas["source"], quotas["shard"])
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))
    rows = rows.withColumn("first", F.pmod(F.conv(F.substring(draw, 1, 8), 16, 10).cast("long"), F.greatest("most", F.lit(1))))
    until = lambda at: F.expr(f"block * ((({at}) div block * seats + first) div most) + ({at}) % block * (((({at}) div block + 1) * seats + first) div most - (({at}) div block * seats + first) div most)")
    taken = sum((until(f"ends + words * {i}") - until(f"ends - size + words * {i}") for i in range(limit)), F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", "shard", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"))
