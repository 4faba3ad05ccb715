"""Names that nearly agree: each name of a small block held against every other, an inverted index with a prefix filter in large ones, then the exact score.

The score of two names is 100 x 2 x longest common subsequence / total length of
the names with their words sorted. Names of score t differ by deletions alone,
at most (1 - t / 100) x total length of them, and every letter deleted takes at
most q q-grams along (an inserted one breaks q - 1). So near names share nearly
all q-grams, told apart by how often they have occurred in the name; and of all
q-grams of a name all but `lost` are in any name near it, so that two near names
share one of their lost + 1 rarest.

The names with equal keys are a block. One of up to 8 x FAN names is a list. A
larger one has a list for each q-gram of the names that have it among their
rarest, but is a list itself where the q-grams are so few that their lists hold
more pairs than it does. A long list is cut into parts, and pairs of parts are
cells that are dealt out, so no task holds a whole list. Within a cell a product
of matrices counts the q-grams that names share; for pairs that share enough
bit-parallel subsequences are found, and those long enough give the score.

Equal names are one row: links are between classes of records with a name, so a
name that a third of all records bear is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscope.matching.pairs import indel_ratio, sorted_tokens
from finscope.scratch import written

#: Names of a list's part; a task compares those of two parts with each other.
FAN = 2048
#: Columns and rows of a product of matrices.
COLUMNS, ROWS = 512, 512


def _grams(name: str, q: int) -> Column:
    """q-grams of the name with its ends marked, each with the number of its occurrence."""
    ends = F.concat(F.lit("^" * (q - 1)), F.col(name), F.lit("$" * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(name) + F.lit(q - 1)), lambda i: F.substr(ends, i, F.lit(q)))
    return F.transform(F.array(grams), lambda gs: F.transform(gs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(gs, F.lit(1), i + 1), lambda x: x == g)).cast("string"))))[0]


def _counts(names: list[str], q: int) -> np.ndarray:
    """A row for each name and a column for each q-gram with the number of its occurrence: 1 where the name has it.

    More than COLUMNS of them are folded and added up. The product of two rows is
    what they share, or more where columns are folded.
    """
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    letters = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64) + 1  # 0 is an end
    rows = np.repeat(np.arange(len(names)), lengths + q - 1)
    at = np.arange(len(letters)) + (q - 1) * np.repeat(np.arange(len(names)), lengths)
    grams = np.zeros(len(rows), np.int64)
    grams[at] = letters
    if q == 2:
        grams[at + 1] += letters << 21
    kinds = np.unique(grams, return_inverse=True)[1]
    order = np.lexsort((kinds, rows))
    rows, kinds = rows[order], kinds[order]
    start = np.r_[True, (rows[1:] != rows[:-1]) | (kinds[1:] != kinds[:-1])]
    number = np.arange(len(rows)) - np.flatnonzero(start)[np.cumsum(start) - 1]
    columns = np.unique(kinds * (number.max() + 1) + number, return_inverse=True)[1]
    out = np.zeros((len(names), min(columns.max() + 1, COLUMNS)), np.float32)
    np.add.at(out, (rows, columns % COLUMNS), 1)
    return out


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name's number, place in it, kind) of all letters of the names; kinds are 1 to 255 and hold several letters each where there are more."""
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    kinds = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32), return_inverse=True)[1] % 255 + 1
    rows = np.repeat(np.arange(len(names)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths), kinds


class _Subsequences:
    """Longest common subsequences of many pairs at once, a bit for each letter of the left name; too long at most, where letters share a kind."""

    def __init__(self, left: list[str], right: list[str] | None) -> None:
        rows, places, kinds = _letters(left if right is None else left + right)
        own = (rows < len(left)) & (places < 64)
        self.masks = np.zeros((len(left), 256), np.uint64)
        np.bitwise_or.at(self.masks, (rows[own], kinds[own]), np.uint64(1) << places[own].astype(np.uint64))
        first = 0 if right is None else len(left)
        other = (rows >= first) & (places < 192)  # a name of 64 letters scores under 50 with longer ones
        self.kinds = np.zeros((len(left if right is None else right), 192), np.uint8)
        self.kinds[rows[other] - first, places[other]] = kinds[other]

    def lengths(self, i: np.ndarray, j: np.ndarray, longest: int) -> np.ndarray:
        """For left names i, of 64 letters at most, and right names j, of `longest` letters at most."""
        s = np.full(len(i), ~np.uint64(0))
        for at in range(longest):
            u = s & self.masks[i, self.kinds[j, at]]
            s = (s + u) | (s - u)
        return 64 - np.bitwise_count(s).astype(np.int64)


def _near_in_cell(left: list[str], right: list[str] | None, threshold: float, q: int) -> Iterator[tuple[str, str, float]]:
    """(lesser name, greater name, score) of the near pairs between two lists without a common name, or (right None) within one.

    Of t letters of two near names at most D = floor((1 - threshold / 100) x t)
    have no partner, so at least (t - D) / 2 letters of each have one. The letters
    without one leave their q-grams unshared and break (q - 1) more each.
    """
    within = right is None
    left = sorted(left, key=len)
    right = left if within else sorted(right, key=len)
    counts = _counts(left if within else left + right, q)
    x, y = counts[: len(left)], counts if within else counts[len(left) :]
    x_len, y_len = np.array([len(n) for n in left]), np.array([len(n) for n in right])
    total = np.arange(x_len[-1] + y_len[-1] + 1)
    common = (total - np.floor((1 - threshold / 100) * total + 1e-9).astype(np.int64) + 1) // 2
    shared = common if q == 1 else 3 * common + 1 - total
    subsequences = _Subsequences(left, None if within else right)
    low = 0
    while low < len(left):
        n = x_len[low]
        high = min(low + ROWS, int(np.searchsorted(x_len, n, "right")))  # rows of one length
        long = np.flatnonzero(common[n + y_len] <= np.minimum(n, y_len))
        if len(long):
            first, last = max(int(long[0]), low if within else 0), int(long[-1]) + 1
            i, j = np.nonzero(x[low:high] @ y[first:last].T >= shared[n + y_len[first:last]])
            i, j = i + low, j + first
            if within:
                i, j = i[i < j], j[i < j]
            if n <= 64 and len(i):
                enough = subsequences.lengths(i, j, int(y_len[last - 1])) >= common[n + y_len[j]]
                i, j = i[enough], j[enough]
            for a, b in zip(i.tolist(), j.tolist()):
                a, b = min(left[a], right[b]), max(left[a], right[b])
                score = indel_ratio(a, b)
                if score >= threshold:
                    yield a, b, score
        low = high


def _lists(rows: DataFrame, keys: list[str], threshold: float, q: int, fan: int) -> DataFrame:
    """(keys, gram, name): two near names with equal keys are in a list together; gram is empty where the block is one."""
    blocks = written(rows.groupBy(*keys).agg(F.count("*").alias("block_names")), "blocks")
    large = blocks.where(F.col("block_names") > 8 * fan)
    whole = rows.select(*keys, F.lit("").alias("gram"), "name")
    if not large.limit(1).count():
        return whole
    apart = 1 - threshold / 100
    lost = F.floor(F.lit(2 * apart * max(q / (1 + apart), (q - 1) / (1 - apart) if apart < 1 else 0) + 1e-9) * F.length("name"))
    grams = rows.join(large, keys, "left_semi").select(*keys, "name", F.explode(_grams("name", q)).alias("gram"))
    common = grams.groupBy(*keys, "gram").agg(F.count("*").alias("found"))
    rarest = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("found", "gram"))
    listed = grams.join(common, [*keys, "gram"]).withColumn("rank", rarest).where(F.col("rank") <= lost + 1).select(*keys, "gram", "name")
    listed = written(listed, "grams")
    found = listed.groupBy(*keys, "gram").agg(F.count("*").cast("double").alias("found")).groupBy(*keys).agg(F.sum(F.col("found") * F.col("found")).alias("pairs"))
    indexed = written(found.join(large, keys).where(F.col("pairs") < F.col("block_names").cast("double") * F.col("block_names")).select(*keys), "blocks")
    return listed.join(indexed, keys, "left_semi").unionByName(whole.join(indexed, keys, "left_anti"))


def near(names: DataFrame, keys: list[str], name: str, threshold: float, fan: int = FAN) -> DataFrame:
    """(keys, name_a, name_b, score) of the different names with the same keys whose score reaches the threshold, 50 to 100; name_a < name_b.

    Null and empty names are like nothing, and so are names with a null key.
    """
    if not 50 <= threshold <= 100:
        raise ValueError("threshold is between 50 and 100")
    q = 2 if 1 - threshold / 100 <= 0.25 else 1  # so that no name may lose all its q-grams
    rows = names.select(*keys, F.col(name).alias("name")).where("name <> ''").dropna(subset=keys).distinct()
    lists = _lists(rows, keys, threshold, q, fan)
    parts = lists.groupBy(*keys, "gram").agg(F.count("*").alias("found")).where("found > 1").select(*keys, "gram", F.ceil(F.col("found") / fan).cast("int").alias("parts"))
    placed = lists.join(parts, [*keys, "gram"]).withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = [*keys, "gram", "low", "high"]
    dealt = dealt.select(*keys, "gram", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "name")

    def compared(key: tuple, names: pd.DataFrame) -> pd.DataFrame:
        lower = names["part"] == key[-2]
        left, right = names["name"][lower].tolist(), None if key[-2] == key[-1] else names["name"][~lower].tolist()
        found = list(_near_in_cell(left, right, threshold, q)) if left and right != [] else []
        return pd.DataFrame([(*key[: len(keys)], *f) for f in found], columns=[*keys, "name_a", "name_b", "score"])

    schema = rows.select(*keys).schema.add("name_a", "string").add("name_b", "string").add("score", "double")
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # cells are few bytes and much work
    return dealt.repartition(tasks, *cell).groupBy(*cell).applyInPandas(compared, schema).distinct()


def classes(records: DataFrame, entity: str, name: str, keys: list[str]) -> DataFrame:
    """(entity, keys, name): records with a name, its words sorted; those with equal keys and names are a class."""
    return records.select(F.col(entity).alias("entity"), *keys, sorted_tokens(F.col(name)).alias("name")).where("name <> ''").distinct()


def links(members: DataFrame, keys: list[str], threshold: float, fan: int = FAN) -> DataFrame:
    """(keys, name_a, name_b, score): classes with near names, and each class of two records or more with itself, at 100."""
    own = members.groupBy(*keys, "name").agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(100.0).alias("score"))
    return near(members, keys, "name", threshold, fan).unionByName(own)


def partners(members: DataFrame, linked: DataFrame, keys: list[str], parted: DataFrame | None = None) -> DataFrame:
    """(entity, partners) of every record with one: records whose names are linked with its own, not of its group, and not parted from it.

    members: (entity, keys, name, grp), grp null outside of groups. parted: (a, b)
    pairs that aren't counted. Partners are counted by class and group; no pair of
    records is made but those parted.
    """
    both = linked.select(*keys, F.col("name_a").alias("name"), F.col("name_b").alias("other"))
    both = both.unionByName(both.select(*keys, F.col("other").alias("name"), F.col("name").alias("other"))).distinct()
    sizes = members.groupBy(*keys, F.col("name").alias("other"), "grp").agg(F.count("*").alias("n"))
    by_group = both.join(sizes, [*keys, "other"]).groupBy(*keys, "name", "grp").agg(F.sum("n").alias("n"), F.max(F.col("name") == F.col("other")).alias("self"))
    by_group = written(by_group, "partners")
    everyone = by_group.groupBy(*keys, "name").agg(F.sum("n").alias("all"))
    alike = both.where("name = other").select(*keys, "name", F.lit(1).alias("self"))
    out = members.join(everyone, [*keys, "name"]).join(alike, [*keys, "name"], "left")
    out = out.join(by_group.where("grp IS NOT NULL").select(*keys, "name", "grp", F.col("n").alias("same")), [*keys, "name", "grp"], "left")
    count = F.col("all") - F.when(F.col("grp").isNotNull(), F.coalesce("same", F.lit(0))).otherwise(F.coalesce("self", F.lit(0)))
    if parted is not None:
        ends = parted.select("a", "b").unionByName(parted.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        at = lambda end, p: members.select(F.col("entity").alias(end), *[F.col(k).alias(f"{p}_{k}") for k in [*keys, "name", "grp"]])
        ends = ends.join(at("a", "a"), "a").join(at("b", "b"), "b").where(~F.coalesce(F.col("a_grp") == F.col("b_grp"), F.lit(False)))
        on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys] + [F.col(f"a_{k}").eqNullSafe(F.col(k)) for k in keys] + [F.col("a_name") == F.col("name"), F.col("b_name") == F.col("other")]
        gone = ends.join(both, on).groupBy(F.col("a").alias("entity")).agg(F.count("*").alias("gone"))
        out = out.join(gone, "entity", "left")
        count = count - F.coalesce("gone", F.lit(0))
    return out.select("entity", count.cast("long").alias("partners")).where("partners > 0")
