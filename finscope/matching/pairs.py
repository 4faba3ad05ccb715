"""Records that share a key, and how alike two names are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finscope.matching.components import connected_components

KEYS = ("key_bank", "key_vat", "key_company", "key_name")


def key_edges(records: DataFrame, entity: str, within: list[str], keys=KEYS) -> DataFrame:
    """(a, b, key): each record joined to the least record with the same key, which links what all pairs would.

    Groups are aggregated first and joined back by their key: no pairs are made
    within a group, however large.
    """
    parts = []
    for key in keys:
        own = records.where(F.col(key).isNotNull()).select(entity, *within, F.col(key).alias("value"))
        least = own.groupBy(*within, "value").agg(F.min(entity).alias("a"), F.max(entity).alias("last")).where("a < last").drop("last")
        parts.append(own.join(least, [*within, "value"]).where(F.col(entity) > F.col("a")).select("a", F.col(entity).alias("b"), F.lit(key).alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def groups(records: DataFrame, entity: str, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(entity, root) of records in groups of two or more; stewards' links are added first."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if links is not None:
        pairs = pairs.unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    return connected_components(pairs).select(F.col("node").alias(entity), "root")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " +"), lambda w: w != "")), " ")


def indel_ratio(a: str, b: str) -> float:
    """100 x 2 x longest common subsequence / total length, with the subsequence found bit-parallel."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def similarity(a: str, b: str) -> Column:
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(s or "", t or "") for s, t in zip(x, y)])

    return F.pandas_udf(ratios, "double")(a, b)
