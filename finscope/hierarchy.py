"""Depth of each node of a parent-pointer hierarchy, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.clean import is_blank
from finscope.scratch import written


def _jumped(chains: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, node, at, steps, done): where the chain of each node ends, and after how many steps.

    chains: (scope, node, at), one parent a node. In each round every pointer
    takes over the pointer of the node that it points to, so a chain of n nodes
    is done after log n rounds. What isn't done by then goes in a circle.
    """
    own = chains.select(*scope, F.col("node").alias("at"), F.lit(True).alias("_on"))
    state = chains.join(own, [*scope, "at"], "left").select(*scope, "node", "at", F.lit(1).cast("long").alias("steps"), F.col("_on").isNull().alias("done"))
    state = written(state, "pointers")
    for _ in range(chains.count().bit_length() + 1):
        if not state.where("NOT done").limit(1).count():
            break
        ahead = state.select(*scope, F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = state.where("NOT done").join(ahead, [*scope, "at"]).select(*scope, "node", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        state = written(state.where("done").unionByName(moved), "pointers")
    return state.where("done")


def with_depth(df: DataFrame, scope: list[str], node: str, parent: str) -> DataFrame:
    """df with `depth`: 1 for a root (blank parent), one more than the parent's below it.

    Where a node is listed more than once its least depth stands. Nodes whose
    chain ends nowhere or goes in a circle have depth 1. Nodes with one parent are
    done by pointer doubling, up to a root or a node with several parents; those
    nodes are then settled among themselves, in as many rounds as lie one above
    the other, so a plain chain of n nodes takes about log2 n rounds in all.
    """
    nodes = written(df.select(*scope, F.col(node).alias("node"), F.trim(parent).alias("at"), is_blank(F.trim(parent)).alias("root")).where("node IS NOT NULL").distinct(), "hierarchy")
    roots = nodes.where("root").select(*scope, "node").distinct()
    below = nodes.where("NOT root").join(roots, [*scope, "node"], "left_anti").select(*scope, "node", "at")
    parents = below.groupBy(*scope, "node").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    chains = written(parents.where("n = 1").select(*scope, "node", "at"), "chains")
    ends = _jumped(chains, scope)

    several = below.join(parents.where("n > 1").select(*scope, "node"), [*scope, "node"], "left_semi")
    known = roots.withColumn("depth", F.lit(1).cast("long"))
    if several.limit(1).count():
        ahead = ends.select(*scope, F.col("node").alias("at"), F.col("at").alias("_end"), "steps")
        known_chain = chains.select(*scope, F.col("node").alias("at"), F.lit(True).alias("_chain"))
        ways = several.join(known_chain, [*scope, "at"], "left").join(ahead, [*scope, "at"], "left")
        ways = ways.where("_chain IS NULL OR _end IS NOT NULL").select(*scope, "node", F.coalesce("_end", "at").alias("at"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
        ways = written(ways, "ways")
        known = known.withColumn("moved", F.lit(True))
        while known.where("moved").limit(1).count():
            at = known.select(*scope, F.col("node").alias("at"), "depth")
            found = ways.join(at, [*scope, "at"]).groupBy(*scope, "node").agg(F.min(F.col("depth") + F.col("steps")).alias("new"))
            both = known.drop("moved").join(found, [*scope, "node"], "full_outer")
            better = F.col("new").isNotNull() & (F.col("depth").isNull() | (F.col("new") < F.col("depth")))
            known = written(both.select(*scope, "node", F.least("depth", "new").alias("depth"), better.alias("moved")), "depths")
        known = known.drop("moved")
    at = known.select(*scope, F.col("node").alias("at"), "depth")
    chained = ends.join(at, [*scope, "at"]).select(*scope, "node", (F.col("depth") + F.col("steps")).alias("depth"))
    depths = known.unionByName(chained).select(*scope, F.col("node").alias(node), F.col("depth").cast("int").alias("depth"))
    joined = df.join(depths, [*scope, node], "left")
    return joined.select(*df.columns, F.coalesce("depth", F.lit(1)).alias("depth"))
