"""Merkle manifest of a table: a leaf for each row, a tree for each source, and a tree over the sources.

The leaves of a source ascend by id. Every `FAN` consecutive nodes become the
hash of their digests, level by level, until one is left: the source's root. The
roots by source, null first, become the table's root alike.

A parent keeps a copy of its hash state before each child. To fold a changed
leaf, the state before it is resumed with the replacement and the siblings to
the right only, then the same in the parent above.

In Spark: rows become digests first, and no text is shuffled. A range sort and
the counts of its parts give every leaf its place in its source. Subtrees of
FAN ** LEVELS leaves are built by one task each, their roots are nodes of the
next tier, and so on; a source that holds most rows is many subtrees. What lies
above a subtree is one row for it (siblings to the left and right, by level), so
leaves are folded to the root where their subtree is, and states above it are
made once for all its leaves. One task works the table of sources where their
order is found (a row each).

Defined cases: a null field has a mark of its own (so null and empty texts
differ); equal ids are ordered by their leaves, and equal leaves give equal
digests whichever comes first; an empty table has an empty manifest; other
columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscope.llm.shared import written

#: Children of a parent: fixed by the contract. Levels of a subtree, which one task builds.
FAN, LEVELS = 3, 6
SPAN = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before: string, after: string>>"
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(fields: list[Column]) -> Column:
    """Hash of a row: of every field its length in bytes, a colon and its value, or - for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


class Parent:
    """A node over its children's digests, with the hash state before each."""

    def __init__(self, children: list[str]) -> None:
        self.children, self.states, state = children, [], sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def replaced(self, slot: int, child: str) -> str:
        """Its digest with another child there: the state before it goes on with that one and those to the right."""
        state = self.states[slot].copy()
        state.update((child + "".join(self.children[slot + 1 :])).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> tuple[str, str]:
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])


def subtree(leaves: list[str], levels: int) -> list[list[Parent]]:
    """Parents by level over the leaves."""
    out, nodes = [], leaves
    for _ in range(levels):
        out.append([Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in out[-1]]
    return out


def height(n: int) -> int:
    """Levels of a subtree in a tier of n nodes: until one is left, LEVELS at most."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _roots(nodes: DataFrame) -> DataFrame:
    """The next tier: (tree, place, n, node) of the subtrees of (tree, place, n, node); n is how many nodes a tree has there."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n, node = table["n"][0].as_py(), table["node"].to_pylist()
        tops = subtree(node, height(n))
        top = tops[-1][0].digest if tops else node[0]
        return pa.table({"tree": [table["tree"][0].as_py()], "place": [table["place"][0].as_py() // SPAN], "n": [-(-n // SPAN)], "node": [top]})

    return nodes.select("tree", "place", "n", "node").groupBy("tree", F.expr(f"place div {SPAN}")).applyInArrow(work, "tree string, place long, n long, node string")


def _own_paths(nodes: DataFrame) -> DataFrame:
    """(tree, place, path): the siblings of each node, level by level, in its subtree."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        parents, paths = subtree(table["node"].to_pylist(), height(table["n"][0].as_py())), []
        for i in range(len(table)):
            path, at = [], i
            for level in parents:
                before, after = level[at // FAN].siblings(at % FAN)
                path.append({"before": before, "after": after})
                at //= FAN
            paths.append(path)
        return table.select(["tree", "place"]).append_column("path", pa.array(paths, _STEPS))

    return nodes.select("tree", "place", "n", "node").groupBy("tree", F.expr(f"place div {SPAN}")).applyInArrow(work, f"tree string, place long, path {_STEP}")


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tree, node): the root of each tree; (tree, place, path): what lies beside the way from each node to it)."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n")).first()[0] or 1) > 1:
        tiers.append(written(_roots(tiers[-1]), "nodes"))
    tops = tiers[-1].select("tree", "node")
    paths = tiers[-1].select("tree", "place", F.array().cast(_STEP).alias("path"))
    for tier in reversed(tiers[:-1]):
        above = paths.select("tree", F.col("place").alias("up"), F.col("path").alias("rest"))
        own = _own_paths(tier).withColumn("up", F.expr(f"place div {SPAN}"))
        paths = own.join(above, ["tree", "up"]).select("tree", "place", F.concat("path", "rest").alias("path"))
    return tops, paths


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (tree, doc_id, leaf, ...) with place, from 0 in its tree by id (null first), and n, the tree's leaves."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    parts = written(leaves.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "sorted")
    counts = parts.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    counts = counts.select("tree", "part", (F.sum("rows").over(tree.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(tree).alias("n"))
    own = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    return parts.withColumn("own", own).join(counts, ["tree", "part"]).withColumn("place", F.col("before") + F.col("own") - 1).drop("own", "before", "part")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields=FIELDS, proofs: bool = False) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    changed: columns as they are found now, where they may differ from what the
    manifest was made of; folded_root is the root by the leaf of what is found
    and the siblings of the manifest, and verified whether it is the root. With
    proofs, `proof` has the siblings to the left and right, level by level.
    """
    now = changed or {}
    leaf = digest([F.col(c) for c in fields])
    touched = F.lit(False)
    for c, value in now.items():
        touched = touched | ~value.eqNullSafe(F.col(c))
    found = F.when(touched, digest([now.get(c, F.col(c)) for c in fields])).otherwise(F.col("leaf")) if now else F.col("leaf")
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    rows = docs.select("doc_id", "source", *[c for c in fields if c not in ("doc_id", "source")], leaf.alias("leaf")).select("doc_id", "source", "leaf", found.alias("found"), tree.alias("tree"))
    leaves = written(placed(written(rows, "leaves")), "leaves")

    subtrees = written(_roots(leaves.withColumnRenamed("leaf", "node")), "nodes")
    tops, paths = climbed(subtrees)
    by_source = Window.orderBy("tree")  # a row for each source
    sources = tops.select(F.lit("").alias("tree"), (F.row_number().over(by_source) - 1).cast("long").alias("place"), F.col("node"), F.col("tree").alias("of"))
    sources = sources.withColumn("n", F.count("*").over(Window.partitionBy("tree")))
    sources = written(sources, "sources")
    root, upper = climbed(sources)
    upper = sources.join(upper, ["tree", "place"]).join(root.withColumnRenamed("node", "root"), "tree").select(F.col("of").alias("tree"), F.col("node").alias("subroot"), "root", F.col("path").alias("rest"))
    above = paths.join(upper, "tree").select("tree", "place", F.concat("path", "rest").alias("path"), "subroot", "root")

    fields_out = "doc_id {}, source {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean".format(*[docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")])

    def fold(table: pa.Table, way: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        parents = subtree(table["leaf"].to_pylist(), height(table["n"][0].as_py()))
        way = way.to_pylist()[0]
        states = [(sha256(step["before"].encode()), step["after"]) for step in way["path"]]  # above the subtree: the state before this child
        beyond = "".join(step["before"] + step["after"] for step in way["path"])
        folded, hashes, ways = [], [], []
        for i, value in enumerate(table["found"].to_pylist()):
            at, steps = i, []
            for level in parents:
                parent, slot = level[at // FAN], at % FAN
                steps.append(parent.siblings(slot))
                value = parent.replaced(slot, value)
                at //= FAN
            for before, after in states:
                state = before.copy()
                state.update((value + after).encode())
                value = state.hexdigest()
            folded.append(value)
            hashes.append(sha256(("".join(b + a for b, a in steps) + beyond).encode()).hexdigest())
            if proofs:
                ways.append([{"before": b, "after": a} for b, a in steps] + way["path"])
        out = {c: table[c] for c in ("doc_id", "source", "leaf")} | {"subroot": [way["subroot"]] * len(table), "root": [way["root"]] * len(table), "proof_sha256": hashes, "folded_root": folded, "verified": [f == way["root"] for f in folded]}
        return pa.table(out | ({"proof": pa.array(ways, _STEPS)} if proofs else {}))

    group = F.expr(f"place div {SPAN}")
    return leaves.groupBy("tree", group).cogroup(above.groupBy("tree", "place")).applyInArrow(fold, fields_out + (f", proof {_STEP}" if proofs else ""))


def folded(leaf: str, proof: list) -> str:
    """The root by a leaf and its proof, [(before, after)] level by level."""
    for before, after in proof:
        leaf = sha256((before + leaf + after).encode()).hexdigest()
    return leaf
