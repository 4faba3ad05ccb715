"""Checks as SQL predicates over a table, and the scan that runs all checks of a table at once.

A predicate may use values found elsewhere: `repeated` (does this key occur more
than once in the population?) and `found` (an aggregate over another table's rows
with equal keys). Each is made once for a table, however many checks use it, by
an aggregation of the keys followed by a join with one row a key, so a key that
a third of all rows share is aggregated before it is shuffled. Then one
aggregation by house counts every check.

Null rules: a predicate that is null counts as passed; null keys of `repeated`
equal each other; null keys of `found` match nothing.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.scratch import written

#: Error rates (percent) up to which a check is green, and amber, by severity.
RAG = {"Critical": (1, 5), "High": (3, 10), "Medium": (5, 15), "Low": (10, 25)}
RESULT_COLUMNS = ["check_id", "domain", "object", "dimension", "severity", "house", "total", "failing", "passing", "error_rate", "pass_rate", "rag"]


@dataclass(frozen=True)
class Check:
    """population and fails: SQL over the table's row; :as_of stands for the day the data is judged on."""

    id: str
    domain: str
    object: str
    dimension: str
    severity: str
    table: str
    fails: str
    population: str = "true"
    title: str = ""


@dataclass(frozen=True)
class Ref:
    kind: str
    keys: tuple
    table: str = ""
    value: str = "count(*)"
    where: str = "true"
    missing: str = "NULL"


_REFS: dict[str, Ref] = {}
_NAME = re.compile(r"ref_[0-9a-f]{10}")


def _named(ref: Ref) -> str:
    name = "ref_" + hashlib.md5(repr(ref).encode()).hexdigest()[:10]
    _REFS[name] = ref
    return name


def repeated(*keys: str, where: str = "true") -> str:
    """True where more than one row of the house that meets `where` has these keys; write the population into `where`."""
    return f"({where} AND coalesce({_named(Ref('repeated', keys, where=where))}, false))"


def found(table: str, value: str = "count(*)", where: str = "true", if_missing: str = "NULL", **keys: str) -> str:
    """An aggregate of `table`'s rows that meet `where` and whose column equals this row's expression, for each column=expression.

    if_missing: what it is for every row where the table isn't loaded.
    """
    return _named(Ref("found", tuple(sorted(keys.items())), table, value, where, if_missing))


def exists(table: str, where: str = "true", **keys: str) -> str:
    return f"(coalesce({found(table, where=where, **keys)}, 0) > 0)"


# Pieces of predicates; all are never null.


def blank(c: str) -> str:
    return f"(coalesce(trim({c}), '') IN ('', 'nan', 'None'))"


def null(c: str) -> str:
    return f"({c} IS NULL)"


def eq(c: str, value: str) -> str:
    return f"({c} IS NOT DISTINCT FROM '{value}')"


def among(c: str, *values: str) -> str:
    return "coalesce({} IN ({}), false)".format(c, ", ".join(f"'{v}'" for v in values))


def starts(c: str, *prefixes: str) -> str:
    return "(" + " OR ".join(f"coalesce(left(trim({c}), {len(p)}) = '{p}', false)" for p in prefixes) + ")"


def like(c: str, pattern: str) -> str:
    """The whole text matches; patterns hold no backslash."""
    return f"coalesce(regexp_like({c}, '^({pattern})$'), false)"


def true(condition: str) -> str:
    return f"coalesce({condition}, false)"


def used(sql: str) -> list[str]:
    return sorted(set(_NAME.findall(sql)))


def dated(sql: str, as_of: str) -> str:
    return sql.replace(":as_of", f"DATE '{as_of}'")


def needs(checks: list[Check]) -> set[str]:
    """Tables that the checks read besides their own."""
    seen, todo = set(), [n for c in checks for n in used(c.fails + c.population)]
    while todo:
        ref = _REFS[todo.pop()]
        if ref.table:
            seen.add(ref.table)
        todo += used(ref.where + " ".join(k if isinstance(k, str) else k[1] for k in ref.keys))
    return seen


#: Aggregates that are null for no row and can be taken over the rows that meet a condition.
_SIMPLE = re.compile(r"(min|max|sum|bool_or|bool_and)\([^()]*(\([^()]*\)[^()]*)*\)")


def _measure(ref: Ref, as_of: str) -> str:
    where = dated(ref.where, as_of)
    own = dated(ref.value, as_of) if where == "true" else f"{dated(ref.value, as_of)} FILTER (WHERE {where})"
    return f"nullif({own}, 0)" if ref.value == "count(*)" else own


def _lookups(refs: dict[str, Ref]) -> list[dict[str, Ref]]:
    """References by table and keys: those that one aggregation can make together."""
    groups: dict[tuple, dict[str, Ref]] = {}
    for name, ref in refs.items():
        together = ref.value == "count(*)" or _SIMPLE.fullmatch(ref.value)
        groups.setdefault((ref.table, ref.keys) if together else (name,), {})[name] = ref
    return list(groups.values())


def _with_found(df: DataFrame, frames: dict[str, DataFrame], refs: dict[str, Ref], as_of: str) -> DataFrame:
    for group in _lookups(refs):
        first = next(iter(group.values()))
        source = frames.get(first.table)
        if source is None:
            for name, ref in group.items():
                df = df.withColumn(name, F.expr(f"cast({ref.missing} AS {'bigint' if ref.value == 'count(*)' else 'string'})"))
            continue
        if len(group) == 1 and first.value != "count(*)" and not _SIMPLE.fullmatch(first.value):
            source, measures = source.where(dated(first.where, as_of)), {name: dated(ref.value, as_of) for name, ref in group.items()}
        else:
            if all(ref.where == first.where for ref in group.values()):
                source, group = source.where(dated(first.where, as_of)), {n: replace(ref, where="true") for n, ref in group.items()}
            measures = {name: _measure(ref, as_of) for name, ref in group.items()}
        keys = [F.expr(c).alias(f"_k{i}") for i, (c, _) in enumerate(first.keys)]
        other = source.groupBy(*keys).agg(*[F.expr(m).alias(name) for name, m in measures.items()])
        on = [F.expr(dated(e, as_of)) == F.col(f"_k{i}") for i, (_, e) in enumerate(first.keys)]
        df = df.join(other, on, "left").drop(*[f"_k{i}" for i in range(len(on))])
    return df


def _key(ref: Ref, as_of: str):
    """The values of a reference's keys as one text, null and empty apart."""
    return F.to_json(F.array(*[F.expr(dated(k, as_of)).cast("string") for k in ("house", *ref.keys)]))


def _with_repeated(df: DataFrame, refs: dict[str, Ref], as_of: str, source: DataFrame) -> DataFrame:
    """All repeated keys are counted in one pass over `source`, df's rows with what keys and conditions use: a row gives one for each reference whose condition it meets."""
    cells = [F.when(F.coalesce(F.expr(dated(ref.where, as_of)), F.lit(False)), F.struct(F.lit(i).alias("ref"), _key(ref, as_of).alias("key"))) for i, ref in enumerate(refs.values())]
    every = source.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).select("cell.*")
    many = every.groupBy("ref", "key").agg(F.count("*").alias("n")).where("n > 1")
    if len(refs) > 1:
        many = written(many, "repeated")
    for i, (name, ref) in enumerate(refs.items()):
        own = many.where(F.col("ref") == i).select(F.col("key").alias("_key"), F.lit(True).alias(name))
        df = df.join(own, _key(ref, as_of) == F.col("_key"), "left").drop("_key")
    return df


def with_refs(df: DataFrame, frames: dict[str, DataFrame], sql: str, as_of: str) -> DataFrame:
    """df with a column for each value from elsewhere that `sql` uses."""
    refs = {name: _REFS[name] for name in used(sql) if name not in df.columns}
    repeats = {n: r for n, r in refs.items() if r.kind == "repeated"}
    lookups = {n: r for n, r in refs.items() if r.kind == "found"}
    inner = [n for r in repeats.values() for n in used(" ".join([r.where, *r.keys]))]  # what repeated keys and their conditions use in turn
    plain = df  # without values from elsewhere, which keys then don't need either
    lookups |= {n: _REFS[n] for n in inner if _REFS[n].kind == "found" and n not in df.columns}
    df = _with_found(df, frames, lookups, as_of)
    nested = {n: _REFS[n] for n in inner if _REFS[n].kind == "repeated" and n not in df.columns}
    if nested:
        df = with_refs(df, frames, " ".join(nested), as_of)
    repeats = {n: r for n, r in repeats.items() if n not in df.columns}
    return _with_repeated(df, repeats, as_of, df if inner else plain) if repeats else df


def annotated(frames: dict[str, DataFrame], table: str, checks: list[Check], as_of: str) -> DataFrame:
    """The table with p_<i> and f_<i> for check i: in its population? failing?"""
    df = with_refs(frames[table], frames, " ".join(c.fails + " " + c.population for c in checks), as_of)
    flags = {}
    for i, c in enumerate(checks):
        flags[f"p_{i}"] = F.coalesce(F.expr(dated(c.population, as_of)), F.lit(False))
        flags[f"f_{i}"] = F.coalesce(F.expr(dated(f"({c.population}) AND ({c.fails})", as_of)), F.lit(False))
    return df.withColumns(flags)


def rated(counts: DataFrame) -> DataFrame:
    """error_rate, pass_rate (percent, one decimal) and rag for rows with severity, total and failing."""
    error = F.bround(F.col("failing") * 100.0 / F.col("total"), 1)
    green, amber = (F.create_map(*[F.lit(x) for s, t in RAG.items() for x in (s, t[i])])[F.col("severity")] for i in (0, 1))
    out = counts.withColumn("passing", F.col("total") - F.col("failing")).withColumn("error_rate", F.when(F.col("total") > 0, error).otherwise(0.0))
    out = out.withColumn("pass_rate", F.bround(100.0 - F.col("error_rate"), 1))
    return out.withColumn("rag", F.when(F.col("error_rate") <= green, "Green").when(F.col("error_rate") <= amber, "Amber").otherwise("Red"))


def run_checks(frames: dict[str, DataFrame], checks: list[Check], as_of: str) -> DataFrame:
    """One row for each check and house with a population; each table is scanned once. Checks on missing tables are left out."""
    parts = []
    for table in dict.fromkeys(c.table for c in checks):
        own = [c for c in checks if c.table == table]
        if table not in frames:
            continue
        flagged = annotated(frames, table, own, as_of)
        sums = [F.count_if(f"{k}_{i}").alias(f"{k}_{i}") for i in range(len(own)) for k in "pf"]
        counts = flagged.groupBy("house").agg(*sums)
        rows = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in (("check_id", c.id), ("domain", c.domain), ("object", c.object), ("dimension", c.dimension), ("severity", c.severity))], F.col(f"p_{i}").alias("total"), F.col(f"f_{i}").alias("failing")) for i, c in enumerate(own)]))
        parts.append(counts.select("house", rows.alias("r")).select("house", "r.*").where("total > 0"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rated(out).select(*RESULT_COLUMNS)


def failing_rows(frames: dict[str, DataFrame], check: Check, as_of: str) -> DataFrame:
    """The rows of the check's population that fail it, with the columns of its table."""
    df = annotated(frames, check.table, [check], as_of)
    return df.where("f_0").select(*frames[check.table].columns)


def enrich(failing: DataFrame, reference: DataFrame, on: dict[str, str], prefix: str, order: list[str] | None = None) -> DataFrame:
    """Failing rows with the first reference row of their key, in the given order (all its columns if none), its columns prefixed."""
    columns = reference.columns
    rank = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order or columns)]
    first = reference.groupBy(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())]).agg(F.min(F.struct(*rank, *columns)).alias("_r"))
    joined = failing.join(first, [F.col(left) == F.col(f"_k{i}") for i, left in enumerate(on)], "left")
    return joined.select(*failing.columns, *[F.col(f"_r.{c}").alias(f"{prefix}{c}") for c in columns])
