"""Which house a row belongs to, where its extract isn't split by house.

An id that leads to no house makes the row 'Unknown', which checks report. A null
id never matches. Where an id has several houses, HOC goes before HOL, and HOL
before Unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finscope.clean import is_blank

UNKNOWN = "Unknown"
HOUSES = ("HOC", "HOL")
#: Position and name of the ledger dimension that holds contract numbers.
CONTRACT_POSITION, CONTRACT_NAME = "5", "contract number"


def stated(c: Column) -> Column:
    """HOC or HOL where the text is just that, else Unknown."""
    return F.when(F.trim(c).isin(*HOUSES), F.trim(c)).otherwise(UNKNOWN)


def _first_house(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """One row a key with its house as `_house`; the three names sort in the order of preference."""
    return rows.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.min("house").alias("_house"))


def _replaced(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("house", F.coalesce(value, F.lit(UNKNOWN))).select(*[c for c in df.columns if c not in ("house", "_key", "_house")], "house")


def by_membership(df: DataFrame, id: str, master: DataFrame) -> DataFrame:
    """df with the house in whose master its id is, spaces around either aside."""
    known = _first_house(master.where(F.col("house").isin(*HOUSES)), F.trim("apar_id"), "_key")
    return _replaced(df.withColumn("_key", F.trim(id)).join(known, "_key", "left"), F.col("_house"))


def of_contracts(contracts: DataFrame, commitments: DataFrame | None) -> DataFrame:
    """A contract's own organisation if that is a house, else the house of the commitment with its reference.

    Blank references match nothing; commitments already have their house.
    """
    own = stated(F.upper("organisation"))
    if commitments is None:
        return _replaced(contracts, own)
    known = _first_house(commitments.where(~is_blank(F.col("u4_contract_id"))), F.col("u4_contract_id"), "_key")
    asks = (own == UNKNOWN) & ~is_blank(F.col("contract_ref"))
    rows = contracts.withColumn("_key", F.when(asks, F.col("contract_ref"))).join(known, "_key", "left")
    return _replaced(rows, F.when(own == UNKNOWN, F.col("_house")).otherwise(own))


def of_spend(spend: DataFrame, commitments: DataFrame | None) -> DataFrame:
    """Spend with the house of the commitment of the same id."""
    if commitments is None:
        return _replaced(spend, F.lit(UNKNOWN))
    known = _first_house(commitments, F.col("u4_contract_id"), "_key")
    return _replaced(spend.withColumn("_key", F.col("u4_contract_id")).join(known, "_key", "left"), F.col("_house"))


def of_budgets(lines: DataFrame) -> DataFrame:
    return lines.withColumn("house", stated(F.col("recharge")))


def contract_refs(commitments: DataFrame, values: DataFrame | None, spend: DataFrame | None) -> DataFrame:
    """Commitments, and HOL's contract numbers among the dimension values, each with its source.

    A contract number counts only if its spend adds up to more than zero; without
    a spend table, or with one that has no rows, all of them count.
    """
    out = commitments.withColumn("source", F.lit("unit4_commitments"))
    if values is None:
        return out
    named = (F.col("house") == "HOL") & (F.trim("dim_position") == CONTRACT_POSITION) & (F.lower(F.trim("dim_description")) == CONTRACT_NAME)
    refs = values.where(named).select("house", F.col("dim_value").alias("u4_contract_id"), F.lit("gl_dimension_values").alias("source"))
    if spend is not None and not spend.isEmpty():
        spent = spend.where(~is_blank(F.col("u4_contract_id"))).groupBy(F.trim("u4_contract_id").alias("_key")).agg(F.sum("amount").alias("_spent")).where("_spent > 0")
        refs = refs.withColumn("_key", F.trim("u4_contract_id")).join(spent, "_key", "left_semi").drop("_key")
    return out.unionByName(refs, allowMissingColumns=True)


def existence(df: DataFrame, id: str) -> DataFrame:
    """The rows with an id, reported once and under Unknown; their own house is `derived_house`, what the checks look at."""
    return df.where(~is_blank(F.col(id))).withColumn("derived_house", F.col("house")).withColumn("house", F.lit(UNKNOWN))


def in_client_scope(df: DataFrame, scope: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Rows of a house in `scope` only with one of its clients; the join keys lose the spaces around them."""
    keep = F.lit(True)
    for name, clients in scope.items():
        keep = keep & (~F.col("house").eqNullSafe(name) | F.coalesce(F.trim("client").isin(*clients), F.lit(False)))
    return df.where(keep).withColumns({k: F.trim(k) for k in keys if k in df.columns})


def open_only(df: DataFrame, ref: str, open_contracts: DataFrame | None) -> DataFrame:
    """Rows whose reference is an open contract's; all rows without the list of them."""
    if open_contracts is None:
        return df
    known = open_contracts.select(F.trim("u4_contract_id").alias("_key")).distinct()
    return df.withColumn("_key", F.trim(ref)).join(known, "_key", "left_semi").drop("_key")
