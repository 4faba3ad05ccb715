from pyspark.sql import functions as F

from finscope import house
from finscope.positions import aging


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def masters(spark):
    return rows(spark, "apar_id string, house string", (" 1", "HOC"), ("2", "HOL"), ("1", "HOL"), (None, "HOC"), ("9", None))


def by(df, key):
    return {r[key]: r["house"] for r in df.collect()}


def test_membership_prefers_the_first_house_and_keeps_every_row(spark):
    df = rows(spark, "id string, house string", ("1 ", "x"), ("2", None), ("3", "HOC"), (None, "HOC"), ("9", "x"), ("1 ", "x"))
    out = house.by_membership(df, "id", masters(spark))
    assert out.count() == 6 and out.columns == ["id", "house"]
    assert by(out, "id") == {"1 ": "HOC", "2": "HOL", "3": "Unknown", None: "Unknown", "9": "Unknown"}


def test_contracts_ask_commitments_only_without_a_house_of_their_own(spark):
    bought = rows(spark, "u4_contract_id string, house string", ("K1", "HOL"), ("K2", "Unknown"), ("", "HOC"), (None, "HOC"), ("K3", "Unknown"), ("K3", "HOC"))
    contracts = rows(spark, "n int, contract_ref string, organisation string", (1, "K1", " hoc "), (2, "K1", "Joint"), (3, "K1", None), (4, "K2", "Other"), (5, "", "Joint"), (6, None, "Joint"), (7, "K9", "Joint"), (8, "K3", ""))
    assert by(house.of_contracts(contracts, bought), "n") == {1: "HOC", 2: "HOL", 3: "HOL", 4: "Unknown", 5: "Unknown", 6: "Unknown", 7: "Unknown", 8: "HOC"}
    assert by(house.of_contracts(contracts, None), "n")[2] == "Unknown"
    assert by(house.of_spend(bought.select("u4_contract_id"), bought), "u4_contract_id") == {"K1": "HOL", "K2": "Unknown", "": "HOC", None: "Unknown", "K3": "HOC"}


def test_contract_refs_count_with_spend_only(spark):
    bought = rows(spark, "u4_contract_id string, house string, title string", ("K1", "HOC", "t"))
    values = rows(spark, "house string, dim_position string, dim_description string, dim_value string", ("HOL", " 5", "Contract Number ", "L1"), ("HOL", "5", "contract number", "L2"), ("HOL", "4", "contract number", "L3"), ("HOC", "5", "contract number", "L4"), ("HOL", "5", "cost", "L5"))
    spend = rows(spark, "u4_contract_id string, amount double", (" L1 ", 5.0), ("L1", -1.0), ("L2", 3.0), ("L2", -3.0))
    refs = lambda *a: sorted((r["u4_contract_id"], r["source"]) for r in house.contract_refs(bought, *a).collect())
    assert refs(values, spend) == [("K1", "unit4_commitments"), ("L1", "gl_dimension_values")]
    assert [r[0] for r in refs(values, None)] == [r[0] for r in refs(values, spend.limit(0))] == ["K1", "L1", "L2"]
    assert [r[0] for r in refs(None, spend)] == ["K1"]


def test_scope_existence_and_open_contracts(spark):
    df = rows(spark, "house string, client string, asset_id string", ("HOC", "CA ", " 1"), ("HOC", "CM", "2"), ("HOL", "LA", "3"), ("HOL", None, "4"), ("RM", "ZZ", "5"))
    assert sorted(r["asset_id"] for r in house.in_client_scope(df, {"HOC": ["CA"], "HOL": ["LA"]}, ["asset_id"]).collect()) == ["1", "3", "5"]
    found = house.existence(df.withColumn("asset_id", F.when(F.col("asset_id") != "3", F.col("asset_id"))), "asset_id")
    assert {(r["house"], r["derived_house"]) for r in found.collect()} == {("Unknown", "HOC"), ("Unknown", "HOL"), ("Unknown", "RM")} and found.count() == 4
    listed = rows(spark, "u4_contract_id string", ("3 ",), ("3",), (None,))
    assert house.open_only(df, "asset_id", listed).count() == 1 and house.open_only(df, "asset_id", None).count() == 5


def test_budget_labels_are_taken_as_written(spark):
    assert by(house.of_budgets(rows(spark, "recharge string", (" HOL ",), ("hoc",), (None,), ("HOC",))), "recharge") == {" HOL ": "HOL", "hoc": "Unknown", None: "Unknown", "HOC": "HOC"}


def test_open_figures_of_a_house_without_open_items(spark):
    items = rows(spark, "house string, status string, rest_amount double, due_date string, trans_date string", ("HOC", "C", 5.0, "2001-01-01", "2001-01-01"), ("HOL", "N", None, None, "2001-12-30"), ("HOL", "H", 4.0, "2001-12-01", None))
    items = items.withColumns({c: F.col(c).cast("date") for c in ("due_date", "trans_date")})
    out = {r["house"]: r for r in aging.open_figures(items, aging.OPEN_AR, "2001-12-31", "ar").collect()}
    assert (out["HOC"]["ar_open"], out["HOC"]["ar_balance"], out["HOC"]["ar_mean_age"]) == (0, 0, None)
    assert (out["HOL"]["ar_open"], out["HOL"]["ar_balance"], out["HOL"]["ar_overdue"], out["HOL"]["ar_mean_age"]) == (2, 4, 1, 1.0)
