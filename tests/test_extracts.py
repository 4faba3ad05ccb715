"""The project extract and profiles of whole tables."""

import random
from collections import Counter

from finscope import extracts
from finscope.positions import project_extract


def frames(spark):
    listed = [("U1", "One", "U1-a", "A", "F-MAJP", "P1", "N"), ("U1", "One", "U1-b", "B", "F-MAJP", "P1", "N"), ("U1", "One", "U1-c", "C", "F-ANRP", "P2", "N"), ("U2", "Two", "U2-a", "D", "F-ANRP", "P2", "C"), (None, None, "X-1", "E", None, None, "N")]
    listed = spark.createDataFrame([(*r, "PD", "CC", "D1", "DEP") for r in listed], "unit string, unit_desc string, hais_code string, hais_desc string, projcat string, projgrp string, status string, projgrp_desc string, costc string, directorate string, department string")
    fin = [("HOC", "U1-a", 2024, 202401, "Costs", 10, 20, 5), ("HOL", "U1-a", 2024, 202412, "Costs", 1, 0, 0), ("HOC", "U1-b", 2020, 202004, "Income", -3, 0, 0), ("HOC", "U2-a", 2024, 202406, "Costs", 7, 7, 0), ("HOC", "off", 2024, 202406, "Costs", 100, 0, 0)]
    fin = spark.createDataFrame([(*r, "U9", "CC", "D1", "DEP") for r in fin], "house string, hais_code string, fiscal_year int, period int, mipck_l1_desc string, actuals int, budget int, committed int, unit string, costc string, directorate string, department string")
    return listed, fin


def test_project_extract(spark):
    out = project_extract.extract(*frames(spark))
    header = {r["unit"]: r for r in out["header"].collect()}
    assert (header["U1"]["hais_listed"], header["U1"]["active_lines"], header["U1"]["houses"], header["U1"]["projcat"], header["U1"]["project_type"], header["U1"]["signal"], header["U1"]["project_manager"]) == (3, 2, "Shared", "F-MAJP", "CAT A", "Live", "")
    tasks = {r["hais_code"]: (r["houses"], r["first_period"], r["last_period"], r["signal"]) for r in out["tasks"].collect()}
    assert tasks == {"U1-a": ("Shared", 202401, 202412, "Live"), "U1-b": ("HOC", 202004, 202004, "Dormant"), "U1-c": ("—", None, None, "No activity"), "U2-a": ("HOC", 202406, 202406, "Live"), "X-1": ("—", None, None, "No activity")}
    told = {r["check"]: r["value"] for r in out["reconciliation"].collect()}
    assert told == {
        "listed codes": 5, "codes in the financials": 4, "listed codes with activity": 3, "listed codes without activity": 2, "codes off the list": 1, "actuals on listed codes": 15, "spend to date": 15, "open commitments": 5, "budget to date": 27,
        "tasks and positions apart": 0, "history and positions apart": 0, "positions without a project": 0, "task positions without a task": 0, "tasks without a project": 1,
    }
    assert {(r["unit"], r["house"], r["fiscal_year"]): r["remaining_budget"] for r in out["annual_history"].collect()}[("U1", "HOC", 2024)] == 13


def test_project_extract_filters(spark):
    out = project_extract.extract(*frames(spark), expenditure_only=True, include_annual=False)
    assert {r["unit"]: (r["hais_listed"], r["active_lines"]) for r in out["header"].collect()} == {"U1": (2, 1)}
    assert {(r["unit"], r["house"]): r["spend_to_date"] for r in out["opening_position"].collect()} == {("U1", "HOC"): 10, ("U1", "HOL"): 1}


def test_profiles_of_all_columns(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", " ", None, "c"]), rng.choice([None, -1, 0, 5]), rng.choice(["1.5", "x", ""])) for _ in range(500)]
    counts = extracts.counted(spark.createDataFrame(rows, "t string, n int, m string"), ["t", "n", "m"])
    got = {r["column"]: r for r in extracts.profile_columns(counts).collect()}
    n = [r[1] for r in rows if r[1] is not None]
    assert (got["n"]["rows"], got["n"]["filled"], got["n"]["distinct_values"], got["n"]["negative"], got["n"]["zero"], got["n"]["positive"], got["n"]["total"]) == (500, len(n), 3, n.count(-1), n.count(0), n.count(5), sum(n))
    t = Counter(r[0] if r[0] and r[0].strip() else None for r in rows)
    assert got["t"]["filled"] == 500 - t[None] and got["t"]["distinct_values"] == 3 and got["m"]["positive"] == sum(r[2] == "1.5" for r in rows) and got["t"]["least"] is None
    top = {(r["column"], r["rank"]): (r["value"], r["n"]) for r in extracts.top_values(counts, 2).collect()}
    assert top["t", 1] == ("a", t["a"]) and ("t", 3) not in top
    assert extracts.profile_columns(extracts.counted(spark.createDataFrame([], "t string"), ["t"])).count() == 0
