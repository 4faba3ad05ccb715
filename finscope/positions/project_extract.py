"""The project extract: five tables made of one scan of the financials, and the checks between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.clean import is_blank, period_index
from finscope.positions import projects
from finscope.scratch import written

#: Months back from the latest period in which activity makes a project live.
LIVE_MONTHS = 12
#: What kind of project a category is.
PROJECT_TYPES = {"F-MAJP": "CAT A", "F-MINP": "CAT B", "F-MNSP": "Other (CAT C?)", "F-ANRP": "Annual Requirements"}
ANNUAL = "Annual Requirements"


def project_type(projcat):
    out = F.lit("Unclassified")
    for category, name in PROJECT_TYPES.items():
        out = F.when(projcat == category, F.lit(name)).otherwise(out)
    return out


def signal(last, latest):
    """Live, Dormant or No activity, by the last active period."""
    return F.when(last.isNull(), "No activity").when(period_index(latest) - period_index(last) <= LIVE_MONTHS, "Live").otherwise("Dormant")


def _of_houses(summary: DataFrame, key: str) -> DataFrame:
    """Activity of each value of key: first and last period, houses, and how many codes have any."""
    active = summary.where("first_active IS NOT NULL")
    out = active.groupBy(key).agg(F.min("first_active").alias("first_period"), F.max("last_active").alias("last_period"), F.array_sort(F.collect_set("house")).alias("_h"), F.count_distinct("hais_code").alias("active_lines"))
    return out.withColumn("houses", F.when(F.size("_h") == 1, F.col("_h")[0]).otherwise("Shared")).drop("_h")


def extract(listed: DataFrame, financials: DataFrame, expenditure_only: bool = False, include_annual: bool = True) -> dict[str, DataFrame]:
    """header, tasks, opening_position, task_position, annual_history and reconciliation.

    The financials are read and summed once, by code, house and year; all tables
    are made of that and the list. A task is a listed code, of several listings
    the least one; a project a listed unit, with its most common classes. Without
    include_annual the listings of annual requirements and what is posted to them
    are left out, without expenditure_only income counts too.
    """
    if not include_annual:
        listed = listed.where(project_type(F.col("projcat")) != ANNUAL)
    rows = projects.lines(listed, financials)
    everything = written(projects.summarise(rows), "project-summary")
    summary = projects.in_scope(everything, True, expenditure_only)
    latest = everything.agg(F.max("last_active")).first()[0]
    now = F.lit(latest).cast("int")

    codes = listed.where("hais_code IS NOT NULL").groupBy("hais_code").agg(F.min(F.struct("unit", "unit_desc", "hais_desc", "status")).alias("l")).select("hais_code", "l.*")
    tasks = codes.join(_of_houses(summary, "hais_code").drop("active_lines"), "hais_code", "left")
    tasks = tasks.withColumns({"houses": F.coalesce("houses", F.lit("—")), "has_activity": F.col("first_period").isNotNull(), "signal": signal(F.col("last_period"), now)})

    units = listed.where(~is_blank(F.col("unit"))).groupBy("unit").agg(F.min("unit_desc").alias("unit_desc"), F.count_distinct("hais_code").alias("hais_listed"), *[F.min(c).alias(c) for c in ("costc", "directorate", "department")])
    header = units.join(_of_houses(summary, "unit"), "unit", "left")
    for c in ("projcat", "projgrp"):
        header = header.join(projects.main_values(listed, c).select("unit", c), "unit", "left")
    header = header.withColumn("project_type", project_type(F.col("projcat")))
    header = header.withColumns({"houses": F.coalesce("houses", F.lit("—")), "active_lines": F.coalesce("active_lines", F.lit(0)), "signal": signal(F.col("last_period"), now)})
    header = header.withColumns({c: F.lit("") for c in ("project_manager", "start_date", "end_date")})  # in no source

    position = projects.positions(summary)
    task_position = projects.tasks(summary)
    history = projects.history(summary).withColumn("remaining_budget", F.col("cumulative_budget") - F.col("cumulative_actuals"))
    out = {"header": header, "tasks": tasks, "opening_position": position, "task_position": task_position, "annual_history": history}
    return out | {"reconciliation": reconciliation(out, listed, everything, summary)}


def reconciliation(tables: dict[str, DataFrame], listed: DataFrame, everything: DataFrame, summary: DataFrame) -> DataFrame:
    """(check, value): sizes, sums, and what doesn't agree between the tables (0 where all is well)."""
    listed_codes = listed.where("hais_code IS NOT NULL").select("hais_code").distinct()
    money = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias("value"))
    count = lambda df: df.agg(F.count("*").cast("double").alias("value"))
    in_financials = everything.where("hais_code IS NOT NULL").select("hais_code").distinct()
    active = everything.where("on_list AND first_active IS NOT NULL").select("hais_code").distinct()
    t = tables
    gap = lambda a, x, b, y: a.agg(F.coalesce(F.sum(x), F.lit(0)).alias("a"), F.lit(1).alias("_1")).join(b.agg(F.coalesce(F.sum(y), F.lit(0)).alias("b"), F.lit(1).alias("_1")), "_1").select((F.col("a") - F.col("b")).cast("double").alias("value"))
    checks = {
        "listed codes": count(listed_codes), "codes in the financials": count(in_financials), "listed codes with activity": count(active), "listed codes without activity": count(listed_codes.join(active, "hais_code", "left_anti")),
        "codes off the list": count(in_financials.join(listed_codes, "hais_code", "left_anti")), "actuals on listed codes": money(everything.where("on_list"), "actuals"), "spend to date": money(t["opening_position"], "spend_to_date"),
        "open commitments": money(t["opening_position"], "commitments"), "budget to date": money(t["opening_position"], "budget_to_date"),
        "tasks and positions apart": gap(t["task_position"], "spend_to_date", t["opening_position"], "spend_to_date"), "history and positions apart": gap(t["annual_history"], "actuals", summary, "actuals"),
        "positions without a project": count(t["opening_position"].join(t["header"].select("unit"), "unit", "left_anti")), "task positions without a task": count(t["task_position"].join(t["tasks"].select("hais_code"), "hais_code", "left_anti")),
        "tasks without a project": count(t["tasks"].join(t["header"].select("unit"), "unit", "left_anti")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), "value") for name, df in checks.items()])
