"""Contract reconciliation, budget and staff figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.clean import age_years, band, is_blank


def organisation_reliability(contracts: DataFrame) -> DataFrame:
    """Stated against derived house, with a verdict."""
    stated = F.upper(F.trim("organisation"))
    verdict = F.when(F.col("house") == "Unknown", "No match").when(stated == "JOINT", "Joint").when(stated == F.col("house"), "Agrees").when(stated.isin("HOC", "HOL"), "Differs").otherwise("Not a house")
    return contracts.groupBy(stated.alias("stated"), F.col("house").alias("derived"), verdict.alias("verdict")).agg(F.count("*").alias("contracts"))


def contract_metrics(contracts: DataFrame, as_of: str, soon_days: int = 90) -> DataFrame:
    """Contracts by house: live, expired, ending soon, and their value."""
    day = F.lit(as_of).cast("date")
    live = (F.col("start_date") <= day) & (F.col("end_date") >= day)
    return contracts.groupBy("house").agg(
        F.count("*").alias("contracts"), F.count_if(live).alias("live"), F.count_if(F.col("end_date") < day).alias("expired"), F.count_if(live & (F.col("end_date") <= F.date_add(day, soon_days))).alias("ending_soon"), F.sum("total_award_value").cast("decimal(28,2)").alias("value")
    )


def contract_gaps(contracts: DataFrame, commitments: DataFrame, spend: DataFrame, lines: DataFrame) -> DataFrame:
    """References by the systems that hold them."""
    refs = lambda df, c: df.where(~is_blank(F.col(c))).select(F.trim(c).alias("ref")).distinct()
    out = None
    for name, df in (("in_contracts", refs(contracts, "contract_ref")), ("in_commitments", refs(commitments, "u4_contract_id")), ("in_spend", refs(spend, "u4_contract_id")), ("in_orders", refs(lines, "contract_id"))):
        df = df.withColumn(name, F.lit(True))
        out = df if out is None else out.join(df, "ref", "full_outer")
    marks = ["in_contracts", "in_commitments", "in_spend", "in_orders"]
    return out.na.fill(False, marks).groupBy(*marks).agg(F.count("*").alias("refs"))


def budget_kpis(lines: DataFrame) -> DataFrame:
    """Totals by house, how much is used, moved, left and forecast."""
    s = lines.groupBy("house").agg(*[F.sum(F.coalesce(c, F.lit(0).cast("decimal(18,2)"))).alias(c) for c in ("gl_actuals", "orig_budget", "curr_budget", "live_forecast")])
    rate = lambda a, b: F.bround(F.when(F.col(b) != 0, F.col(a).cast("double") / F.col(b).cast("double") * 100), 2)
    return s.withColumns({"utilisation_pct": rate("gl_actuals", "curr_budget"), "virement": F.col("curr_budget") - F.col("orig_budget"), "remaining": F.col("curr_budget") - F.col("gl_actuals"), "forecast_variance": F.col("live_forecast") - F.col("curr_budget")})


def budget_top(lines: DataFrame, column: str, n: int) -> DataFrame:
    """The n values of a column with the most spend."""
    return lines.groupBy(F.coalesce(column, F.lit("(none)")).alias(column)).agg(F.sum("gl_actuals").alias("gl_actuals"), F.sum("curr_budget").alias("curr_budget")).orderBy(F.desc("gl_actuals"), column).limit(n)


def budget_by_period(lines: DataFrame) -> DataFrame:
    return lines.groupBy("house", "year", "period").agg(F.sum("gl_actuals").alias("gl_actuals"), F.sum("curr_budget").alias("curr_budget"))


def staff_metrics(employees: DataFrame, as_of: str) -> DataFrame:
    """Active employees by department, contract and tenure, with their mean age."""
    day = F.lit(as_of).cast("date")
    tenure = band(F.datediff(day, F.col("start_date")) / F.lit(365.25), [1, 3, 5, 10], ["Under 1 year", "1-3 years", "3-5 years", "5-10 years", "Over 10 years"])
    active = employees.where("employment_status = 'Active'")
    return active.groupBy("department", "contract_type", tenure.alias("tenure")).agg(F.count("*").alias("employees"), F.round(F.avg(age_years(F.col("dob"), day)), 4).alias("mean_age"))


def payroll_metrics(payroll: DataFrame) -> DataFrame:
    """Components by pay period."""
    parts = ("gross_pay", "tax_deducted", "ni_deducted", "pension_deducted", "other_deductions", "net_pay", "overtime_pay")
    return payroll.groupBy("pay_period").agg(F.count("*").alias("payments"), F.count_distinct("employee_id").alias("employees"), *[F.sum(F.coalesce(c, F.lit(0).cast("decimal(18,2)"))).alias(c) for c in parts])
