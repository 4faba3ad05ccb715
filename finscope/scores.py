"""Scores and counts over check results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES, RAGS = ("Critical", "High", "Medium", "Low"), ("Red", "Amber", "Green")


def score_by(results: DataFrame, *by: str) -> DataFrame:
    """Weighted pass rate: passing of total, percent."""
    return results.groupBy(*by).agg(F.sum("passing").alias("passing"), F.sum("total").alias("total")).withColumn("score", F.bround(F.col("passing") * 100.0 / F.col("total"), 2))


def score_matrix(results: DataFrame, houses=("HOC", "HOL")) -> DataFrame:
    """Weighted pass rate by domain, a column a house, with counts of each colour."""
    def rate(h):
        own = F.col("house") == h
        return F.bround(F.sum(F.when(own, F.col("passing"))) * 100.0 / F.sum(F.when(own, F.col("total"))), 2).alias(f"score_{h.lower()}")

    colours = [F.count_if(F.col("rag") == c).alias(c.lower()) for c in RAGS]
    return results.groupBy("domain").agg(*[rate(h) for h in houses], *colours)


def risk_matrix(results: DataFrame) -> DataFrame:
    """Checks that aren't green, by severity and colour."""
    return results.where("rag <> 'Green'").groupBy("severity").agg(*[F.count_if(F.col("rag") == c).alias(c.lower()) for c in RAGS[:2]])


def means(results: DataFrame) -> DataFrame:
    """Unweighted means by domain and dimension, of rates as decimals: sums of floats depend on their order."""
    mean = lambda c: F.bround(F.avg(F.col(c).cast("decimal(9, 4)")), 4).cast("double").alias(f"mean_{c}")
    return results.groupBy("domain", "dimension").agg(mean("pass_rate"), mean("error_rate"))


def scorecard(results: DataFrame) -> DataFrame:
    """Counts by house: checks, colours, and failing checks of each severity."""
    colours = [F.count_if(F.col("rag") == c).alias(c.lower()) for c in RAGS]
    failing = [F.count_if((F.col("severity") == s) & (F.col("failing") > 0)).alias(f"failing_{s.lower()}") for s in SEVERITIES]
    return results.groupBy("house").agg(F.count("*").alias("checks"), *colours, *failing)


def summary(results: DataFrame) -> DataFrame:
    """One row: checks, those with failures, and critical ones among them."""
    failed = F.col("failing") > 0
    return results.agg(F.count_distinct("check_id").alias("checks"), F.count_distinct(F.when(failed, F.col("check_id"))).alias("checks_failing"), F.count_distinct(F.when(failed & (F.col("severity") == "Critical"), F.col("check_id"))).alias("critical_failing"))
