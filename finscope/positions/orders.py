"""Purchase order positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.clean import band, is_blank

LIVE = ("O", "N", "A")
AGES = ["0-30 days", "31-90 days", "91-180 days", "181-365 days", "Over 1 year"]
AMENDMENTS = ["None", "1", "2-3", "4+"]


def _zero():
    return F.lit(0).cast("decimal(18,2)")


def _amount(c: str):
    return F.coalesce(F.col(c), _zero())


def _invoiced():
    """The greater of the two fields that tell what has been invoiced."""
    return F.greatest(_amount("arr_amount"), _amount("invoiced"))


def status_summary(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders, and their lines' ordered, invoiced and received amounts, by status of each."""
    heads = headers.groupBy("status").agg(F.count_distinct("client", "order_id").alias("orders"))
    totals = lines.groupBy("status").agg(F.sum(_amount("amount")).alias("ordered"), F.sum(_invoiced()).alias("invoiced"), F.sum(_amount("vow_amount")).alias("received"))
    out = heads.join(totals, "status", "full_outer").na.fill(0)
    return out.withColumn("open_commitment", F.when(F.col("status").isin(*LIVE), F.greatest(F.col("ordered") - F.col("invoiced"), F.lit(0))).otherwise(0).cast("decimal(28,2)"))


def fulfilment(lines: DataFrame) -> DataFrame:
    """Received but not invoiced, and ordered but not received, of live and resolved lines; never below 0 for a line."""
    live = F.when(F.col("status").isin(*LIVE), "live").otherwise("resolved").alias("state")
    floor = lambda x: F.sum(F.greatest(x, _zero()))
    return lines.groupBy(live).agg(floor(_amount("vow_amount") - _invoiced()).alias("received_not_invoiced"), floor(_amount("amount") - _amount("vow_amount")).alias("not_received"), F.count("*").alias("lines"))


def resolution_mix(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Resolved orders by status: how many ended with nothing of value open, and the value released."""
    totals = lines.groupBy("client", "order_id").agg(F.sum(_amount("amount")).alias("value"), F.sum(_invoiced()).alias("invoiced"))
    done = headers.where(F.col("status").isin("F", "C", "T")).select("client", "order_id", "status").distinct().join(totals, ["client", "order_id"], "left")
    left = F.coalesce(F.col("value") - F.col("invoiced"), F.lit(0))
    return done.groupBy("status").agg(F.count("*").alias("orders"), F.count_if(left <= 0).alias("clean"), F.sum(F.greatest(left, F.lit(0))).cast("decimal(28,2)").alias("released"))


def status_mismatch(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose status differs from their header's, by both."""
    heads = headers.groupBy("client", "order_id").agg(F.min("status").alias("header_status"))
    return lines.join(heads, ["client", "order_id"]).where("status <> header_status").groupBy("header_status", F.col("status").alias("line_status")).agg(F.count("*").alias("lines"))


def age_bands(headers: DataFrame, lines: DataFrame, as_of: str) -> DataFrame:
    """Live orders by age, with their value."""
    value = lines.groupBy("client", "order_id").agg(F.sum(_amount("amount")).alias("value"))
    live = headers.where(F.col("status").isin(*LIVE) & F.col("order_date").isNotNull()).groupBy("client", "order_id").agg(F.min("order_date").alias("order_date"))
    age = band(F.datediff(F.lit(as_of).cast("date"), F.col("order_date")), [30, 90, 180, 365], AGES)
    return live.join(value, ["client", "order_id"], "left").groupBy(age.alias("age")).agg(F.count("*").alias("orders"), F.coalesce(F.sum("value"), F.lit(0)).cast("decimal(28,2)").alias("value"))


def spend_by_category(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.coalesce("art_gr_description", F.lit("(none)")).alias("category")).agg(F.sum(_amount("amount")).alias("ordered"), F.sum(_invoiced()).alias("invoiced"), F.count("*").alias("lines"))


def top_suppliers(lines: DataFrame, suppliers: DataFrame, n: int = 15) -> DataFrame:
    """The n suppliers of greatest order value; totals first, so names are joined to n rows."""
    top = lines.groupBy("apar_id").agg(F.sum(_amount("amount")).alias("ordered"), F.count_distinct("order_id").alias("orders")).orderBy(F.desc("ordered"), "apar_id").limit(n)
    names = suppliers.groupBy("apar_id").agg(F.min("apar_name").alias("apar_name"))
    return top.join(names, "apar_id", "left").select("apar_id", "apar_name", "ordered", "orders")


def amendment_profile(headers: DataFrame) -> DataFrame:
    bands = band(F.coalesce("amend_no", F.lit(0)), [0, 1, 3], AMENDMENTS)
    return headers.groupBy(bands.alias("amendments")).agg(F.count("*").alias("orders"))


def policy_signals(headers: DataFrame, lines: DataFrame, small: int = 5000) -> DataFrame:
    """One row: live orders, small ones, and those without a contract, a responsible person or an account."""
    value = lines.groupBy("client", "order_id").agg(F.sum(_amount("amount")).alias("value"), F.count_if(is_blank(F.col("account"))).alias("no_account"))
    live = headers.where(F.col("status").isin(*LIVE)).join(value, ["client", "order_id"], "left")
    return live.agg(
        F.count("*").alias("orders"), F.count_if(F.col("value") < small).alias("small"), F.count_if(is_blank(F.col("contract_id"))).alias("no_contract"), F.count_if(is_blank(F.col("responsible"))).alias("no_responsible"), F.count_if(F.col("no_account") > 0).alias("no_account")
    )


def contract_leakage(lines: DataFrame) -> DataFrame:
    """Suppliers with both tagged and untagged spend."""
    tagged = ~is_blank(F.col("contract_id"))
    sums = lines.groupBy("apar_id").agg(F.sum(F.when(tagged, _amount("amount")).otherwise(_zero())).alias("tagged"), F.sum(F.when(~tagged, _amount("amount")).otherwise(_zero())).alias("untagged"), F.count_distinct(F.when(tagged, F.trim("contract_id"))).alias("contracts"))
    return sums.where("tagged > 0 AND untagged > 0")


def leakage_detail(lines: DataFrame, contracts: DataFrame, masters: DataFrame) -> DataFrame:
    """A row for each contract of a supplier with tagged and untagged spend: what was ordered under it and its award value, beside the supplier's own sums.

    Of several contracts with a reference, and of several names of a supplier, the
    least counts.
    """
    flagged = contract_leakage(lines).withColumn("untagged_pct", (F.col("untagged").cast("double") / (F.col("tagged") + F.col("untagged")).cast("double")) * 100)
    ordered = lines.where(~is_blank(F.col("contract_id"))).groupBy("apar_id", F.trim("contract_id").alias("contract_ref")).agg(F.sum(_amount("amount")).alias("contract_tagged"))
    awards = contracts.where(~is_blank(F.col("contract_ref"))).groupBy(F.trim("contract_ref").alias("contract_ref")).agg(F.min("total_award_value").alias("total_award_value"))
    names = masters.groupBy("apar_id").agg(F.min("apar_name").alias("apar_name"))
    return ordered.join(flagged.drop("contracts"), "apar_id").join(awards, "contract_ref", "left").join(names, "apar_id", "left").withColumn("apar_name", F.coalesce("apar_name", "apar_id"))
