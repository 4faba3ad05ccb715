"""Aged open balances, and counts of what a ledger holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.clean import band

BUCKETS = ["Not Yet Due", "0-30 Days", "31-60 Days", "61-90 Days", "91-180 Days", "180+ Days"]


def aged_items(items: DataFrame, as_of: str) -> DataFrame:
    """Open items with a due date, days overdue and their bucket."""
    late = F.datediff(F.lit(as_of).cast("date"), F.col("due_date"))
    open_items = items.where(F.col("status").isin("N", "R", "I") & F.col("due_date").isNotNull())
    return open_items.withColumn("days_overdue", late).withColumn("bucket", band(F.col("days_overdue"), [-1, 30, 60, 90, 180], BUCKETS))


def aging(items: DataFrame, as_of: str) -> DataFrame:
    """Count and outstanding amount by house and bucket."""
    return aged_items(items, as_of).groupBy("house", "bucket").agg(F.count("*").alias("items"), F.sum(F.abs("rest_amount")).alias("outstanding"))


def ledger_volumes(master: DataFrame, open_items: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """One row a house: masters by status, closed ones still used lately, open items, overdue ones, balances."""
    recent = history.where(F.col("trans_date") >= F.date_sub(F.lit(as_of).cast("date"), 548)).select("house", "apar_id").distinct()
    used = master.where("status = 'C'").select("house", "apar_id").distinct().join(recent, ["house", "apar_id"], "left_semi").groupBy("house").agg(F.count("*").alias("closed_but_recent"))
    masters = master.groupBy("house").agg(F.count("*").alias("masters"), F.count_if(F.col("status") == "N").alias("active"), F.count_if(F.col("status") == "C").alias("closed"))
    overdue = F.col("due_date") < F.lit(as_of).cast("date")
    items = open_items.where("status IS DISTINCT FROM 'C'").groupBy("house").agg(
        F.count("*").alias("open_items"), F.count_if(overdue).alias("overdue_items"), F.coalesce(F.sum("rest_amount"), F.lit(0)).cast("decimal(28,2)").alias("balance")
    )
    past = history.groupBy("house").agg(F.count("*").alias("history_items"))
    out = masters.join(used, "house", "left").join(items, "house", "left").join(past, "house", "left")
    return out.fillna(0, ["closed_but_recent", "open_items", "overdue_items", "history_items"])


def status_split(items: DataFrame) -> DataFrame:
    return items.groupBy("house", "status").agg(F.count("*").alias("items"), F.sum("rest_amount").cast("decimal(28,2)").alias("balance"))


#: Statuses of open items, of the receivables' one more.
OPEN_AP, OPEN_AR = ("N", "R", "I", "P"), ("N", "R", "I", "P", "H")


def open_figures(items: DataFrame, statuses, as_of: str, name: str) -> DataFrame:
    """One row a house: all items, open ones, their balance, how many are overdue, and the days since the open ones' posting, added up and counted."""
    day = F.lit(as_of).cast("date")
    is_open = F.col("status").isin(*statuses)
    age = F.when(is_open, F.datediff(day, F.col("trans_date")))
    return items.groupBy("house").agg(
        F.count("*").alias(f"{name}_items"), F.count_if(is_open).alias(f"{name}_open"), F.coalesce(F.sum(F.when(is_open, F.col("rest_amount"))), F.lit(0)).cast("decimal(28,2)").alias(f"{name}_balance"),
        F.count_if(is_open & (F.col("due_date") < day)).alias(f"{name}_overdue"), (F.sum(age) / F.count(age)).alias(f"{name}_mean_age"), F.max("trans_date").alias(f"{name}_date"),
    )


def overview(suppliers: DataFrame, customers: DataFrame, payables: DataFrame, receivables: DataFrame, as_of: str) -> DataFrame:
    """One row a house that any of the tables has: masters by status, open items, balances, overdue items and the day of each extract."""
    masters = lambda df, name: df.groupBy("house").agg(F.count("*").alias(f"{name}_total"), F.count_if(F.col("status") == "N").alias(f"{name}_active"), F.count_if(F.col("status") == "C").alias(f"{name}_inactive"), F.max("last_update").alias(f"{name}_date"))
    parts = [masters(suppliers, "suppliers"), masters(customers, "customers"), *(open_figures(df, s, as_of, n).drop(f"{n}_items", f"{n}_mean_age") for df, s, n in ((payables, OPEN_AP, "ap"), (receivables, OPEN_AR, "ar")))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "house", "full_outer")
    return out.na.fill(0)


def open_split(items: DataFrame, statuses, column: str) -> DataFrame:
    """Open items and their balance by house and a column's values, as by status or pay flag; rows without a value are left out."""
    rows = items.where(F.col("status").isin(*statuses) & F.col(column).isNotNull())
    return rows.groupBy("house", column).agg(F.count("*").alias("items"), F.coalesce(F.sum("rest_amount"), F.lit(0)).cast("decimal(28,2)").alias("balance"))


def debit_credit(balances: DataFrame, debit: int = 1, credit: int = -1) -> DataFrame:
    """Opening balances by house: lines, those of each side, and what each side sums to (credits as a positive number)."""
    side = lambda flag, c: F.coalesce(F.sum(F.when(F.col("dc_flag") == flag, F.col(c))), F.lit(0))
    return balances.groupBy("house").agg(
        F.count("*").alias("lines"), F.count_if(F.col("dc_flag") == debit).alias("debits"), F.count_if(F.col("dc_flag") == credit).alias("credits"), side(debit, "amount").alias("debit_total"), F.abs(side(credit, "amount")).alias("credit_total")
    )


def ledger_profile(journals: DataFrame) -> DataFrame:
    """Journals by house: lines, vouchers, users, types and the span of periods."""
    return journals.groupBy("house").agg(
        F.count("*").alias("lines"), F.count_distinct("voucher_no").alias("vouchers"), F.count_distinct("user_id").alias("users"), F.count_distinct("voucher_type").alias("voucher_types"), F.min("period").alias("first_period"), F.max("period").alias("last_period")
    )


def asset_volumes(assets: DataFrame, as_of: str) -> DataFrame:
    """Assets by house and status: grants, those not updated for three years, and groups in use."""
    stale = F.col("last_update") < F.add_months(F.lit(as_of).cast("date"), -36)
    return assets.groupBy("house", "status").agg(F.count("*").alias("assets"), F.count_if(F.col("grant_flag") == 1).alias("grants"), F.count_if(stale).alias("stale"), F.count_distinct("asset_group").alias("groups"))


#: Types of asset transactions whose meaning is confirmed, and those whose isn't.
CONFIRMED_TYPES = ("CA", "PC", "ND", "ED", "FD", "SA", "VN", "CI")
UNKNOWN_TYPES = ("NF", "NT", "TF", "TT", "RF", "RT", "OS", "WU", "TC")


def asset_intro(assets: DataFrame, books: DataFrame, groups: DataFrame, balances: DataFrame, flags: DataFrame) -> DataFrame:
    """House, what is counted (section and name) and its figure: assets by status, groups and books by method, assets in several books, transactions by type."""
    told = lambda df, section, name, n: df.groupBy("house", F.lit(section).alias("section"), name.alias("name")).agg(n.cast("bigint").alias("n"))
    one = groups.groupBy("house", "asset_group").agg(F.min(F.struct("grp_status", "depr_method")).alias("g")).select("house", "g.*")
    several = books.groupBy("house", "asset_id").agg(F.count("*").alias("_n")).where("_n > 1")
    confirmed = F.when(F.col("trans_type").isin(*CONFIRMED_TYPES), "confirmed").when(F.col("trans_type").isin(*UNKNOWN_TYPES), "unknown")
    rows = F.count("*")
    parts = [
        told(assets, "master", F.col("status"), rows), told(one, "group status", F.col("grp_status"), rows), told(one, "group method", F.col("depr_method"), rows),
        told(books, "book status", F.col("status"), rows), told(books, "book method", F.col("depr_method"), rows), told(several, "books", F.lit("several"), rows),
        told(balances.where(confirmed.isNotNull()), "transactions", F.concat(confirmed, F.lit(" "), F.col("trans_type")), F.sum("transaction_count")),
        told(flags.where(F.col("trans_type").isin("CA", "SA")), "flags", F.col("trans_type"), rows),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("name IS NOT NULL")


def dimension_structure(config: DataFrame) -> DataFrame:
    """Values by attribute: those with a place on a journal line each by itself, the others together as X or other."""
    place = F.trim("dim_position")
    on_line = place.isin(*map(str, range(8)))
    label = F.when(on_line, F.coalesce("description", F.lit(""))).when(place == "X", "X-position").otherwise("Other")
    scope = F.when(on_line, "GL dimensions").otherwise("Out of scope")
    return config.groupBy("house", scope.alias("scope"), label.alias("label"), F.when(on_line, F.col("attribute_id")).alias("attribute_id")).agg(
        F.count_distinct("attribute_id").alias("attributes"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("active", "closed")]
    )
