"""Extract jobs over raw ledger tables, and profiles of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finscope.clean import is_blank, wide_to_long


def master_with_last_transaction(header: DataFrame, addresses: DataFrame, open_items: DataFrame, history: DataFrame) -> DataFrame:
    """Header rows with their first address by sequence and their last transaction, open or historical."""
    first = Window.partitionBy("client", "apar_id").orderBy("sequence_no", "address", "zip_code")
    address = addresses.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("client", "apar_id", "address", "place", "zip_code", "province")
    rows = open_items.select("client", "apar_id", "trans_date").unionByName(history.select("client", "apar_id", "trans_date"))
    last = rows.groupBy("client", "apar_id").agg(F.max("trans_date").alias("last_trans_date"))
    return header.join(address, ["client", "apar_id"], "left").join(last, ["client", "apar_id"], "left")


def open_transactions(items: DataFrame) -> DataFrame:
    return items.where(~F.col("status").eqNullSafe("C"))


def recent_history(items: DataFrame, as_of: str, months: int = 18) -> DataFrame:
    return items.where(F.col("trans_date") >= F.add_months(F.lit(as_of).cast("date"), -months))


def asset_balances(transactions: DataFrame) -> DataFrame:
    """Sums by asset, book, type and account of rows that are neither control rows nor closed."""
    live = transactions.where("NOT trans_type <=> 'CI' AND NOT status <=> 'C'")
    return live.groupBy("client", "asset_id", "depr_book_id", "trans_type", "account").agg(F.sum("amount").alias("total_amount"), F.max("trans_date").alias("max_trans_date"), F.min("trans_date").alias("min_trans_date"), F.count("*").alias("transaction_count"))


def asset_flags(transactions: DataFrame) -> DataFrame:
    """Capitalisations and disposals as they are, and each book's latest depreciation."""
    kept = transactions.where(F.col("trans_type").isin("CA", "SA")).select("client", "asset_id", "depr_book_id", "trans_type", "trans_date", "amount")
    last = transactions.where(F.col("trans_type").isin("ND", "ED", "FD")).groupBy("client", "asset_id", "depr_book_id", "trans_type").agg(F.max("trans_date").alias("trans_date")).withColumn("amount", F.lit(None).cast(transactions.schema["amount"].dataType))
    return kept.unionByName(last)


def columns_of(df: DataFrame, clients: list[str], columns: list[str]) -> DataFrame:
    """The named columns of the clients' rows: asset master, depreciation books and the like."""
    return df.where(F.col("client").isin(*clients)).select(*columns)


def group_books(groups: DataFrame, books: DataFrame) -> DataFrame:
    return groups.join(books, ["client", "asset_group"], "left")


def dimension_config(attributes: DataFrame, values: DataFrame) -> DataFrame:
    """Attributes with how many values they have, by status."""
    n = values.groupBy("client", "attribute_id").agg(F.count("*").alias("total_values"), F.count_if(F.col("status") == "N").alias("active"), F.count_if(F.col("status") == "C").alias("closed"))
    return attributes.join(n, ["client", "attribute_id"], "left").na.fill(0, ["total_values", "active", "closed"])


def dimension_values(values: DataFrame, dimensions: DataFrame, clients: list[str]) -> DataFrame:
    """Live values of live dimensions that have a place on a journal line (0 to 7), with that place and the dimension's name."""
    live = dimensions.where((F.col("status") == "N") & F.col("dim_position").isin(*map(str, range(8)))).select("client", "attribute_id", "dim_position", F.col("description").alias("dim_description"))
    own = values.where((F.col("status") == "N") & F.col("client").isin(*clients)).drop("dim_position", "dim_description")
    return own.join(live, ["client", "attribute_id"])


def dimensions_in_use(transactions: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct position and value of the dimension columns, in one scan."""
    return wide_to_long(transactions, ["client"], columns)


def fiscal_year(journals: DataFrame, year: int) -> DataFrame:
    return journals.where(F.col("fiscal_year") == year)


#: Voucher types of budget entries, and those of budgets that count.
BUDGET_ENTRIES, BUDGET_TYPES = ("BU", "BV"), ("GI", "SI")


def opening_balances(lines: DataFrame, clients: list[str], first: int, last: int) -> DataFrame:
    """Posted lines of the periods, budget entries apart."""
    return lines.where(F.col("client").isin(*clients) & F.col("period").between(first, last) & ~F.col("voucher_type").isin(*BUDGET_ENTRIES))


def future_budgets(lines: DataFrame, clients: list[str], first: int, last: int) -> DataFrame:
    """Lines of budget vouchers of the periods that have no status."""
    return lines.where(F.col("client").isin(*clients) & F.col("period").between(first, last) & F.col("voucher_type").isin(*BUDGET_TYPES) & (F.coalesce("status", F.lit("")) == ""))


#: Columns of the budget view, and what they hold.
BUDGET_COLUMNS = {
    "client": "client", "period": "period", "dim1": "account", "dim2": "cost_centre", "dim3": "unit_code", "dim4": "resno", "dim5": "hais_code", "dim6": "recharge",
    "pla_amount": "orig_budget", "plb_amount": "curr_budget", "ple_amount": "forecast_actuals", "plc_amount": "funds_budget", "plf_amount": "pfst_budget", "plg_amount": "q1_forecast", "plh_amount": "q2_forecast", "pli_amount": "q3_forecast",
    "plk_amount": "mtip_budget", "plm_amount": "base_budget", "plo_amount": "myp_budget", "po_rest_com_amt": "po_commitment",
}


def budget_versions(view: DataFrame, clients: list[str], first: int, last: int) -> DataFrame:
    rows = view.where(F.col("client").isin(*clients) & F.col("period").between(first, last))
    return rows.select(*[F.col(c).alias(name) for c, name in BUDGET_COLUMNS.items()])


def account_activity(lines: DataFrame) -> DataFrame:
    return lines.groupBy("house", "account").agg(F.min("period").alias("earliest_period"), F.max("period").alias("latest_period"), F.count("*").alias("posting_count"))


def order_lines(headers: DataFrame, lines: DataFrame, categories: DataFrame) -> DataFrame:
    """Lines with their header's supplier and their category's name."""
    heads = headers.groupBy("client", "order_id").agg(F.min(F.struct("apar_id", "order_date")).alias("h"))
    names = categories.groupBy("art_gr_id").agg(F.min("art_gr_description").alias("category"))
    return lines.join(heads, ["client", "order_id"]).join(names, "art_gr_id", "left").select(lines["*"], F.col("h.apar_id").alias("header_apar_id"), F.col("h.order_date"), "category")


def first_entries(df: DataFrame, columns: list[str], placeholder: str = "1900-01-02", table: str = "") -> DataFrame:
    """For each date column: rows, filled ones, placeholders, and the earliest date that isn't one; all in one scan."""
    low = F.lit(placeholder).cast("date")
    parts = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("filled"), F.count_if(F.col(c) <= low).alias("placeholders"), F.min(F.when(F.col(c) > low, F.col(c).cast("date"))).alias("earliest")) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each numeric column: rows, nulls, signs, extremes, exact sum, distinct values and populated share (null without rows); one aggregation over the table."""
    of = lambda c: F.col(c).cast("double")
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(of(c) < 0).alias("negative"), F.count_if(of(c) == 0).alias("zero"), F.count_if(of(c) > 0).alias("positive"),
            F.min(of(c)).alias("least"), F.max(of(c)).alias("greatest"), F.sum(F.col(c).cast("decimal(30,6)")).alias("total"), F.count_distinct(c).alias("distinct_values"),
            F.when(F.count("*") > 0, F.count(c) / F.count("*")).alias("populated"),
        ) for c in columns
    ]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, values as text, in one scan and one aggregation.

    Blank texts and nulls are one value, null. A value that most rows share is
    counted before anything is shuffled.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(~is_blank(F.col(c).cast("string")), F.trim(F.col(c).cast("string"))).alias("value")) for c in columns]))
    return df.select(cells.alias("cell")).groupBy("cell.column", "cell.value").agg(F.count("*").alias("n"))


def profile_columns(counts: DataFrame) -> DataFrame:
    """Of each column of `counted`: rows, filled ones and their share, different values, and of those that are numbers the signs, extremes and sum."""
    number, n = F.col("value").try_cast("decimal(28,6)"), F.col("n")
    of = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return counts.groupBy("column").agg(
        F.sum(n).alias("rows"), of(F.col("value").isNotNull()).alias("filled"), (of(F.col("value").isNotNull()) / F.sum(n)).alias("populated"), F.count("value").alias("distinct_values"),
        of(number < 0).alias("negative"), of(number == 0).alias("zero"), of(number > 0).alias("positive"), F.min(number).cast("double").alias("least"), F.max(number).cast("double").alias("greatest"), F.sum(number * n).cast("double").alias("total"),
    )


def top_values(counts: DataFrame, most: int = 20) -> DataFrame:
    """(column, rank, value, n): the most frequent values of each column, ties by the value; only so many of each column are ever shuffled by a task."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("column", "rank", "value", "n")
