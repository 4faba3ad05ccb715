"""Net book value of assets from their balances by account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUSE, RESERVE = "HOC", "70000"
BANDS = ["Negative", "Nil", "Under £1k", "£1k – £10k", "£10k – £100k", "£100k – £1m", "Over £1m"]
CLASSES, BOOKS = ("cost", "depreciation", "reserve", "other"), ("CURR", "HIST")
KEYS = ["house", "client", "asset_id"]


def normalise_account(c):
    plain = F.regexp_replace(F.trim(c), r"\.0+$", "")
    return F.when(~F.coalesce(plain, F.lit("")).isin("", "nan", "None"), plain)


def account_class(c):
    a = F.coalesce(normalise_account(c), F.lit(""))
    return F.when(a.startswith("1") & a.endswith("00"), "cost").when(a.startswith("1") & a.endswith("15"), "depreciation").when(a == RESERVE, "reserve").otherwise("other")


def nbv_band(c):
    v = F.coalesce(c, F.lit(0))
    out = F.when(v <= -1, BANDS[0]).when(F.abs(v) < 1, BANDS[1])
    for edge, label in zip((1_000, 10_000, 100_000, 1_000_000), BANDS[2:]):
        out = out.when(v < edge, label)
    return out.otherwise(BANDS[-1])


def books(balances: DataFrame, depreciation: DataFrame) -> DataFrame:
    """One row an asset and book: amounts by class of account, net book value and flags."""
    amount = F.coalesce("total_amount", F.lit(0)).cast("decimal(28,2)")
    rows = balances.where(F.col("house") == HOUSE).withColumn("class", account_class(F.col("account"))).withColumn("amount", amount)
    sums = [F.sum(F.when(F.col("class") == c, F.col("amount")).otherwise(F.lit(0).cast("decimal(28,2)"))).alias(c) for c in CLASSES]
    valued = F.col("class").isin("cost", "depreciation")
    out = rows.groupBy(*KEYS, "depr_book_id").agg(
        *sums,
        F.sum("amount").alias("net_all_accounts"),
        F.array_join(F.array_sort(F.collect_set("trans_type")), ", ").alias("trans_types"),
        F.bool_or(valued).alias("has_nbv_account"),
        F.bool_or((F.col("trans_type") == "SA") & valued & (F.abs("amount") >= 1)).alias("has_disposal"),
        F.bool_or(F.col("trans_type") == "OS").alias("has_os"),
        F.bool_or(F.col("trans_type").isin("CA", "PC")).alias("has_ca"),
        F.sum("transaction_count").alias("transaction_count"),
        F.max("max_trans_date").alias("last_trans_date"),
    )
    own = depreciation.where(F.col("house") == HOUSE).groupBy("client", "asset_id", "depr_book_id").agg(F.min(F.struct("depr_method", "lifetime", "status")).alias("d"))
    out = out.join(own, ["client", "asset_id", "depr_book_id"], "left").withColumn("nbv", F.col("cost") + F.col("depreciation"))
    return out.select(*KEYS, "depr_book_id", *CLASSES, "nbv", "net_all_accounts", "trans_types", "has_nbv_account", "has_disposal", "has_os", "has_ca", "transaction_count", "last_trans_date", F.col("d.depr_method"), F.col("d.lifetime"), F.col("d.status").alias("book_status"))


def never_capitalised(balances: DataFrame) -> DataFrame:
    """Assets with capitalisation rows, each of which is nil."""
    nil = F.coalesce(F.abs("total_amount") < 0.005, F.lit(False))
    rows = balances.where((F.col("house") == HOUSE) & (F.col("trans_type") == "CA"))
    return rows.groupBy("asset_id").agg(F.bool_and(nil).alias("nil")).where("nil").select("asset_id")


def assets(balances: DataFrame, depreciation: DataFrame, master: DataFrame) -> DataFrame:
    """One row an asset, its current and historic books side by side."""
    b = books(balances, depreciation)
    of = lambda book, c: F.sum(F.when(F.col("depr_book_id") == book, F.col(c))).alias(f"{book.lower()}_{c}")
    out = b.groupBy(*KEYS).agg(
        *[of(book, c) for book in BOOKS for c in ("cost", "depreciation", "nbv", "net_all_accounts")],
        *[F.bool_or(F.col("depr_book_id") == book).alias(f"has_{book.lower()}") for book in BOOKS],
        (-F.sum("reserve")).alias("reval_reserve"),
        *[F.bool_or(c).alias(c) for c in ("has_nbv_account", "has_disposal", "has_os", "has_ca")],
        F.sum("transaction_count").alias("transaction_count"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("trans_types", ", "))))), ", ").alias("trans_types"),
        F.min(F.when(F.col("depr_book_id") == "CURR", F.col("depr_method"))).alias("curr_depr_method"),
    )
    own = master.where(F.col("house") == HOUSE).groupBy("client", "asset_id").agg(F.min(F.struct("description", "asset_group", "status", "cap_date_from", "org_amount")).alias("m"))
    out = out.join(own, ["client", "asset_id"], "left").select(out["*"], "m.description", F.coalesce("m.asset_group", F.lit("(no group)")).alias("asset_group"), "m.status", "m.cap_date_from", "m.org_amount")
    both = F.col("has_curr") & F.col("has_hist")
    zero = F.lit(0)
    expected = F.coalesce("curr_nbv", zero) - F.coalesce("hist_nbv", zero)
    out = out.withColumns({
        "reval_expected": F.when(both, expected),
        "reval_variance": F.when(both, F.col("reval_reserve") - expected),
        "origin": F.when(F.col("has_os") & ~F.col("has_ca"), "Migrated (OS)").when(F.col("has_os"), "Migrated + Unit4 additions").otherwise("Capitalised in Unit4"),
        "nbv_band": nbv_band(F.col("curr_nbv")),
    })
    valueless = F.lit(True)
    for c in ("curr_cost", "curr_depreciation", "hist_cost", "hist_depreciation"):
        valueless = valueless & (F.abs(F.coalesce(c, zero)) < 0.005)
    never = never_capitalised(balances).withColumn("_never", F.lit(True))
    return out.join(never, "asset_id", "left").withColumn("not_capitalised", F.coalesce("_never", F.lit(False)) & valueless).drop("_never")


def band_chart(nbv: DataFrame) -> DataFrame:
    return nbv.where("status = 'N' AND NOT not_capitalised").groupBy("nbv_band", "origin").agg(F.count("*").alias("assets"), F.sum("curr_nbv").cast("decimal(28,2)").alias("curr_nbv"))


def account_detail(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balances by asset and account, with the account's name."""
    rows = balances.where(F.col("house") == HOUSE).withColumn("account", normalise_account(F.col("account")))
    sums = rows.groupBy("client", "asset_id", "account").agg(F.sum("total_amount").alias("amount"), F.sum("transaction_count").alias("transactions"))
    names = accounts.where(F.col("house") == HOUSE).groupBy("account").agg(F.min("description").alias("account_name"))
    return sums.join(names, "account", "left").withColumn("class", account_class(F.col("account")))
