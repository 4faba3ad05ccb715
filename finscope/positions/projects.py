"""Project codes, positions, history and commitments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finscope.clean import fy_label, is_blank, period_index

ATTRS = ("projcat", "projgrp", "projgrp_desc", "costc", "directorate", "department")
AMOUNTS = ("actuals", "budget", "committed")
PAIRS = (("fin_unit", "unit", "Unit"), ("fin_costc", "costc", "Cost centre"), ("fin_directorate", "directorate", "Directorate"), ("fin_department", "department", "Department"))
CLASSES = (("projcat", "Projcat"), ("projgrp", "Projgrp"), ("costc", "Cost centre"), ("directorate", "Directorate"))
SMALL = 0.005


def joined(values):
    return F.array_join(F.array_sort(F.collect_set(values)), ", ")


def lines(listed: DataFrame, financials: DataFrame) -> DataFrame:
    """Financial lines with the attributes of the code's listing; of several listings the least counts."""
    first = listed.where("hais_code IS NOT NULL").groupBy("hais_code").agg(F.min(F.struct("unit", "unit_desc", "hais_desc", *ATTRS)).alias("l"))
    fin = financials.select("hais_code", "house", "fiscal_year", "period", F.upper(F.coalesce("mipck_l1_desc", F.lit(""))).rlike("INCOME|RECEIPT|GRANT").alias("is_income"), *[F.coalesce(c, F.lit(0)).cast("decimal(18,2)").alias(c) for c in AMOUNTS], *[F.col(c).alias(f"fin_{c}") for c in ("unit", "costc", "directorate", "department")])
    out = fin.join(first, "hais_code", "left")
    unit = F.coalesce("l.unit", "fin_unit")
    return out.select(*fin.columns, F.col("l").isNotNull().alias("on_list"), unit.alias("unit"), F.coalesce("l.unit_desc", unit).alias("unit_desc"), "l.hais_desc", *[F.col(f"l.{c}") for c in ATTRS])


def is_active():
    out = F.lit(False)
    for c in AMOUNTS:
        out = out | (F.abs(c) >= SMALL)
    return out


def in_scope(rows: DataFrame, on_list_only: bool = True, expenditure_only: bool = False, houses=()) -> DataFrame:
    """Lines, or their summary, of listed codes, without income, of some houses."""
    keep = F.col("on_list") if on_list_only else F.lit(True)
    if expenditure_only:
        keep = keep & ~F.col("is_income")
    if houses:
        keep = keep & F.col("house").isin(*houses)
    return rows.where(keep)


def summarise(rows: DataFrame) -> DataFrame:
    """The one large shuffle: sums at code, house and year, with first and last active period."""
    active = F.when(is_active(), F.col("period"))
    return rows.groupBy("unit", "unit_desc", "hais_code", "house", "fiscal_year", "is_income", "on_list").agg(*[F.sum(c).alias(c) for c in AMOUNTS], F.min(active).alias("first_active"), F.max(active).alias("last_active"))


def codes(listed: DataFrame, rows: DataFrame, summary: DataFrame) -> DataFrame:
    """One row a listing, with what is odd about its code, unit, description and class."""
    out = listed.withColumn("dup_count", F.count("*").over(Window.partitionBy("hais_code")))
    norm = F.trim(F.regexp_replace(F.upper(F.coalesce("hais_desc", F.lit(""))), r"^DO NOT USE\s*-?\s*", ""))
    both = F.upper(F.concat_ws(" ", F.coalesce("hais_desc", F.lit("")), F.coalesce("unit_desc", F.lit(""))))
    out = out.withColumns({
        "prefix_ok": F.coalesce((F.col("hais_code") != "") & (F.col("unit") != "") & F.col("hais_code").startswith(F.col("unit")), F.lit(False)),
        "do_not_use": both.contains("DO NOT USE") & (F.col("status") == "N"),
        "_norm": norm,
        "_group": F.upper(F.coalesce("projgrp_desc", F.lit(""))),
    })
    variants = out.groupBy("unit").agg(*[F.array_sort(F.collect_set(c)).alias(f"_{c}") for c, _ in CLASSES])
    told = F.concat_ws("; ", *[F.when(F.size(f"_{c}") > 1, F.concat(F.lit(f"{label}: "), F.array_join(f"_{c}", ", "))) for c, label in CLASSES])
    variants = variants.select("unit", told.alias("unit_class_variants"))
    shared = out.where("status = 'N' AND unit IS NOT NULL AND _norm <> ''").groupBy("_norm").agg(F.array_sort(F.collect_set("unit")).alias("_units")).where(F.size("_units") > 1)
    groups = out.where("projgrp IS NOT NULL").groupBy("_group").agg(F.array_sort(F.collect_set("projgrp")).alias("_codes")).where(F.size("_codes") > 1)
    on = summary.where("on_list")
    stats = on.groupBy("hais_code").agg(
        *[F.sum(c).alias(f"{c}_total") for c in AMOUNTS], F.min("first_active").alias("first_period"), F.max("last_active").alias("last_period"),
        F.array_sort(F.collect_set(F.when(F.col("first_active").isNotNull(), F.col("house")))).alias("_houses"),
    )
    ref = listed.groupBy("hais_code").agg(F.min(F.struct(*[c for _, c, _ in PAIRS])).alias("r"))
    combos = rows.where("on_list").groupBy("hais_code").agg(*[F.array_sort(F.collect_set(f)).alias(f) for f, _, _ in PAIRS]).join(ref, "hais_code")
    odd = lambda f, c: F.exists(F.col(f), lambda v: v != F.col(f"r.{c}"))
    mismatch = F.concat_ws("; ", *[F.when(odd(f, c), F.concat(F.lit(f"{label}: list "), F.col(f"r.{c}"), F.lit(", financials "), F.array_join(f, ", "))) for f, c, label in PAIRS])
    mismatches = combos.select("hais_code", mismatch.alias("attr_mismatch"))
    years = on.where("actuals > 0").groupBy("hais_code", "fiscal_year").agg(*[F.sum(F.when(F.col("house") == h, F.col("actuals"))).alias(h) for h in ("HOC", "HOL")]).where("HOC > 0 AND HOL > 0")
    hoc, hol = F.col("HOC").cast("double"), F.col("HOL").cast("double")
    share = hoc / (hoc + hol) * 100
    split = years.withColumn("share", share).groupBy("hais_code").agg(
        F.round(F.max("share") - F.min("share"), 1).alias("split_range_pp"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", "share"))), lambda s: F.concat(fy_label(s["fiscal_year"]), F.lit(" "), F.round(s["share"]).cast("int").cast("string"), F.lit("%"))), " · ").alias("split_by_year"),
    )
    out = out.join(variants, "unit", "left").join(shared, "_norm", "left").join(groups, "_group", "left").join(stats, "hais_code", "left").join(mismatches, "hais_code", "left").join(split, "hais_code", "left")
    empty = F.lit("")
    return out.select(
        *listed.columns, "dup_count", "prefix_ok", "do_not_use",
        F.coalesce("unit_class_variants", empty).alias("unit_class_variants"),
        F.coalesce(F.array_join(F.array_except("_units", F.array("unit")), ", "), empty).alias("desc_dup_units"),
        F.coalesce(F.array_join("_codes", ", "), empty).alias("projgrp_desc_codes"),
        *[F.coalesce(f"{c}_total", F.lit(0)).cast("decimal(28,2)").alias(f"{c}_total") for c in AMOUNTS], "first_period", "last_period",
        F.col("first_period").isNotNull().alias("has_activity"),
        F.when(F.size("_houses") == 1, F.col("_houses")[0]).when(F.size("_houses") > 1, "Shared").otherwise("—").alias("houses"),
        F.coalesce("attr_mismatch", empty).alias("attr_mismatch"), "split_range_pp", F.coalesce("split_by_year", empty).alias("split_by_year"),
    )


def positions(summary: DataFrame, window_months: int = 3) -> DataFrame:
    """Opening position of each unit and house with activity. The extract's first and last period are one row joined to all."""
    bounds = summary.agg(F.min("first_active").alias("_first"), F.max("fiscal_year").alias("_current"))
    s = summary.crossJoin(F.broadcast(bounds))  # one row by construction
    now = lambda c: F.sum(F.when(F.col("fiscal_year") == F.col("_current"), F.col(c)).otherwise(F.lit(0).cast("decimal(28,2)")))
    out = s.groupBy("unit", "house").agg(
        F.sum("actuals").alias("spend_to_date"), F.sum("committed").alias("commitments"), F.sum("budget").alias("budget_to_date"), now("actuals").alias("current_fy_actuals"), now("budget").alias("current_fy_budget"),
        F.min("first_active").alias("first_period"), F.max("last_active").alias("last_period"), F.count_distinct(F.when(F.col("first_active").isNotNull(), F.col("hais_code"))).alias("hais_count"), F.min("_first").alias("_first"),
    ).where("first_period IS NOT NULL")
    out = out.withColumn("remaining_budget", F.col("budget_to_date") - F.col("spend_to_date"))
    out = out.withColumn("remaining_after_commitments", F.col("remaining_budget") - F.col("commitments"))
    return out.withColumn("truncated", period_index(F.col("first_period")) - period_index(F.col("_first")) < window_months).drop("_first")


def tasks(summary: DataFrame) -> DataFrame:
    """What a unit consists of: codes with activity, by house."""
    out = summary.groupBy("unit", "hais_code", "house").agg(F.sum("actuals").alias("spend_to_date"), F.sum("committed").alias("commitments"), F.sum("budget").alias("budget_to_date"), F.min("first_active").alias("first_period"), F.max("last_active").alias("last_period"))
    return out.where("first_period IS NOT NULL").withColumn("remaining_budget", F.col("budget_to_date") - F.col("spend_to_date"))


def idle_codes(listed: DataFrame, tasks: DataFrame) -> DataFrame:
    """Listed codes without activity; of several listings the least counts."""
    codes = listed.where("hais_code IS NOT NULL").groupBy("hais_code").agg(F.min(F.struct("unit", "hais_desc", "status")).alias("l")).select("hais_code", "l.*")
    return codes.join(tasks.select("hais_code").distinct(), "hais_code", "left_anti")


def history(summary: DataFrame) -> DataFrame:
    """Sums by unit, house and year with running totals."""
    run = Window.partitionBy("unit", "house").orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, 0)
    years = summary.groupBy("unit", "house", "fiscal_year").agg(F.sum("actuals").alias("actuals"), F.sum("budget").alias("budget"))
    return years.withColumn("cumulative_actuals", F.sum("actuals").over(run)).withColumn("cumulative_budget", F.sum("budget").over(run))


def commitments(rows: DataFrame) -> DataFrame:
    """Open commitments by unit, code, house and period, with their age in months at the latest period."""
    latest = rows.agg(F.max("period").alias("_latest"))
    sums = rows.groupBy("unit", "hais_code", "house", "period").agg(F.sum("committed").alias("committed")).where(F.abs("committed") >= SMALL)
    age = (period_index(F.col("_latest")) - period_index(F.col("period"))).cast("long")
    return sums.crossJoin(F.broadcast(latest)).withColumn("age_months", age).drop("_latest")


def opening_table(position: DataFrame, code_rows: DataFrame, houses=("HOC", "HOL")) -> DataFrame:
    """Every listed unit with its houses side by side and a word on its activity."""
    listed = code_rows.where("unit IS NOT NULL").groupBy("unit").agg(F.count_distinct("hais_code").alias("hais_listed"))
    of = lambda h, c: F.sum(F.when(F.col("house") == h, F.col(c))).alias(f"{h.lower()}_{c}")
    wide = position.groupBy("unit").agg(*[of(h, c) for h in houses for c in ("spend_to_date", "budget_to_date", "commitments")], F.max("last_period").alias("last_activity"), F.sum("current_fy_actuals").alias("_now"))
    signal = F.when(F.col("last_activity").isNull(), "No activity").when(F.abs("_now") >= SMALL, "Active this year").otherwise("Dormant this year")
    return listed.join(wide, "unit", "left").withColumn("signal", signal).drop("_now")


def coverage(code_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Codes by where they are, with the sums of their lines."""
    listed = code_rows.select("hais_code").distinct().withColumn("_l", F.lit(True))
    fin = rows.groupBy("hais_code").agg(F.sum("actuals").alias("actuals"), F.sum("budget").alias("budget"), F.sum("committed").alias("committed")).withColumn("_f", F.lit(True))
    where = F.when(F.col("_l").isNull(), "Financials only").when(F.col("_f").isNull(), "List only").otherwise("Both")
    zero = F.lit(0)
    return listed.join(fin, "hais_code", "full_outer").groupBy(where.alias("coverage")).agg(F.count("*").alias("codes"), *[F.coalesce(F.sum(c), zero).cast("decimal(28,2)").alias(c) for c in AMOUNTS])


def repeated_commitments(rows: DataFrame) -> DataFrame:
    """How often a code's commitment equals that of its period before, by year."""
    w = Window.partitionBy("hais_code", "house").orderBy("period")
    sums = rows.groupBy("hais_code", "house", "fiscal_year", "period").agg(F.sum("committed").alias("committed")).where(F.abs("committed") >= SMALL)
    same = F.coalesce(F.lag("committed").over(w) == F.col("committed"), F.lit(False))
    return sums.withColumn("same", same).groupBy("fiscal_year").agg(F.count("*").alias("commitments"), F.count_if("same").alias("repeated"))


def main_values(listed: DataFrame, column: str) -> DataFrame:
    """Each unit's most common value of a column, the least among equals."""
    n = listed.where(F.col("unit").isNotNull() & ~is_blank(F.col(column))).groupBy("unit", column).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("n"), column))
    return n.withColumn("_r", first).where("_r = 1").drop("_r")
