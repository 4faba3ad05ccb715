"""Cleaning of extract columns: text, numbers, dates, periods, labels and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = ("", "nan", "None", "NaT")
#: Day 0 of spreadsheet date numbers, and the numbers that are taken for dates.
SERIAL_ZERO, SERIAL_RANGE = "1899-12-30", (20000, 2958465)


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")).isin(*BLANKS)


def clean_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~is_blank(F.col(c)), F.trim(c)) for c in columns})


def clean_number(c: Column, kind: str = "decimal(18,2)") -> Column:
    """Thousands commas and the currency are dropped; what then is no number is null."""
    return F.regexp_replace(c, r"GBP|£|,|\s", "").try_cast(kind)


def parse_date(c: Column) -> Column:
    """First token of ISO, dd/mm/yyyy or dd-mm-yyyy text, or a spreadsheet's day number; else null."""
    token = F.split(F.trim(c), r"[ T]")[0]
    number = token.try_cast("double")
    low, high = SERIAL_RANGE
    serial = F.when(number.between(low, high), F.date_add(F.to_date(F.lit(SERIAL_ZERO)), F.floor(number).cast("int")))
    written = [F.try_to_timestamp(token, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d MMM yyyy", "d-MMM-yyyy")]
    return F.when(number.isNotNull(), serial).otherwise(F.coalesce(*written))


def period_index(period: Column) -> Column:
    """YYYYPP as a running month; adjustment periods 13 to 15 count as 12."""
    return F.floor(period / 100) * 12 + F.least(period % 100, F.lit(12))


def fy_label(year: Column) -> Column:
    return F.when(year.isNull(), "—").otherwise(F.format_string("%d/%02d", year.cast("int"), ((year + 1) % 100).cast("int")))


def period_label(period: Column) -> Column:
    year = F.floor(period / 100)
    return F.when(period.isNull(), "—").otherwise(F.concat(F.lit("FY"), fy_label(year), F.format_string(" P%02d", (period % 100).cast("int"))))


def fiscal_year_of(day: Column) -> Column:
    """The year from April on, as FY2025/26."""
    year = F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)
    return F.when(day.isNotNull(), F.concat(F.lit("FY"), fy_label(year)))


def band(c: Column, edges: list, labels: list[str], right: bool = True) -> Column:
    """Label of the bin; right: a bin holds its upper edge. There is one label more than edges."""
    out = None
    for edge, label in zip(edges, labels):
        inside = (c <= edge) if right else (c < edge)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return F.when(c.isNotNull(), out.otherwise(labels[-1]))


def longest_prefix(c: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """Label of the longest key that c starts with."""
    out = None
    for prefix in sorted(labels, key=lambda p: (-len(p), p)):
        hit = F.coalesce(c.startswith(prefix), F.lit(False))
        out = F.when(hit, labels[prefix]) if out is None else out.when(hit, labels[prefix])
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def evidence_text(columns: list[str]) -> Column:
    """'name: value - name: (blank)'."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.when(~is_blank(F.col(c).cast("string")), F.col(c).cast("string")), F.lit("(blank)"))) for c in columns]
    return F.concat_ws(" - ", *parts)


def fingerprint(columns: list[str]) -> Column:
    """First twelve hex digits of a hash of the fields, which tells whether any has changed."""
    return F.substring(F.md5(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))), 1, 12)


def iso_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def age_years(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day) / F.lit(365.25)


def wide_to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "dim_position", value: str = "dim_value") -> DataFrame:
    """(keys, position from 1, value) for the columns that are filled, each once, in one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(str(i + 1)).alias(name), F.trim(c).alias(value)) for i, c in enumerate(columns)]))
    return df.select(*keys, cells.alias("cell")).select(*keys, f"cell.{name}", f"cell.{value}").where(~is_blank(F.col(value))).distinct()
