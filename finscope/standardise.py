"""Standard forms of names, postcodes and registration numbers, and the keys that records are matched on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finscope.clean import is_blank

# Spellings of company forms, and forms that a core name leaves out.
FORMS = {"LIMITED": "LTD", "AND": "&", "COMPANY": "CO", "INCORPORATED": "INC", "CORPORATION": "CORP", "PUBLIC LIMITED COMPANY": "PLC"}
ORGANISATIONS = ("LTD", "PLC", "LLP", "INC", "CORP")
LEGAL = (*ORGANISATIONS, "CO", "&")
PLACEHOLDER_ACCOUNTS = ("00000000", "0", "11111111", "99999999")


def std_name(c: Column) -> Column:
    """Upper case, no punctuation, one spelling of company forms, no leading THE."""
    plain = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "PUBLIC LIMITED COMPANY", "PLC")
    words = F.filter(F.split(F.regexp_replace(plain, "[^A-Z0-9& ]", " "), " +"), lambda w: w != "")
    mapping = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    words = F.transform(words, lambda w: F.coalesce(mapping[w], w))
    words = F.transform(F.array(words), lambda ws: F.when(F.get(ws, F.lit(0)) == "THE", F.slice(ws, 2, F.size(ws) - 1)).otherwise(ws))[0]
    return F.array_join(words, " ")


def name_core(c: Column) -> Column:
    return F.array_join(F.filter(F.split(std_name(c), " "), lambda w: ~w.isin(*LEGAL)), " ")


def is_org_name(c: Column) -> Column:
    return F.exists(F.split(std_name(c), " "), lambda w: w.isin(*ORGANISATIONS))


def std_postcode(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s", "")


std_iban = std_postcode


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def std_vat(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", ""), "^GB", "")


def std_company_no(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def match_keys(df: DataFrame) -> DataFrame:
    """df with key_bank, key_vat, key_company and key_name; null where a value can't identify anyone."""
    sort, account, vat, number, code = digits(F.col("clearing_code")), digits(F.col("bank_account")), std_vat(F.col("vat_reg_no")), std_company_no(F.col("comp_reg_no")), std_postcode(F.col("zip_code"))
    usable = (sort != "") & (account != "") & ~account.isin(*PLACEHOLDER_ACCOUNTS) & ~account.rlike("^0+$")
    bank = F.when(usable, F.concat_ws(":", sort, account)).when(std_iban(F.col("iban")) != "", std_iban(F.col("iban")))
    name = std_name(F.col("apar_name"))
    return df.withColumns({
        "key_bank": bank,
        "key_vat": F.when(vat.rlike("^([0-9]{9}|[0-9]{12})$"), vat),
        "key_company": F.when((F.length(number) >= 6) & ~number.rlike("^0+$"), number),
        "key_name": F.when(~is_blank(name) & (code != ""), F.concat_ws("@", name, code)),
    })
