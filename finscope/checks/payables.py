"""Suppliers, open payables and their history."""

from __future__ import annotations

from finscope.checks.core import Check, among, blank, eq, exists, found, like, null, repeated, starts, true

# Fixed values of the two houses and their ledger.
HOC_CLIENTS, HOL_CLIENTS = ("CA", "CM"), ("LA",)
CREDIT_NOTES = ("CN", "IC", "IN", "RC")
PEOPLE = ("ME", "WI", "EM", "IR", "PY", "TI", "TO", "SC")
COMPANY_PEOPLE = ("EM", "ME", "WI", "IR", "PY", "SC", "SA")
POSTCODE_GB = "[A-Z]{1,2}[0-9][A-Z0-9]?[ ]?[0-9][A-Z]{2}"
FIVE_DIGIT_COUNTRIES = ("DE", "FR", "IT", "ES", "BE", "AT", "CH", "PT", "SE", "NO", "DK", "FI", "PL", "LU", "HU", "CZ", "SK", "SI", "HR", "RO", "BG")
# Prefixes of company numbers that six digits follow.
COMPANY_PREFIXES = (
    "OC", "SO", "NC", "SC", "NI", "LP", "SL", "NL", "FC", "SF", "NF", "RC", "SR", "NR",
    "ZC", "SZ", "NZ", "IP", "SP", "NP", "RS", "GE", "GS", "GN", "SE", "ES", "CE", "CS",
    "AC", "SA", "NA", "IC", "SI", "NV", "OE", "FE", "SG",
)

HOC, HOL = eq("house", "HOC"), eq("house", "HOL")
CLIENT = f"(({HOC} AND {among('client', *HOC_CLIENTS)}) OR ({HOL} AND {among('client', *HOL_CLIENTS)}))"
MASTER = f"({CLIENT} AND (({HOL} AND {eq('status', 'N')}) OR ({HOC} AND NOT {eq('status', 'C')} AND NOT {starts('apar_id', '89', '99')} AND NOT {eq('upper(trim(apar_name))', 'SZSINGLES')})))"
OPEN = f"({CLIENT} AND NOT {eq('status', 'C')})"


def filled(c: str, least: int = 2) -> str:
    return f"(coalesce(length(trim({c})), 0) >= {least})"


def company_number(c: str) -> str:
    n = f"upper(replace({c}, ' ', ''))"
    return f"({like(n, '[0-9]{8}')} OR {like(n, f"({'|'.join(COMPANY_PREFIXES)})[0-9]{{6}}")} OR {like(n, '(RS|IP|SP|NP)[0-9]{4,5}[A-Z]{1,3}')} OR {like(n, 'R[0-9]{7}')})"


def vat_number(c: str) -> str:
    return like(f"replace({c}, ' ', '')", "(GB)?[0-9]{9}")


def zip_code() -> str:
    z = "trim(zip_code)"
    fits = f"""({eq('country_code', 'GB')} AND {like(f'upper({z})', POSTCODE_GB)}) OR ({eq('country_code', 'US')} AND {like(z, '[0-9]{5}(-[0-9]{4})?')})
      OR ({among('country_code', *FIVE_DIGIT_COUNTRIES)} AND {like(z, '[0-9]{4,5}')}) OR ({eq('country_code', 'NL')} AND {like(f'upper({z})', '[0-9]{4}[ ]?[A-Z]{2}')})
      OR ({eq('country_code', 'IE')} AND {like(f'upper({z})', '[A-Z0-9]{3}[ ]?[A-Z0-9]{4}')})"""
    return f"{filled('zip_code', 1)} AND {among('country_code', 'GB', 'US', 'NL', 'IE', *FIVE_DIGIT_COUNTRIES)} AND NOT ({fits})"


def _supplier(id, dimension, severity, fails):
    return Check(id, "AP", "Suppliers", dimension, severity, "asuheader", fails, MASTER)


def _open(id, dimension, severity, fails):
    return Check(id, "AP", "AP Invoices", dimension, severity, "asutrans", fails, OPEN)


def _history(id, dimension, severity, fails):
    return Check(id, "AP", "AP History", dimension, severity, "asuhistr", fails, CLIENT)


STAFF_IDS = f"({HOC} AND {starts('apar_id', '71', '74', '1000')})"
LORDS_IDS = f"({HOL} AND {starts('apar_id', '1', '2', '3')})"
FOREIGN = "NOT " + eq("currency", "GBP")
ROUTED_ELSEWHERE = f"({HOC} AND {starts('apar_id', '1000', '741')})"
NO_ADDRESS = f"({HOC} AND {starts('apar_id', '1000', '74')})"

CHECKS = [
    _supplier("SUP_VAT_MISSING", "Completeness", "Medium", f"vat_reg_no IS NULL AND NOT {eq('pay_method', 'FC')} AND NOT {STAFF_IDS} AND NOT ({HOC} AND {among('apar_gr_id', *PEOPLE, 'SA')}) AND NOT {LORDS_IDS}"),
    _supplier("SUP_SA_VAT_MISSING", "Completeness", "Low", f"{eq('apar_gr_id', 'SA')} AND vat_reg_no IS NULL"),
    _supplier("SUP_COMP_REG_MISSING", "Completeness", "Low", f"comp_reg_no IS NULL AND NOT ({HOC} AND ({among('apar_gr_id', *COMPANY_PEOPLE)} OR {starts('apar_id', '71', '74', '89', '1000')})) AND NOT {LORDS_IDS}"),
    _supplier("SUP_SA_COMP_REG_MISSING", "Completeness", "Low", f"{eq('apar_gr_id', 'SA')} AND comp_reg_no IS NULL"),
    _supplier("SUP_TERMS_MISSING", "Completeness", "High", null("terms_id")),
    _supplier("SUP_PAY_METHOD_MISSING", "Completeness", "Critical", null("pay_method")),
    _supplier("SUP_CURRENCY_MISSING", "Completeness", "Critical", null("currency")),
    _supplier("SUP_BANK_MISSING", "Completeness", "Critical", null("bank_account")),
    _supplier("SUP_SORT_IBAN_MISSING", "Completeness", "Critical", f"clearing_code IS NULL AND iban IS NULL AND NOT {eq('pay_method', 'CH')} AND NOT {ROUTED_ELSEWHERE} AND NOT ({HOL} AND {among('upper(trim(pay_method))', 'PO', 'BB', 'CC')})"),
    _supplier("SUP_SWIFT_MISSING", "Completeness", "High", f"swift IS NULL AND iban IS NOT NULL AND NOT ({HOL} AND clearing_code IS NOT NULL)"),
    _supplier("SUP_ADDR_MISSING", "Completeness", "Low", f"NOT {filled('address', 1)} AND NOT {NO_ADDRESS}"),
    _supplier("SUP_PLACE_MISSING", "Completeness", "Low", f"NOT {filled('place', 1)} AND NOT {NO_ADDRESS}"),
    _supplier("SUP_ZIP_MISSING", "Completeness", "Low", f"NOT {filled('zip_code', 1)} AND NOT {NO_ADDRESS} AND NOT {eq('pay_method', 'FC')}"),
    _supplier("SUP_VAT_FORMAT", "Validity", "High", f"vat_reg_no IS NOT NULL AND NOT {vat_number('vat_reg_no')} AND NOT {eq('pay_method', 'FC')} AND NOT {STAFF_IDS} AND NOT ({HOC} AND {among('apar_gr_id', *PEOPLE)})"),
    _supplier("SUP_COMP_REG_FORMAT", "Validity", "Medium", f"comp_reg_no IS NOT NULL AND NOT {company_number('comp_reg_no')} AND NOT ({HOC} AND {starts('apar_id', '71', '74', '89', '1000')})"),
    _supplier("SUP_SORT_FORMAT", "Validity", "High", f"clearing_code IS NOT NULL AND NOT {like('clearing_code', '[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{6}|[0-9]-[0-9]{2}-[0-9]{2}|[0-9]{5}')}"),
    _supplier("SUP_BANK_FORMAT", "Validity", "Critical", f"bank_account IS NOT NULL AND NOT {like('bank_account', '[0-9]{1,8}')}"),
    _supplier("SUP_SWIFT_FORMAT", "Validity", "High", f"swift IS NOT NULL AND NOT {like('swift', '[A-Z0-9]{8,11}')}"),
    _supplier("SUP_ZIP_FORMAT", "Validity", "Medium", zip_code()),
    _supplier("SUP_BACS_NO_BANK", "Consistency", "Critical", f"{among('pay_method', 'IP', 'CP', 'BB')} AND (bank_account IS NULL OR clearing_code IS NULL) AND NOT {ROUTED_ELSEWHERE}"),
    _supplier("SUP_INT_NO_IBAN", "Consistency", "Critical", f"{among('pay_method', 'IN', 'EU', 'TF', 'RT')} AND iban IS NULL"),
    _supplier("SUP_NAME_DUP", "Uniqueness", "Medium", f"{repeated('client', 'apar_name', 'address', 'zip_code', where=MASTER + ' AND ' + filled('apar_name'))}"),
    _supplier("SUP_NAME_DUP_ANY", "Uniqueness", "Low", f"{repeated('client', 'apar_name', where=MASTER + ' AND ' + filled('apar_name'))}"),
    _supplier("SUP_VAT_DUP", "Uniqueness", "High", repeated("client", "vat_reg_no", where=f"{MASTER} AND {filled('vat_reg_no')}")),
    _supplier("SUP_BANK_SORT_DUP", "Uniqueness", "High", repeated("client", "bank_account", "clearing_code", where=f"{MASTER} AND {filled('bank_account')} AND {filled('clearing_code')}")),
    _supplier("SUP_BANK_DUP", "Uniqueness", "High", repeated("client", "bank_account", "clearing_code", "vat_reg_no", where=f"{MASTER} AND {filled('bank_account')} AND {filled('clearing_code')} AND {filled('vat_reg_no')}")),
    _supplier("SUP_CLIENT_APAR_DUP", "Uniqueness", "Critical", repeated("client", "apar_id", where=MASTER)),
    _supplier("SUP_DORMANT", "Timeliness", "Medium", f"NOT {exists('asutrans', house='house', apar_id='apar_id')} AND NOT {exists('asuhistr', 'trans_date >= :as_of - INTERVAL 548 DAY', house='house', apar_id='apar_id')} AND NOT {starts('apar_id', '1000')} AND NOT ({HOC} AND {starts('apar_id', '71')}) AND NOT ({HOC} AND {eq('apar_gr_id', 'SC')}) AND NOT ({HOL} AND {starts('apar_id', '3')})"),
    _supplier("SUP_SUNDRY", "Validity", "Low", eq("apar_once", "Y")),
    _open("AP_DUE_DATE_MISSING", "Completeness", "High", null("due_date")),
    _open("AP_EXT_REF_MISSING", "Completeness", "Critical", f"ext_inv_ref IS NULL AND NOT ({HOC} AND {eq('trim(voucher_no)', '10048531')})"),
    _open("AP_AMOUNT_MISSING", "Completeness", "Critical", null("amount")),
    _open("AP_PO_CONTRACT_MISSING", "Completeness", "Medium", "order_id IS NULL AND contract_id IS NULL"),
    _open("AP_FX_NO_RATE", "Completeness", "High", f"{FOREIGN} AND exch_rate IS NULL"),
    _open("AP_CN_NO_REF", "Completeness", "Medium", f"{among('voucher_type', *CREDIT_NOTES)} AND orig_reference IS NULL"),
    _open("AP_FX_NO_CUR_AMT", "Validity", "High", f"{FOREIGN} AND cur_amount IS NULL"),
    _open("AP_REST_ZERO", "Consistency", "Medium", true("rest_amount = 0")),
    _open("AP_REST_OVER_AMT", "Consistency", "High", true("abs(rest_amount) > abs(amount) + 0.01")),
    _open("AP_TRANS_KEY_DUP", "Uniqueness", "Critical", repeated("client", "apar_id", "voucher_no", "sequence_no", where=OPEN)),
    _open("AP_EXT_REF_DUP", "Uniqueness", "High", repeated("apar_id", "ext_inv_ref", where=f"{OPEN} AND ext_inv_ref IS NOT NULL")),
    _open("AP_ORPHANED_TRANS", "Referential Integrity", "Critical", f"NOT {exists('asuheader', apar_id='apar_id')}"),
    _open("AP_TRANS_SUP_CLOSED", "Referential Integrity", "Critical", f"coalesce({found('asuheader', 'min(CASE WHEN status = ' + chr(39) + 'C' + chr(39) + ' THEN 1 ELSE 0 END)', house='house', apar_id='apar_id')}, 0) = 1"),
    _history("HIS_REST_NOT_ZERO", "Consistency", "High", "coalesce(rest_amount <> 0, true)"),
    _history("HIS_DATE_MISSING", "Completeness", "Critical", null("trans_date")),
    _history("HIS_CN_NO_REF", "Completeness", "Medium", f"{among('voucher_type', *CREDIT_NOTES)} AND orig_reference IS NULL"),
    _history("HIS_DUP", "Uniqueness", "High", repeated("voucher_no", "sequence_no", where=CLIENT)),
    _history("HIS_ORPHANED", "Referential Integrity", "Medium", f"NOT {exists('asuheader', apar_id='apar_id')}"),
]
