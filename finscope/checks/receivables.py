"""Customers, open receivables and their history."""

from __future__ import annotations

from finscope.checks.core import Check, among, blank, eq, exists, found, null, repeated, true
from finscope.checks.payables import CLIENT, CREDIT_NOTES, FOREIGN, HOC, HOL, OPEN, company_number, filled, vat_number

INVOICES = f"(({HOC} AND {among('voucher_type', 'SI', 'SC', 'BA', 'BC', 'BD', 'BG', 'BH', 'BP', 'BS')}) OR ({HOL} AND {among('voucher_type', 'DR', 'RI', 'EI', 'MI')}))"


def _customer(id, dimension, severity, fails):
    return Check(id, "AR", "Customers", dimension, severity, "acuheader", fails, OPEN)


def _open(id, dimension, severity, fails, population=OPEN):
    return Check(id, "AR", "AR Invoices", dimension, severity, "acutrans", fails, population)


def _history(id, dimension, severity, fails):
    return Check(id, "AR", "AR History", dimension, severity, "acuhistr", fails, CLIENT)


REF_POPULATION = f"({OPEN} AND NOT {HOL})"

CHECKS = [
    _customer("CUS_TERMS_MISSING", "Completeness", "High", null("terms_id")),
    _customer("CUS_PAY_METHOD_MISSING", "Completeness", "Critical", null("pay_method")),
    _customer("CUS_CURRENCY_MISSING", "Completeness", "Critical", null("currency")),
    _customer("CUS_CREDIT_LIMIT_MISSING", "Completeness", "Medium", null("credit_limit")),
    _customer("CUS_CREDIT_NONZERO", "Validity", "Low", "coalesce(credit_limit, 0) <> 0"),
    _customer("CUS_VAT_FORMAT", "Validity", "Medium", f"{filled('vat_reg_no', 1)} AND NOT {eq('trim(vat_reg_no)', '0')} AND NOT {vat_number('vat_reg_no')}"),
    _customer("CUS_COMP_REG_FORMAT", "Validity", "Medium", f"{filled('comp_reg_no', 1)} AND NOT {eq('trim(comp_reg_no)', '0')} AND NOT {company_number('comp_reg_no')}"),
    _customer("CUS_EXPIRED_ACTIVE", "Consistency", "Medium", f"expired_date IS NOT NULL AND {eq('status', 'N')}"),
    _customer("CUS_COLLECT_ACTIVE", "Consistency", "High", true("collect_flag = 1")),
    _customer("CUS_PARENT_ORPHAN", "Consistency", "Medium", f"NOT {blank('main_apar_id')} AND NOT {exists('acuheader', apar_id='trim(main_apar_id)')}"),
    _customer("CUS_NAME_DUP", "Uniqueness", "Medium", f"{repeated('apar_name', where=OPEN + ' AND ' + filled('apar_name'))} AND NOT ({HOL} AND {eq('upper(trim(apar_name))', 'ALLOCATED')})"),
    _customer("CUS_CLIENT_APAR_DUP", "Uniqueness", "Critical", repeated("client", "apar_id", where=OPEN)),
    _customer("CUS_DORMANT", "Timeliness", "Medium", f"NOT {exists('acutrans', house='house', apar_id='apar_id')} AND NOT {exists('acuhistr', 'trans_date >= :as_of - INTERVAL 548 DAY', house='house', apar_id='apar_id')}"),
    _open("AR_DUE_DATE_MISSING", "Completeness", "High", null("due_date")),
    _open("AR_EXT_REF_MISSING", "Completeness", "High", null("ext_inv_ref")),
    _open("AR_AMOUNT_MISSING", "Completeness", "Critical", null("amount")),
    _open("AR_ORDER_CONTRACT_MISSING", "Completeness", "Medium", "order_id IS NULL AND contract_id IS NULL"),
    _open("AR_FX_NO_RATE", "Completeness", "High", f"{FOREIGN} AND exch_rate IS NULL"),
    _open("AR_CN_NO_REF", "Completeness", "Medium", f"{among('voucher_type', *CREDIT_NOTES)} AND orig_reference IS NULL"),
    _open("CUS_INTRULE_MISSING", "Completeness", "Medium", blank("intrule_id")),
    _open("AR_FX_NO_CUR_AMT", "Validity", "High", f"{FOREIGN} AND cur_amount IS NULL"),
    _open("AR_NEG_INV", "Validity", "Medium", f"{true('amount < 0')} AND {INVOICES} AND NOT {exists('acuhistr', 'amount > 0', apar_id='apar_id', house='house', voucher_no='voucher_no')}"),
    _open("AR_REST_ZERO", "Consistency", "Medium", true("rest_amount = 0")),
    _open("AR_REST_OVER_AMT", "Consistency", "High", true("abs(rest_amount) > abs(amount) + 0.01")),
    _open("AR_NET_NEG_BAL", "Consistency", "Medium", f"coalesce({found('acutrans', 'sum(rest_amount)', OPEN, house='house', apar_id='apar_id')} < 0, false)"),
    _open("AR_HIGH_REMINDER", "Timeliness", "High", true("rem_level >= 3")),
    _open("AR_OVERDUE", "Timeliness", "Medium", true("due_date < :as_of")),
    _open("AR_TRANS_KEY_DUP", "Uniqueness", "Critical", repeated("client", "apar_id", "voucher_no", "sequence_no", where=OPEN)),
    _open("AR_EXT_REF_DUP", "Uniqueness", "High", f"NOT {blank('ext_inv_ref')} AND NOT {eq('trim(ext_inv_ref)', '0')} AND coalesce({found('acutrans', 'count(DISTINCT voucher_no)', REF_POPULATION, house='house', apar_id='apar_id', ext_inv_ref='ext_inv_ref')}, 0) > 1", REF_POPULATION),
    _open("AR_ORPHANED_TRANS", "Referential Integrity", "Critical", f"NOT {exists('acuheader', apar_id='apar_id')}"),
    _open("AR_TRANS_CUS_CLOSED", "Referential Integrity", "Critical", exists("acuheader", "status = 'C'", apar_id="apar_id")),
    _history("AR_HIS_REST_NOT_ZERO", "Consistency", "High", "coalesce(rest_amount <> 0, true)"),
    _history("AR_HIS_DATE_MISSING", "Completeness", "Critical", null("trans_date")),
    _history("AR_HIS_CN_NO_REF", "Completeness", "Medium", f"{among('voucher_type', *CREDIT_NOTES)} AND orig_reference IS NULL"),
    _history("AR_HIS_DUP", "Uniqueness", "High", repeated("voucher_no", "sequence_no", where=CLIENT)),
    _history("AR_HIS_ORPHANED", "Referential Integrity", "Medium", f"NOT {exists('acuheader', apar_id='apar_id')}"),
]
