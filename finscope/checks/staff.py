"""Employees and payroll."""

from __future__ import annotations

from finscope.checks.core import Check, among, blank, eq, exists, found, like, null, repeated, true

ACTIVE = eq("employment_status", "Active")
#: Fixed value: prefixes that no National Insurance number has.
NO_NI_PREFIXES = ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")


def _employee(id, dimension, severity, fails, population="true"):
    return Check(id, "Staff", "Employee Master", dimension, severity, "employee_master", fails, population)


def _pay(id, dimension, severity, fails):
    return Check(id, "Payroll", "Payroll Transactions", dimension, severity, "payroll_transactions", fails)


def own(c: str) -> str:
    return found("employee_master", f"min(trim({c}))", employee_id="employee_id")


CHECKS = [
    _employee("EMP_NI_MISSING", "Completeness", "Critical", blank("ni_number"), ACTIVE),
    _employee("EMP_NI_FORMAT", "Validity", "High", f"NOT {blank('ni_number')} AND (NOT {like('trim(ni_number)', '[A-Za-z]{2}[0-9]{6}[A-Za-z]')} OR {among('left(upper(trim(ni_number)), 2)', *NO_NI_PREFIXES)})", ACTIVE),
    _employee("EMP_BANK_MISSING", "Completeness", "Critical", f"{blank('bank_account')} OR {blank('sort_code')}", ACTIVE),
    _employee("EMP_DOB_MISSING", "Completeness", "Medium", null("dob"), ACTIVE),
    _employee("EMP_DOB_INVALID", "Validity", "Medium", true("datediff(DAY, dob, :as_of) / 365.25 < 16 OR datediff(DAY, dob, :as_of) / 365.25 > 75"), ACTIVE),
    _employee("EMP_START_AFTER_LEAVE", "Validity", "High", true("start_date > leaving_date")),
    _employee("EMP_DUP_NI", "Uniqueness", "Critical", repeated("ni_number", where=f"(NOT {blank('ni_number')})")),
    _employee("EMP_DUP_EMPID", "Uniqueness", "Critical", repeated("employee_id")),
    _employee("EMP_MANAGER_ORPHAN", "Consistency", "High", f"NOT {blank('manager_id')} AND NOT {exists('employee_master', employee_id='manager_id')}"),
    _employee("EMP_EMAIL_MISSING", "Completeness", "Low", blank("email"), ACTIVE),
    _employee("EMP_POSTCODE_FORMAT", "Validity", "Low", f"NOT {blank('postcode')} AND NOT {like('trim(postcode)', '[A-Za-z]{1,2}[0-9][A-Za-z0-9]?[ ]?[0-9][A-Za-z]{2}')}", ACTIVE),
    _employee("EMP_TAX_CODE_MISSING", "Completeness", "High", blank("tax_code"), ACTIVE),
    _pay("PAY_NET_EXCEEDS_GROSS", "Validity", "Critical", true("net_pay > gross_pay")),
    _pay("PAY_NEGATIVE_GROSS", "Validity", "High", true("gross_pay < 0")),
    _pay("PAY_MISSING_TAX_CODE", "Completeness", "High", blank("tax_code")),
    _pay("PAY_NI_CAT_MISSING", "Completeness", "High", blank("ni_category")),
    _pay("PAY_ORPHAN_EMPLOYEE", "Consistency", "High", f"NOT {exists('employee_master', employee_id='employee_id')}"),
    _pay("PAY_DUP_TRANSACTION", "Uniqueness", "Critical", repeated("employee_id", "pay_period")),
    _pay("PAY_OVERTIME_NO_HOURS", "Consistency", "Medium", f"{true('overtime_pay > 0')} AND coalesce(overtime_hours, 0) = 0"),
    _pay("PAY_GROSSNET_CALC_MISMATCH", "Validity", "Medium", true("abs(gross_pay - (tax_deducted + ni_deducted + pension_deducted + coalesce(other_deductions, 0)) - net_pay) > 1.00")),
    _pay("PAY_BANK_MISMATCH", "Consistency", "Medium", f"coalesce(bank_account IS NOT NULL AND sort_code IS NOT NULL AND (trim(bank_account) <> {own('bank_account')} OR trim(sort_code) <> {own('sort_code')}), false)"),
    _pay("PAY_ZERO_NET_ACTIVE", "Validity", "Medium", true("gross_pay > 0 AND net_pay <= 0")),
    _pay("PAY_STALE_PENDING", "Timeliness", "Medium", f"{eq('status', 'Pending')} AND {true('pay_date < :as_of - INTERVAL 7 DAY')}"),
    _pay("PAY_FUTURE_PAYDATE", "Validity", "Low", true("pay_date > :as_of")),
]
