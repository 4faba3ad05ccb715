"""Purchase order headers and lines."""

from __future__ import annotations

from finscope.checks.core import Check, among, blank, eq, exists, found, null, repeated, true

LIVE = among("status", "O", "N", "A")
INVOICED = "greatest(coalesce(arr_amount, 0), coalesce(invoiced, 0))"
UNINVOICED = found("apodetail", "CASE WHEN sum(amount) <> 0 THEN 100.0 * (sum(amount) - sum(" + INVOICED + ")) / sum(amount) END", house="house", client="client", order_id="order_id")
RECEIVED = f"(NOT {among('status', 'F', 'C', 'T')} AND coalesce(vow_amount, 0) > 0.01 AND {INVOICED} <= 0.01)"
HEADER_CONTRACT = found("apoheader", "min(contract_id)", house="house", client="client", order_id="order_id")
ACCOUNT_STATUS = found("aglaccounts", "min(status)", house="house", account="account")


def _header(id, dimension, severity, fails, population=f"NOT {eq('status', 'T')}"):
    return Check(id, "PO", "PO Header", dimension, severity, "apoheader", fails, population)


def _line(id, dimension, severity, fails, population="true"):
    return Check(id, "PO", "PO Line", dimension, severity, "apodetail", fails, population)


CHECKS = [
    _header("PO_DUP_HEADER", "Uniqueness", "High", repeated("client", "order_id"), "true"),
    _header("PO_NO_SUPPLIER", "Completeness", "High", blank("apar_id")),
    _header("PO_INVALID_ORDER_DATE", "Validity", "Medium", null("order_date")),
    _header("PO_FUTURE_ORDER_DATE", "Validity", "Medium", true("order_date > :as_of")),
    _header("PO_BAD_EXCH_RATE", "Validity", "Low", "coalesce(exch_rate, 0) <= 0"),
    _header("PO_STUCK_NOT_ORDERED", "Consistency", "Medium", true("order_date < :as_of - INTERVAL 1 DAY"), eq("status", "N")),
    _header("PO_FINISHED_WITH_BALANCE", "Consistency", "Medium", true(f"{UNINVOICED} > 5"), eq("status", "F")),
    _header("PO_ORPHANED_SUPPLIER", "Consistency", "High", f"NOT {blank('apar_id')} AND NOT {exists('asuheader', house='house', client='client', apar_id='apar_id')}"),
    _header("PO_INACTIVE_SUPPLIER", "Consistency", "Medium", f"coalesce({found('asuheader', 'min(status)', house='house', client='client', apar_id='apar_id')}, '') = 'C'", LIVE),
    _line("PO_LINE_NEG_AMOUNT", "Validity", "Medium", true("amount < 0"), LIVE),
    _line("PO_ARR_EXCEEDS_AMOUNT", "Validity", "Medium", "coalesce(invoiced, 0) - coalesce(amount, 0) > 0.01", LIVE),
    _line("PO_LINE_NO_CATEGORY", "Completeness", "Low", blank("art_gr_id")),
    _line("PO_DUP_LINE", "Uniqueness", "High", repeated("client", "order_id", "line_no", "sequence_no")),
    _line("PO_HDR_LINE_CONTRACT_MISMATCH", "Consistency", "Low", f"coalesce(trim(contract_id), '') <> coalesce(trim({HEADER_CONTRACT}), '')"),
    _line("PO_LINE_ORPHAN_ACCOUNT", "Consistency", "High", f"NOT {blank('account')} AND NOT {exists('aglaccounts', house='house', account='account')}"),
    _line("PO_LINE_CLOSED_ACCOUNT", "Consistency", "Medium", f"coalesce({ACCOUNT_STATUS}, 'N') <> 'N'"),
    _line("PO_LINE_INVOICED_AHEAD_OF_RECEIPT", "Consistency", "Low", "coalesce(invoiced, 0) - coalesce(vow_amount, 0) > 100", LIVE),
    _line("PO_LINE_AMENDED_VALUE_MISMATCH", "Validity", "Low", true("abs(amount - com_amount) <= 0.01"), "coalesce(amend_no, 0) > 0"),
    _line("PO_LINE_UNINVOICED_RECEIPT_OVER3M", "Consistency", "Medium", true("deliv_date <= :as_of - INTERVAL 90 DAY"), RECEIVED),
    _line("PO_LINE_VOW_CALC_MISMATCH", "Validity", "Medium", "abs(coalesce(vow_amount, 0) - coalesce(vow_val, 0) * coalesce(unit_price, 0)) > 0.01", LIVE),
]
