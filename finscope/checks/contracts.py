"""Contracts of the contract system against commitments and spend of the ledger."""

from __future__ import annotations

from finscope.checks.core import Check, among, blank, eq, exists, found, null, repeated, true

#: Checks that look at open contracts only, where the list of open contracts is loaded.
OPEN_ID, OPEN_REF = (f"({found('unit4_open_contracts', if_missing='1', u4_contract_id=c)} IS NOT NULL)" for c in ("trim(u4_contract_id)", "trim(contract_ref)"))


def _of(table, object):
    return lambda id, dimension, severity, fails, population="true": Check(id, "Contracts", object, dimension, severity, table, fails, population)


_contract, _supplier = _of("atamis_contracts", "Atamis Contract"), _of("atamis_suppliers", "Atamis Supplier")
_commitment, _spend = _of("unit4_commitments", "Contract Commitment"), _of("unit4_spend", "Contract Spend")


def commitment(value: str) -> str:
    return found("unit4_commitments", value, f"NOT {blank('u4_contract_id')}", u4_contract_id="contract_ref")


AWARD = commitment("min(award_amount)")
VAT = f"(abs(total_award_value - {AWARD} * 1.2) <= greatest(abs(total_award_value) * 0.005, 1.0) OR abs({AWARD} - total_award_value * 1.2) <= greatest(abs(total_award_value) * 0.005, 1.0))"
COMMITTED = found("unit4_spend", "sum(amount_c)", f"NOT {blank('u4_contract_id')}", **{"trim(u4_contract_id)": "trim(u4_contract_id)"})
ORDERED = found("apodetail", "sum(coalesce(invoiced, 0))", f"NOT {blank('contract_id')}", **{"trim(contract_id)": "trim(u4_contract_id)"})
POSTED = found("unit4_commitments", "min(posted_amount)", u4_contract_id="u4_contract_id")

CHECKS = [
    _contract("ATAMIS_CONTRACT_NO_REF", "Completeness", "Medium", blank("contract_ref")),
    _contract("ATAMIS_CONTRACT_NO_SUPPLIER", "Completeness", "Low", blank("supplier_name")),
    _contract("ATAMIS_CONTRACT_NO_DATES", "Completeness", "Medium", "start_date IS NULL OR end_date IS NULL"),
    _contract("ATAMIS_CONTRACT_ORG_INVALID", "Validity", "Low", f"NOT {among('upper(trim(organisation))', 'HOC', 'HOL', 'JOINT')}"),
    _contract("ATAMIS_CONTRACT_DATE_INVALID", "Validity", "Medium", true("end_date < start_date")),
    _contract("ATAMIS_CONTRACT_DUP_REF", "Uniqueness", "High", repeated("contract_ref", where=f"(NOT {blank('contract_ref')})")),
    _contract("ATAMIS_CONTRACT_REF_NOT_IN_PO", "Consistency", "Medium", f"coalesce({found('apodetail', **{'trim(contract_id)': 'trim(contract_ref)'})}, 0) = 0", f"{eq('house', 'HOC')} AND NOT {blank('contract_ref')}"),
    _contract("ATAMIS_CONTRACT_NOT_IN_COMMITMENTS", "Consistency", "Medium", f"coalesce({found('unit4_contract_refs', **{'trim(u4_contract_id)': 'trim(contract_ref)'})}, 0) = 0", f"NOT {blank('contract_ref')} AND {OPEN_REF}"),
    _contract("ATAMIS_CONTRACT_VALUE_MISMATCH", "Consistency", "Medium", f"coalesce(abs(total_award_value - {AWARD}) > greatest(abs(total_award_value) * 0.02, 1.0) AND NOT {VAT}, false)"),
    _contract("ATAMIS_CONTRACT_DATE_MISMATCH", "Consistency", "Medium", f"coalesce(start_date <> {commitment('min(date_from)')}, false) OR coalesce(end_date <> {commitment('min(date_to)')}, false)"),
    _supplier("ATAMIS_SUPPLIER_NO_CREDITOR_REF", "Completeness", "High", blank("creditor_ref")),
    _supplier("ATAMIS_SUPPLIER_DUP_CREDITOR_REF", "Uniqueness", "Medium", repeated("creditor_ref", where=f"(NOT {blank('creditor_ref')})")),
    # These three are reported once, under the house Unknown, over every row with an id; house.existence makes the tables.
    _of("atamis_suppliers_existence", "Atamis Supplier")("ATAMIS_SUPPLIER_NOT_IN_UNIT4", "Consistency", "High", "derived_house = 'Unknown'"),
    _commitment("UNIT4_COMMIT_NO_SUPPLIER_ID", "Completeness", "High", blank("supplier_id"), OPEN_ID),
    _commitment("UNIT4_COMMIT_DATE_INVALID", "Validity", "Medium", true("date_to < date_from"), OPEN_ID),
    _commitment("UNIT4_COMMIT_REMAINING_MISMATCH", "Validity", "Medium", f"coalesce(abs(coalesce(amount_limit, 0) - {COMMITTED} - coalesce(remaining_amount, 0)) > 1.0, false)", OPEN_ID),
    _commitment("UNIT4_COMMIT_OVERSPEND", "Consistency", "Medium", "coalesce(remaining_amount, 0) < -1.0", OPEN_ID),
    _commitment("UNIT4_COMMIT_DUP_ID", "Uniqueness", "High", repeated("u4_contract_id", where=f"(NOT {blank('u4_contract_id')} AND {OPEN_ID})"), OPEN_ID),
    _of("unit4_commitments_existence", "Contract Commitment")("UNIT4_COMMIT_SUPPLIER_ORPHAN", "Consistency", "High", "derived_house = 'Unknown'", OPEN_ID),
    _of("unit4_contract_refs", "Contract Commitment")("UNIT4_COMMIT_NOT_IN_CONTRACTS", "Consistency", "High", f"coalesce({found('atamis_contracts', **{'trim(contract_ref)': 'trim(u4_contract_id)'})}, 0) = 0", f"NOT {blank('u4_contract_id')} AND {OPEN_ID}"),
    _commitment("UNIT4_COMMIT_VS_PO_MISMATCH", "Consistency", "Medium", f"coalesce(abs(posted_amount - {ORDERED}) > greatest(abs(posted_amount) * 0.02, 1.0), false)", OPEN_ID),
    _of("unit4_spend_existence", "Contract Spend")("UNIT4_SPEND_CONTRACT_ORPHAN", "Consistency", "High", "derived_house = 'Unknown'", OPEN_ID),
    _spend("UNIT4_SPEND_NEGATIVE_POSTED", "Validity", "Low", "coalesce(posted, 0) < 0", OPEN_ID),
    _spend("UNIT4_COMMIT_VS_SPEND_MISMATCH", "Consistency", "Medium", f"coalesce(abs({POSTED} - posted) > 1.0, false)", OPEN_ID),
]
