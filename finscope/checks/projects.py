"""Project codes, positions and commitments; their tables are built by finscope.positions.projects."""

from __future__ import annotations

from finscope.checks.core import Check, blank, eq, true

LISTED = eq("status", "N")


def _of(table, object):
    return lambda id, dimension, severity, fails, population="true": Check(id, "Projects", object, dimension, severity, table, fails, population)


_code, _unit, _commitment = _of("project_codes", "Project List"), _of("project_units", "Project Position"), _of("project_commitments", "Project Commitments")

CHECKS = [
    _code("PRJ_LIST_DUP_HAIS", "Uniqueness", "High", true("dup_count > 1")),
    _code("PRJ_LIST_MISSING_CLASS", "Completeness", "High", f"{blank('projcat')} OR {blank('projgrp')}"),
    _code("PRJ_LIST_HAIS_UNIT_PREFIX", "Consistency", "Medium", "NOT prefix_ok"),
    _code("PRJ_LIST_DO_NOT_USE_ACTIVE", "Validity", "Medium", "do_not_use", LISTED),
    _code("PRJ_LIST_DUP_DESC", "Uniqueness", "Low", "desc_dup_units <> ''", LISTED),
    _code("PRJ_LIST_PROJGRP_DUP_DESC", "Consistency", "Low", "projgrp_desc_codes <> ''"),
    _code("PRJ_UNIT_MULTI_CLASS", "Consistency", "High", "unit_class_variants <> ''"),
    _code("PRJ_NO_ACTIVITY", "Completeness", "Medium", "NOT has_activity"),
    _code("PRJ_ATTR_MISMATCH", "Consistency", "Medium", "attr_mismatch <> ''", "has_activity"),
    _code("PRJ_SPLIT_INCONSISTENT", "Consistency", "Low", true("split_range_pp > 5"), "split_by_year <> ''"),
    _unit("PRJ_NO_BUDGET", "Completeness", "Medium", "abs(current_fy_budget) < 0.005", "abs(current_fy_actuals) >= 0.005"),
    _unit("PRJ_OVERSPEND", "Consistency", "Medium", "spend_to_date > budget_to_date * 1.05 AND spend_to_date - budget_to_date > 1000", "budget_to_date > 0.005"),
    _unit("PRJ_NEG_SPEND_TO_DATE", "Validity", "Medium", "spend_to_date < -0.005"),
    _unit("PRJ_HISTORY_TRUNCATED", "Completeness", "Low", "truncated"),
    _commitment("PRJ_STALE_COMMITMENT", "Consistency", "Medium", "age_months > 12"),
    _commitment("PRJ_NEG_COMMITMENT", "Validity", "Low", "committed < -0.005"),
    _commitment("PRJ_RESIDUAL_COMMITMENT", "Validity", "Low", "committed > 0 AND committed < 5"),
]
