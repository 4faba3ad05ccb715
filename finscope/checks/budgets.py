"""Budget lines."""

from __future__ import annotations

from finscope.checks.core import Check, blank, exists, null

SAME = {"house": "house", "trim(account)": "trim(account)"}
ACCOUNT = exists("aglaccounts", **SAME)


def _line(id, dimension, severity, fails):
    return Check(id, "Budgets", "Budget Lines", dimension, severity, "budgets_report", fails)


CHECKS = [
    *[_line(id, "Completeness", severity, blank(c)) for id, severity, c in (("BUD_ACCOUNT_MISSING", "High", "account"), ("BUD_MIPCK_MISSING", "Medium", "mipck_l1"), ("BUD_HAISCODE_MISSING", "Medium", "haiscode"), ("BUD_COSTC_MISSING", "Low", "costc"))],
    _line("BUD_CURR_BUDGET_MISSING", "Completeness", "High", null("curr_budget")),
    _line("BUD_ORIG_BUDGET_MISSING", "Completeness", "Medium", null("orig_budget")),
    _line("BUD_PERIOD_INVALID", "Validity", "Medium", "coalesce(period NOT BETWEEN 1 AND 15, true)"),
    _line("BUD_ACCOUNT_ORPHAN", "Consistency", "High", f"NOT {ACCOUNT}"),
    _line("BUD_ACCOUNT_CLOSED", "Consistency", "Medium", exists("aglaccounts", "status IS DISTINCT FROM 'N'", **SAME)),
    _line("BUD_ACTUALS_NO_CURR_BUDGET", "Consistency", "Medium", "abs(coalesce(gl_actuals, 0)) > 0.01 AND abs(coalesce(curr_budget, 0)) <= 0.01"),
]
