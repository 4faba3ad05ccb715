"""General ledger: dimension values, chart of accounts, balances, budgets and journals."""

from __future__ import annotations

from finscope.checks.core import Check, among, blank, eq, exists, found, null, repeated, starts, true
from finscope.checks.payables import HOC, HOL

#: Fixed value: wording of a description that says the value is no longer used.
STALE = "do not use|closed|to be deleted|(^|[^a-z0-9_])delete([^a-z0-9_]|$)|on hold|to be closed|obsolete|decommission|deprecated|(^|[^a-z0-9_])inactive([^a-z0-9_]|$)"
ACTIVE = eq("status", "N")
ACCOUNT = exists("aglaccounts", house="house", account="account")
DIM_1 = f"NOT {blank('dim_1')} AND NOT {exists('agldimvalue', 'dim_position = ' + repr('1'), client='client', dim_value='trim(dim_1)')}"
GROUP = "coalesce(" + found("aglaccounts", "min(account_grp)", house="house", client="client", account="dim_value") + ", '')"
DESCRIBED = f"({ACTIVE} AND NOT {blank('description')})"


def _check(table, object, id, dimension, severity, fails, population="true"):
    return Check(id, "GL", object, dimension, severity, table, fails, population)


def _value(*a):
    return _check("agldimvalue", "Dimension Values", *a)


def _account(id, dimension, severity, fails, population=ACTIVE):
    return _check("aglaccounts", "Chart of Accounts", id, dimension, severity, fails, population)


def _journal(*a):
    return _check("gl_journals", "GL Journals", *a)


def _other(table, object):
    return lambda *a: _check(table, object, *a)


_balance, _budget, _attribute = _other("aglyearend", "GL Opening Balances"), _other("gl_budgets", "GL Budgets"), _other("gl_dimconfig", "Dimension Attributes")
NO_PARTY = blank("apar_id")
IN_JOURNALS = exists("gl_journals", house="house", account="account")

CHECKS = [
    _value("GL_DIM_DESC_MISSING", "Completeness", "Medium", blank("description")),
    _value("GL_DIM_STALE_DESC", "Validity", "Medium", f"coalesce(regexp_like(lower(description), '{STALE}'), false)"),
    _value("GL_DIM_PERIOD_MISSING", "Completeness", "Low", null("period_from")),
    _value("GL_DIM_PERIOD_INV", "Validity", "Medium", true("period_from > period_to")),
    _value("GL_DIM_ORPHAN_REL", "Consistency", "High", f"rel_value IS NOT NULL AND NOT {exists('agldimvalue', house='house', client='client', attribute_id='attribute_id', dim_value='rel_value')}"),
    _value("GL_DIM_SELF_REF", "Consistency", "High", f"NOT {blank('rel_value')} AND {true('rel_value = dim_value')}"),
    _value("GL_DIM_DUP", "Uniqueness", "High", repeated("client", "attribute_id", "dim_value")),
    _value("GL_DIM_DUP_DESC", "Uniqueness", "Low", repeated("client", "attribute_id", GROUP, "dim_value", "trim(description)", where=DESCRIBED)),
    # `depth` is added to the table by finscope.hierarchy.
    _value("GL_DIM_DEEP_HIERARCHY", "Consistency", "Low", true("depth >= 3")),
    _check("gl_transact_dim", "Dimension Values", "GL_DIM_POST_SUMMARY", "Consistency", "Medium", exists("agldimvalue", f"NOT {blank('rel_value')}", client="client", dim_position="dim_position", rel_value="dim_value")),
    _attribute("GL_DIM_ATTR_GL_EMPTY", "Completeness", "High", "coalesce(active, 0) = 0", among("trim(dim_position)", *"01234567")),
    _attribute("GL_DIM_ATTR_DESC_MISSING", "Completeness", "Low", blank("description")),
    _balance("GL_BAL_AMT_MISSING", "Completeness", "High", null("amount")),
    _balance("GL_BAL_ORPHAN_ACC", "Consistency", "High", f"NOT {ACCOUNT}"),
    _balance("GL_BAL_ORPHAN_DIM", "Consistency", "High", DIM_1),
    _budget("GL_BUD_AMT_MISSING", "Completeness", "High", null("amount")),
    _budget("GL_BUD_ORPHAN_ACC", "Consistency", "High", f"NOT {ACCOUNT}"),
    _budget("GL_BUD_ORPHAN_DIM", "Consistency", "High", DIM_1),
    _journal("GL_JNL_VOUCHER_MISSING", "Completeness", "Critical", null("voucher_no")),
    _journal("GL_JNL_ACCT_MISSING", "Completeness", "Critical", null("account")),
    _journal("GL_JNL_AMT_MISSING", "Completeness", "Critical", null("amount")),
    _journal("GL_JNL_USER_MISSING", "Completeness", "Medium", blank("user_id")),
    _journal("GL_JNL_DATE_FUTURE", "Validity", "Medium", true("trans_date > :as_of")),
    _journal("GL_JNL_ZR_NO_APAR", "Consistency", "Medium", f"({HOC} AND {eq('trim(voucher_type)', 'ZR')} AND {NO_PARTY}) OR ({HOL} AND {NO_PARTY})"),
    _journal("GL_JNL_DUP_KEY", "Uniqueness", "Critical", repeated("client", "voucher_no", "sequence_no")),
    _journal("GL_JNL_ACCT_ORPHAN", "Consistency", "Critical", f"NOT {ACCOUNT}"),
    _journal("GL_JNL_ACCT_CLOSED", "Consistency", "High", f"{ACCOUNT} AND NOT {exists('aglaccounts', ACTIVE, house='house', account='account')}"),
    _account("GL_ACC_DESC_MISSING", "Completeness", "Medium", blank("description")),
    _account("GL_ACC_GRP_MISSING", "Completeness", "Medium", blank("account_grp")),
    _account("GL_ACC_RESBAL_MISSING", "Completeness", "High", blank("res_bal")),
    _account("GL_ACC_RULE_MISSING", "Completeness", "Medium", blank("account_rule")),
    _account("GL_ACC_RESBAL_INVALID", "Validity", "High", f"res_bal IS NOT NULL AND NOT {among('res_bal', 'R', 'B')}"),
    _account("GL_ACC_TYPE_INVALID", "Validity", "Medium", f"account_type IS NOT NULL AND NOT {among('account_type', 'GL', 'AP', 'AR')}"),
    _account("GL_ACC_PERIOD_INV", "Validity", "Medium", true("period_from > period_to")),
    _account("GL_ACC_STALE_N", "Validity", "Low", true("period_to < :as_of")),
    _account("GL_ACC_DUP_CODE", "Uniqueness", "Critical", f"{repeated('client', 'account', 'status')} AND {ACTIVE}", "true"),
    _account("GL_ACC_NO_ACTIVITY", "Timeliness", "Low", f"({HOC} AND {starts('account', '55', '56', '57')} AND NOT {IN_JOURNALS}) OR (NOT {HOC} AND NOT {IN_JOURNALS} AND NOT {exists('gl_active_accounts', house='house', account='account')} AND NOT {exists('gl_planner_accounts', house='house', account='account')})"),
]
