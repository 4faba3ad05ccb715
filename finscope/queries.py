"""The registered queries of the finance jobs, each over the whole tables, and their DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from finscope import bindings, extracts, hierarchy, house, io, scores
from finscope.bindings import AS_OF
from finscope.checks import CATALOGUE, core, evidence, oracle
from finscope.migration import decisions, pipeline
from finscope.positions import aging, money, nbv, orders, project_extract, projects

BUILT = ("asset_nbv", "project_codes", "project_units", "project_commitments")
PLAIN = [c for c in CATALOGUE if c.table not in BUILT and c.id != "GL_DIM_DEEP_HIERARCHY"]
DAY = f"DATE '{AS_OF}'"

#: Amounts of each query, which both engines return as doubles.
MONEY = {
    "evidence_ap_trans_sup_closed": "rest_amount", "aging_ap": "outstanding", "aging_ar": "outstanding", "volumes_ap": "balance", "volumes_ar": "balance", "status_split_ap": "balance", "status_split_ar": "balance",
    "po_status_summary": "ordered invoiced received open_commitment", "po_fulfilment": "received_not_invoiced not_received", "po_resolution_mix": "released", "po_age_bands": "value", "po_spend_by_category": "ordered invoiced", "po_top_suppliers": "ordered", "po_contract_leakage": "tagged untagged", "po_leakage_detail": "contract_tagged tagged untagged total_award_value", "volumes_opening": "debit_total credit_total",
    "nbv_books": "cost depreciation reserve other nbv net_all_accounts", "nbv_assets": "curr_nbv hist_nbv reval_reserve reval_variance", "nbv_bands": "curr_nbv", "nbv_account_detail": "amount",
    "project_positions": "spend_to_date commitments budget_to_date current_fy_actuals current_fy_budget remaining_budget remaining_after_commitments", "project_history": "actuals budget cumulative_actuals cumulative_budget", "project_commitments": "committed", "project_coverage": "actuals budget committed",
    "project_codes": "actuals_total budget_total committed_total", "contract_metrics": "value", "budget_kpis": "gl_actuals orig_budget curr_budget live_forecast virement remaining forecast_variance", "budget_top_account_desc": "gl_actuals curr_budget", "budget_top_haiscode": "gl_actuals curr_budget", "budget_by_period": "gl_actuals curr_budget",
    "payroll_metrics": "gross_pay tax_deducted ni_deducted pension_deducted other_deductions net_pay overtime_pay", "migration_items": "balance",
    "overview": "ap_balance ar_balance", "open_figures_ap": "ap_balance", "open_figures_ar": "ar_balance", "open_split_status_ap": "balance", "open_split_pay_flag_ar": "balance", "extract_asset_balances": "total_amount", "extract_asset_flags": "amount", "extract_budget_versions": "orig_budget po_commitment",
    "project_tasks": "spend_to_date commitments budget_to_date remaining_budget", "project_opening": "hoc_spend_to_date hoc_budget_to_date hoc_commitments hol_spend_to_date hol_budget_to_date hol_commitments", "extract_opening_balances": "amount", "profile_budgets": "total",
}

#: Queries that make so much of each customer that its rows go to all tasks.
DEALT = "migration_position migration_funnel migration_decided migration_reasons migration_possible_duplicates migration_name_classes migration_changes near_supplier_names".split()
#: Days, which both engines return as text.
DAYS = {"migration_activity": "last_invoice last_order last_activity", "migration_items": "trans_date", "extract_recent_history": "trans_date", "profile_first_entries": "earliest", "migration_position": "last_activity", "overview": "suppliers_date customers_date ap_date ar_date", "open_figures_ap": "ap_date", "open_figures_ar": "ar_date", "extract_supplier_master": "last_trans_date", "extract_asset_balances": "max_trans_date min_trans_date", "extract_asset_flags": "trans_date", "extract_order_lines": "order_date", "extract_asset_master": "date_from"}

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, tables, query, sql: str | None = None, made: dict[str, str] | None = None) -> None:
    """query: from the frames named to the result; sql: over the same tables, and those `made` from them by SQL."""
    dealt = ("customer",) if name in DEALT else ()
    amounts, days = MONEY.get(name, "").split(), DAYS.get(name, "").split()
    kinds = dict.fromkeys(amounts, "double") | dict.fromkeys(days, "string")
    _QUERIES[name] = lambda spark, sf_dir: query(bindings.frames(spark, sf_dir, set(tables), dealt)).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    if sql and kinds:
        sql = f"SELECT * REPLACE ({', '.join([*(f'{c}::DOUBLE AS {c}' for c in amounts), *(f'{c}::DATE::VARCHAR AS {c}' for c in days)])}) FROM ({sql})"
    if sql:
        _SQL[name] = bindings.with_tables(tables, sql, made)


def _checks(name: str, checks: list[core.Check]) -> None:
    tables = {c.table for c in checks} | core.needs(checks)
    _QUERIES[name] = lambda spark, sf_dir: core.run_checks(bindings.frames(spark, sf_dir, tables), checks, AS_OF)
    _SQL[name] = oracle.results_sql(checks, AS_OF)


for _table in dict.fromkeys(c.table for c in PLAIN):
    _checks(f"checks_{_table}", [c for c in PLAIN if c.table == _table])


# Evidence and scores


def _evidence(check_id: str, columns: list[str]) -> None:
    check = next(c for c in PLAIN if c.id == check_id)
    tables = {check.table} | core.needs([check])
    where = oracle._in_place(f"({check.population}) AND ({check.fails})", "t", AS_OF)
    sql = f"SELECT {', '.join(columns)} FROM (SELECT *, coalesce({where}, false) AS bad FROM {check.table}) WHERE bad"
    _add(f"evidence_{check_id.lower()}", tables, lambda f: core.failing_rows(f, check, AS_OF).select(*columns), sql)


_evidence("SUP_BANK_SORT_DUP", ["house", "client", "apar_id", "bank_account", "clearing_code"])
_evidence("GL_JNL_ACCT_ORPHAN", ["house", "client", "voucher_no", "sequence_no", "account"])
_evidence("AP_TRANS_SUP_CLOSED", ["house", "apar_id", "voucher_no", "rest_amount"])
_evidence("PO_FINISHED_WITH_BALANCE", ["client", "order_id", "apar_id"])

_orphans = next(c for c in PLAIN if c.id == "AP_ORPHANED_TRANS")
_add("orphan_summary", {"asutrans", "asuheader"}, lambda f: core.failing_rows(f, _orphans, AS_OF).groupBy("house", "apar_id").agg(F.count("*").alias("orphans")), f"""
SELECT house, apar_id, count(*) AS orphans FROM asutrans WHERE {_orphans.population} AND apar_id NOT IN (SELECT apar_id FROM asuheader) GROUP BY house, apar_id""")
_closed = next(c for c in PLAIN if c.id == "PO_INACTIVE_SUPPLIER")
_add("evidence_enriched", {"apoheader", "asuheader"}, lambda f: core.enrich(core.failing_rows(f, _closed, AS_OF).select("house", "client", "order_id", "apar_id"), f["asuheader"].select("house", "client", "apar_id", "apar_name", "status"), {"house": "house", "client": "client", "apar_id": "apar_id"}, "sup_").select("client", "order_id", "apar_id", "sup_apar_name", "sup_status"), f"""
SELECT h.client, h.order_id, h.apar_id, s.n AS sup_apar_name, s.s AS sup_status FROM apoheader h JOIN (SELECT house, client, apar_id, min(status) AS s0, min({{'a': apar_name, 'b': status}}).a AS n, min({{'a': apar_name, 'b': status}}).b AS s FROM asuheader GROUP BY ALL) s USING (house, client, apar_id)
WHERE h.status IN ('O', 'N', 'A') AND s.s0 = 'C'""")

_SCORED = [c for c in PLAIN if c.domain in ("AP", "AR")]
_SCORED_TABLES = {c.table for c in _SCORED} | core.needs(_SCORED)


def _scored(name: str, use, sql: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: use(core.run_checks(bindings.frames(spark, sf_dir, _SCORED_TABLES), _SCORED, AS_OF))
    _SQL[name] = f"SELECT * FROM ({oracle.results_sql(_SCORED, AS_OF)}) r" if not sql else f"WITH r AS ({oracle.results_sql(_SCORED, AS_OF)}) {sql}"


_scored("score_by_dimension", lambda r: scores.score_by(r, "dimension", "house"), "SELECT dimension, house, sum(passing)::BIGINT AS passing, sum(total)::BIGINT AS total, round_even(sum(passing) * 100.0::DOUBLE / sum(total), 2) AS score FROM r GROUP BY dimension, house")
_scored("score_matrix", scores.score_matrix, """SELECT domain, round_even(sum(passing) FILTER (house = 'HOC') * 100.0::DOUBLE / sum(total) FILTER (house = 'HOC'), 2) AS score_hoc, round_even(sum(passing) FILTER (house = 'HOL') * 100.0::DOUBLE / sum(total) FILTER (house = 'HOL'), 2) AS score_hol,
  count(*) FILTER (rag = 'Red') AS red, count(*) FILTER (rag = 'Amber') AS amber, count(*) FILTER (rag = 'Green') AS green FROM r GROUP BY domain""")
_scored("risk_matrix", scores.risk_matrix, "SELECT severity, count(*) FILTER (rag = 'Red') AS red, count(*) FILTER (rag = 'Amber') AS amber FROM r WHERE rag <> 'Green' GROUP BY severity")
_scored("score_means", scores.means, "SELECT domain, dimension, " + ", ".join(f"round_even(sum(round({c} * 10, 0)::BIGINT)::BIGINT::DOUBLE * 1000 / count(*), 0) / 10000 AS mean_{c}" for c in ("pass_rate", "error_rate")) + " FROM r GROUP BY domain, dimension")
_scored("scorecard", scores.scorecard, "SELECT house, count(*) AS checks, " + ", ".join(f"count(*) FILTER (rag = '{c}') AS {c.lower()}" for c in scores.RAGS) + ", " + ", ".join(f"count(*) FILTER (severity = '{s}' AND failing > 0) AS failing_{s.lower()}" for s in scores.SEVERITIES) + " FROM r GROUP BY house")
_scored("report_summary", scores.summary, "SELECT count(DISTINCT check_id) AS checks, count(DISTINCT check_id) FILTER (failing > 0) AS checks_failing, count(DISTINCT check_id) FILTER (failing > 0 AND severity = 'Critical') AS critical_failing FROM r")
_scored("tracker", lambda r: io.tracker(r, house="HOC"), "SELECT check_id, domain, object, dimension, severity, CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END AS severity_rank, house, total, failing, error_rate, rag, '' AS owner, '' AS comment, '' AS resolved_on FROM r WHERE failing > 0 AND house = 'HOC'")


# Aged balances and volumes

_BUCKET = "CASE WHEN d <= -1 THEN 'Not Yet Due' WHEN d <= 30 THEN '0-30 Days' WHEN d <= 60 THEN '31-60 Days' WHEN d <= 90 THEN '61-90 Days' WHEN d <= 180 THEN '91-180 Days' ELSE '180+ Days' END"
for _kind, _t, _m, _h in (("ap", "asutrans", "asuheader", "asuhistr"), ("ar", "acutrans", "acuheader", "acuhistr")):
    _add(f"aging_{_kind}", {_t}, lambda f, t=_t: aging.aging(f[t], AS_OF), f"SELECT house, {_BUCKET} AS bucket, count(*) AS items, sum(abs(rest_amount)) AS outstanding FROM (SELECT *, {DAY} - due_date AS d FROM {_t} WHERE status IN ('N', 'R', 'I') AND due_date IS NOT NULL) GROUP BY 1, 2")
    _add(f"volumes_{_kind}", {_t, _m, _h}, lambda f, t=_t, m=_m, h=_h: aging.ledger_volumes(f[m], f[t], f[h], AS_OF), f"""
SELECT m.house, masters, active, closed, coalesce(closed_but_recent, 0) AS closed_but_recent, open_items, overdue_items, balance, history_items FROM
(SELECT house, count(*) AS masters, count(*) FILTER (status = 'N') AS active, count(*) FILTER (status = 'C') AS closed FROM {_m} GROUP BY house) m
LEFT JOIN (SELECT house, count(DISTINCT apar_id) AS closed_but_recent FROM {_m} WHERE status = 'C' AND (house, apar_id) IN (SELECT (house, apar_id) FROM {_h} WHERE trans_date >= {DAY} - 548) GROUP BY house) c USING (house)
LEFT JOIN (SELECT house, count(*) AS open_items, count(*) FILTER (due_date < {DAY}) AS overdue_items, coalesce(sum(rest_amount), 0)::DECIMAL(28, 2) AS balance FROM {_t} WHERE status IS DISTINCT FROM 'C' GROUP BY house) o USING (house)
LEFT JOIN (SELECT house, count(*) AS history_items FROM {_h} GROUP BY house) h USING (house)""")
    _add(f"status_split_{_kind}", {_t}, lambda f, t=_t: aging.status_split(f[t]), f"SELECT house, status, count(*) AS items, sum(rest_amount)::DECIMAL(28, 2) AS balance FROM {_t} GROUP BY house, status")
_add("volumes_opening", {"aglyearend"}, lambda f: aging.debit_credit(f["aglyearend"]), "SELECT house, count(*) AS lines, count(*) FILTER (dc_flag = 1) AS debits, count(*) FILTER (dc_flag = -1) AS credits, coalesce(sum(amount) FILTER (dc_flag = 1), 0) AS debit_total, abs(coalesce(sum(amount) FILTER (dc_flag = -1), 0)) AS credit_total FROM aglyearend GROUP BY house")
_add("volumes_gl", {"gl_journals"}, lambda f: aging.ledger_profile(f["gl_journals"]), "SELECT house, count(*) AS lines, count(DISTINCT voucher_no) AS vouchers, count(DISTINCT user_id) AS users, count(DISTINCT voucher_type) AS voucher_types, min(period) AS first_period, max(period) AS last_period FROM gl_journals GROUP BY house")
_add("volumes_assets", {"asset_master"}, lambda f: aging.asset_volumes(f["asset_master"], AS_OF), f"SELECT house, status, count(*) AS assets, count(*) FILTER (grant_flag = 1) AS grants, count(*) FILTER (last_update < {DAY} - INTERVAL 36 MONTH) AS stale, count(DISTINCT asset_group) AS groups FROM asset_master GROUP BY house, status")



def _open_sql(table: str, statuses, name: str) -> str:
    is_open = f"status IN {statuses}"
    return f"""SELECT house, count(*) AS {name}_items, count(*) FILTER ({is_open}) AS {name}_open, coalesce(sum(rest_amount) FILTER ({is_open}), 0)::DECIMAL(28, 2) AS {name}_balance, count(*) FILTER ({is_open} AND due_date < {DAY}) AS {name}_overdue,
 (sum({DAY} - trans_date) FILTER ({is_open}))::BIGINT::DOUBLE / count(trans_date) FILTER ({is_open}) AS {name}_mean_age, max(trans_date) AS {name}_date FROM {table} GROUP BY house"""


for _name, _t, _s in (("ap", "asutrans", aging.OPEN_AP), ("ar", "acutrans", aging.OPEN_AR)):
    _add(f"open_figures_{_name}", {_t}, lambda f, t=_t, s=_s, n=_name: aging.open_figures(f[t], s, AS_OF, n), _open_sql(_t, _s, _name))
_masters_sql = lambda t, n: f"(SELECT house, count(*) AS {n}_total, count(*) FILTER (status = 'N') AS {n}_active, count(*) FILTER (status = 'C') AS {n}_inactive, max(last_update) AS {n}_date FROM {t} GROUP BY house)"
_add("overview", {"asuheader", "acuheader", "asutrans", "acutrans"}, lambda f: aging.overview(f["asuheader"], f["acuheader"], f["asutrans"], f["acutrans"], AS_OF), f"""SELECT * EXCLUDE (ap_items, ar_items, ap_mean_age, ar_mean_age) FROM {_masters_sql("asuheader", "suppliers")} FULL JOIN {_masters_sql("acuheader", "customers")} USING (house) FULL JOIN ({_open_sql("asutrans", aging.OPEN_AP, "ap")}) USING (house) FULL JOIN ({_open_sql("acutrans", aging.OPEN_AR, "ar")}) USING (house)""")
for _name, _t, _s, _c in (("status_ap", "asutrans", aging.OPEN_AP, "status"), ("pay_flag_ar", "acutrans", aging.OPEN_AR, "pay_flag")):
    _add(f"open_split_{_name}", {_t}, lambda f, t=_t, s=_s, c=_c: aging.open_split(f[t], s, c), f"SELECT house, {_c}, count(*) AS items, coalesce(sum(rest_amount), 0)::DECIMAL(28, 2) AS balance FROM {_t} WHERE status IN {_s} AND {_c} IS NOT NULL GROUP BY ALL")
_ONE_GROUP = "(SELECT house, min({'a': grp_status, 'b': depr_method}) AS g FROM asset_groups GROUP BY house, asset_group)"
_add("asset_intro", {"asset_master", "asset_depreciation", "asset_groups", "asset_balances", "asset_trans_flags"}, lambda f: aging.asset_intro(f["asset_master"], f["asset_depreciation"], f["asset_groups"], f["asset_balances"], f["asset_trans_flags"]), f"""
SELECT * FROM (SELECT house, 'master' AS section, status AS name, count(*) AS n FROM asset_master GROUP BY ALL UNION ALL SELECT house, 'group status', g.a, count(*) FROM {_ONE_GROUP} GROUP BY ALL UNION ALL SELECT house, 'group method', g.b, count(*) FROM {_ONE_GROUP} GROUP BY ALL
UNION ALL SELECT house, 'book status', status, count(*) FROM asset_depreciation GROUP BY ALL UNION ALL SELECT house, 'book method', depr_method, count(*) FROM asset_depreciation GROUP BY ALL
UNION ALL SELECT house, 'books', 'several', count(*) FROM (SELECT house, asset_id FROM asset_depreciation GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL
UNION ALL SELECT house, 'transactions', CASE WHEN trans_type IN {aging.CONFIRMED_TYPES} THEN 'confirmed ' ELSE 'unknown ' END || trans_type, sum(transaction_count)::BIGINT FROM asset_balances WHERE trans_type IN {aging.CONFIRMED_TYPES + aging.UNKNOWN_TYPES} GROUP BY ALL
UNION ALL SELECT house, 'flags', trans_type, count(*) FROM asset_trans_flags WHERE trans_type IN ('CA', 'SA') GROUP BY ALL) WHERE name IS NOT NULL""")
_add("dimension_structure", {"gl_dimconfig"}, lambda f: aging.dimension_structure(f["gl_dimconfig"]), """SELECT house, CASE WHEN trim(dim_position) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 'GL dimensions' ELSE 'Out of scope' END AS scope,
 CASE WHEN trim(dim_position) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN coalesce(description, '') WHEN trim(dim_position) = 'X' THEN 'X-position' ELSE 'Other' END AS label, CASE WHEN trim(dim_position) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN attribute_id END AS attribute_id_,
 count(DISTINCT attribute_id) AS attributes, sum(active)::BIGINT AS active, sum(closed)::BIGINT AS closed FROM gl_dimconfig GROUP BY 1, 2, 3, 4""".replace("SELECT house", "SELECT * RENAME (attribute_id_ AS attribute_id) FROM (SELECT house", 1) + ")")

# Purchase orders

_INV = "greatest(coalesce(arr_amount, 0), coalesce(invoiced, 0))"
_HL = {"apoheader", "apodetail"}
_add("po_status_summary", _HL, lambda f: orders.status_summary(f["apoheader"], f["apodetail"]), f"""SELECT status, coalesce(orders, 0) AS orders, coalesce(ordered, 0) AS ordered, coalesce(inv, 0) AS invoiced, coalesce(received, 0) AS received,
CASE WHEN status IN ('O', 'N', 'A') THEN greatest(coalesce(ordered, 0) - coalesce(inv, 0), 0) ELSE 0 END::DECIMAL(28, 2) AS open_commitment
FROM (SELECT status, count(DISTINCT (client, order_id)) AS orders FROM apoheader GROUP BY status) h FULL JOIN (SELECT status, sum(coalesce(amount, 0)) AS ordered, sum({_INV}) AS inv, sum(coalesce(vow_amount, 0)) AS received FROM apodetail GROUP BY status) l USING (status)""")
_add("po_fulfilment", {"apodetail"}, lambda f: orders.fulfilment(f["apodetail"]), f"SELECT CASE WHEN status IN ('O', 'N', 'A') THEN 'live' ELSE 'resolved' END AS state, sum(greatest(coalesce(vow_amount, 0) - {_INV}, 0)) AS received_not_invoiced, sum(greatest(coalesce(amount, 0) - coalesce(vow_amount, 0), 0)) AS not_received, count(*) AS lines FROM apodetail GROUP BY 1")
_VALUE = f"(SELECT client, order_id, sum(coalesce(amount, 0)) AS value, sum({_INV}) AS inv, count(*) FILTER (coalesce(trim(account), '') = '') AS na FROM apodetail GROUP BY client, order_id)"
_add("po_resolution_mix", _HL, lambda f: orders.resolution_mix(f["apoheader"], f["apodetail"]), f"SELECT status, count(*) AS orders, count(*) FILTER (coalesce(value - inv, 0) <= 0) AS clean, sum(greatest(coalesce(value - inv, 0), 0))::DECIMAL(28, 2) AS released FROM (SELECT DISTINCT client, order_id, status FROM apoheader WHERE status IN ('F', 'C', 'T')) LEFT JOIN {_VALUE} USING (client, order_id) GROUP BY status")
_add("po_status_mismatch", _HL, lambda f: orders.status_mismatch(f["apoheader"], f["apodetail"]), "SELECT header_status, status AS line_status, count(*) AS lines FROM apodetail JOIN (SELECT client, order_id, min(status) AS header_status FROM apoheader GROUP BY ALL) USING (client, order_id) WHERE status <> header_status GROUP BY ALL")
_add("po_age_bands", _HL, lambda f: orders.age_bands(f["apoheader"], f["apodetail"], AS_OF), f"SELECT CASE WHEN d <= 30 THEN '0-30 days' WHEN d <= 90 THEN '31-90 days' WHEN d <= 180 THEN '91-180 days' WHEN d <= 365 THEN '181-365 days' ELSE 'Over 1 year' END AS age, count(*) AS orders, coalesce(sum(value), 0)::DECIMAL(28, 2) AS value FROM (SELECT client, order_id, {DAY} - min(order_date) AS d FROM apoheader WHERE status IN ('O', 'N', 'A') AND order_date IS NOT NULL GROUP BY ALL) LEFT JOIN {_VALUE} USING (client, order_id) GROUP BY 1")
_add("po_spend_by_category", {"apodetail"}, lambda f: orders.spend_by_category(f["apodetail"]), f"SELECT coalesce(art_gr_description, '(none)') AS category, sum(coalesce(amount, 0)) AS ordered, sum({_INV}) AS invoiced, count(*) AS lines FROM apodetail GROUP BY 1")
_add("po_top_suppliers", {"apodetail", "asuheader"}, lambda f: orders.top_suppliers(f["apodetail"], f["asuheader"]), "SELECT apar_id, apar_name, ordered, orders FROM (SELECT apar_id, sum(coalesce(amount, 0)) AS ordered, count(DISTINCT order_id) AS orders FROM apodetail GROUP BY apar_id ORDER BY ordered DESC, apar_id LIMIT 15) LEFT JOIN (SELECT apar_id, min(apar_name) AS apar_name FROM asuheader GROUP BY apar_id) USING (apar_id)")
_add("po_amendments", {"apoheader"}, lambda f: orders.amendment_profile(f["apoheader"]), "SELECT CASE WHEN coalesce(amend_no, 0) <= 0 THEN 'None' WHEN amend_no <= 1 THEN '1' WHEN amend_no <= 3 THEN '2-3' ELSE '4+' END AS amendments, count(*) AS orders FROM apoheader GROUP BY 1")
_add("po_policy_signals", _HL, lambda f: orders.policy_signals(f["apoheader"], f["apodetail"]), f"SELECT count(*) AS orders, count(*) FILTER (value < 5000) AS small, count(*) FILTER (coalesce(trim(contract_id), '') = '') AS no_contract, count(*) FILTER (coalesce(trim(responsible), '') = '') AS no_responsible, count(*) FILTER (na > 0) AS no_account FROM apoheader LEFT JOIN {_VALUE} USING (client, order_id) WHERE status IN ('O', 'N', 'A')")
_add("po_contract_leakage", {"apodetail"}, lambda f: orders.contract_leakage(f["apodetail"]), "SELECT * FROM (SELECT apar_id, sum(CASE WHEN coalesce(trim(contract_id), '') <> '' THEN coalesce(amount, 0) ELSE 0 END) AS tagged, sum(CASE WHEN coalesce(trim(contract_id), '') = '' THEN coalesce(amount, 0) ELSE 0 END) AS untagged, count(DISTINCT trim(contract_id)) AS contracts FROM apodetail GROUP BY apar_id) WHERE tagged > 0 AND untagged > 0")

_add("po_leakage_detail", {"apodetail", "atamis_contracts", "asuheader"}, lambda f: orders.leakage_detail(f["apodetail"], f["atamis_contracts"], f["asuheader"]), """SELECT * REPLACE (coalesce(apar_name, apar_id) AS apar_name), untagged::DOUBLE / (tagged + untagged)::DOUBLE * 100 AS untagged_pct FROM
(SELECT apar_id, trim(contract_id) AS contract_ref, sum(coalesce(amount, 0)) AS contract_tagged FROM apodetail WHERE coalesce(trim(contract_id), '') <> '' GROUP BY ALL) JOIN (SELECT apar_id, coalesce(sum(amount) FILTER (coalesce(trim(contract_id), '') <> ''), 0) AS tagged, coalesce(sum(amount) FILTER (coalesce(trim(contract_id), '') = ''), 0) AS untagged FROM apodetail GROUP BY apar_id) USING (apar_id)
LEFT JOIN (SELECT trim(contract_ref) AS contract_ref, min(total_award_value) AS total_award_value FROM atamis_contracts WHERE coalesce(trim(contract_ref), '') <> '' GROUP BY 1) USING (contract_ref) LEFT JOIN (SELECT apar_id, min(apar_name) AS apar_name FROM asuheader GROUP BY 1) USING (apar_id) WHERE tagged > 0 AND untagged > 0""")

# Net book value

_NBV = {"asset_balances", "asset_depreciation", "asset_master"}
_ACC = "regexp_replace(trim(account), '\\.0+$', '')"
_CLASS = f"CASE WHEN {_ACC} LIKE '1%00' THEN 'cost' WHEN {_ACC} LIKE '1%15' THEN 'depreciation' WHEN {_ACC} = '70000' THEN 'reserve' ELSE 'other' END"
_BOOK_SQL = f"""SELECT house, client, asset_id, depr_book_id, sum(amt) FILTER (k = 'cost') AS c, sum(amt) FILTER (k = 'depreciation') AS d, coalesce(sum(amt) FILTER (k = 'cost'), 0) AS cost, coalesce(sum(amt) FILTER (k = 'depreciation'), 0) AS depreciation, coalesce(sum(amt) FILTER (k = 'reserve'), 0) AS reserve, coalesce(sum(amt) FILTER (k = 'other'), 0) AS other,
 sum(amt) AS net_all_accounts, bool_or(k IN ('cost', 'depreciation')) AS has_nbv_account, bool_or(trans_type = 'SA' AND k IN ('cost', 'depreciation') AND abs(amt) >= 1) AS has_disposal, bool_or(trans_type = 'OS') AS has_os, bool_or(trans_type IN ('CA', 'PC')) AS has_ca, array_to_string(list_sort(list_distinct(list(trans_type))), ', ') AS trans_types
 FROM (SELECT *, {_CLASS} AS k, coalesce(total_amount, 0)::DECIMAL(28, 2) AS amt FROM asset_balances WHERE house = 'HOC') GROUP BY house, client, asset_id, depr_book_id"""
_add("nbv_books", _NBV, lambda f: nbv.books(f["asset_balances"], f["asset_depreciation"]).select("client", "asset_id", "depr_book_id", "cost", "depreciation", "reserve", "other", "nbv", "net_all_accounts", "trans_types", "has_nbv_account", "has_disposal", "has_os", "has_ca"), f"SELECT client, asset_id, depr_book_id, cost, depreciation, reserve, other, cost + depreciation AS nbv, net_all_accounts, trans_types, has_nbv_account, has_disposal, has_os, has_ca FROM ({_BOOK_SQL})")
_ASSET_SQL = f"""SELECT client, asset_id, sum(cost + depreciation) FILTER (depr_book_id = 'CURR') AS curr_nbv, sum(cost + depreciation) FILTER (depr_book_id = 'HIST') AS hist_nbv, bool_or(depr_book_id = 'CURR') AS has_curr, bool_or(depr_book_id = 'HIST') AS has_hist, -sum(reserve) AS reval_reserve,
 CASE WHEN bool_or(depr_book_id = 'CURR') AND bool_or(depr_book_id = 'HIST') THEN -sum(reserve) - (coalesce(sum(cost + depreciation) FILTER (depr_book_id = 'CURR'), 0) - coalesce(sum(cost + depreciation) FILTER (depr_book_id = 'HIST'), 0)) END AS reval_variance,
 CASE WHEN bool_or(has_os) AND NOT bool_or(has_ca) THEN 'Migrated (OS)' WHEN bool_or(has_os) THEN 'Migrated + Unit4 additions' ELSE 'Capitalised in Unit4' END AS origin FROM ({_BOOK_SQL}) GROUP BY client, asset_id"""
_nbv = lambda f: nbv.assets(f["asset_balances"], f["asset_depreciation"], f["asset_master"])
_add("nbv_assets", _NBV, lambda f: _nbv(f).select("client", "asset_id", "curr_nbv", "hist_nbv", "has_curr", "has_hist", "reval_reserve", "reval_variance", "origin"), _ASSET_SQL)
_OF_BOOKS = ", ".join(f"sum({x}) FILTER (depr_book_id = '{b}') AS {b.lower()}_{c}" for b in nbv.BOOKS for c, x in (("cost", "cost"), ("depreciation", "depreciation"), ("nbv", "cost + depreciation"), ("net_all_accounts", "net_all_accounts")))
_VALUELESS = " AND ".join(f"abs(coalesce({b}_{c}, 0)) < 0.005" for b in ("curr", "hist") for c in ("cost", "depreciation"))
_ASSET_ROWS = f"""SELECT a.*, status, reval_reserve - expected AS reval_variance, n.asset_id IS NOT NULL AND {_VALUELESS} AS not_capitalised FROM (
 SELECT *, CASE WHEN has_curr AND has_hist THEN coalesce(curr_nbv, 0) - coalesce(hist_nbv, 0) END AS expected, CASE WHEN has_os AND NOT has_ca THEN 'Migrated (OS)' WHEN has_os THEN 'Migrated + Unit4 additions' ELSE 'Capitalised in Unit4' END AS origin FROM (
 SELECT b.house, b.client, b.asset_id, {_OF_BOOKS}, bool_or(depr_book_id = 'CURR') AS has_curr, bool_or(depr_book_id = 'HIST') AS has_hist, -sum(reserve) AS reval_reserve, bool_or(has_nbv_account) AS has_nbv_account, bool_or(has_disposal) AS has_disposal, bool_or(has_os) AS has_os, bool_or(has_ca) AS has_ca, min(depr_method) FILTER (depr_book_id = 'CURR') AS curr_depr_method
 FROM ({_BOOK_SQL}) b LEFT JOIN (SELECT client, asset_id, depr_book_id, depr_method FROM asset_depreciation WHERE house = 'HOC' QUALIFY row_number() OVER (PARTITION BY client, asset_id, depr_book_id ORDER BY depr_method NULLS FIRST, lifetime NULLS FIRST, status NULLS FIRST) = 1) d USING (client, asset_id, depr_book_id) GROUP BY ALL)) a
LEFT JOIN (SELECT client, asset_id, status FROM asset_master WHERE house = 'HOC' QUALIFY row_number() OVER (PARTITION BY client, asset_id ORDER BY description NULLS FIRST, asset_group NULLS FIRST, status NULLS FIRST, cap_date_from NULLS FIRST, org_amount NULLS FIRST) = 1) m ON m.client = a.client AND m.asset_id = a.asset_id
LEFT JOIN (SELECT asset_id FROM asset_balances WHERE house = 'HOC' AND trans_type = 'CA' GROUP BY asset_id HAVING bool_and(coalesce(abs(total_amount) < 0.005, false))) n ON n.asset_id = a.asset_id"""
_add("nbv_bands", _NBV, lambda f: nbv.band_chart(_nbv(f)), f"""
SELECT CASE WHEN v <= -1 THEN 'Negative' WHEN abs(v) < 1 THEN 'Nil' WHEN v < 1000 THEN 'Under £1k' WHEN v < 10000 THEN '£1k – £10k' WHEN v < 100000 THEN '£10k – £100k' WHEN v < 1000000 THEN '£100k – £1m' ELSE 'Over £1m' END AS nbv_band, origin, count(*) AS assets, sum(curr_nbv) AS curr_nbv
FROM (SELECT *, coalesce(curr_nbv, 0) AS v FROM ({_ASSET_ROWS})) WHERE status = 'N' AND NOT not_capitalised GROUP BY 1, 2""")
_add("nbv_account_detail", {"asset_balances", "aglaccounts"}, lambda f: nbv.account_detail(f["asset_balances"], f["aglaccounts"]), f"""SELECT a.account, client, asset_id, amount, transactions, account_name, class FROM (SELECT client, asset_id, {_ACC} AS account, {_CLASS} AS class, sum(total_amount) AS amount, sum(transaction_count)::BIGINT AS transactions FROM asset_balances WHERE house = 'HOC' GROUP BY ALL) a LEFT JOIN (SELECT account, min(description) AS account_name FROM aglaccounts WHERE house = 'HOC' GROUP BY account) n USING (account)""")


def _built_checks(name: str, table: str, tables, build, sql: str) -> None:
    """Checks on a table that a job builds; `sql` makes the same one in DuckDB."""
    own = [c for c in CATALOGUE if c.table == table]
    _add(name, set(tables) | core.needs(own), lambda f: core.run_checks(f | {table: build(f)}, own, AS_OF))
    _SQL[name] = oracle.results_sql(own, AS_OF, tables, {table: sql})


_built_checks("checks_asset_nbv", "asset_nbv", _NBV, _nbv, _ASSET_ROWS)

# Hierarchy

_DEPTH = [c for c in CATALOGUE if c.id == "GL_DIM_DEEP_HIERARCHY"]
_depth = lambda f: hierarchy.with_depth(f["agldimvalue"], ["client", "attribute_id"], "dim_value", "rel_value")
_TREE = {
    "n": "SELECT client AS c, attribute_id AS a, dim_value AS v, coalesce(trim(rel_value), '') AS p FROM agldimvalue",
    "tree": "SELECT c, a, v, 1 AS depth FROM n WHERE p = '' UNION SELECT n.c, n.a, n.v, t.depth + 1 FROM n JOIN tree t ON n.c = t.c AND n.a = t.a AND n.p = t.v WHERE n.p <> '' AND t.depth < 100",
    "deep": "SELECT agldimvalue.*, coalesce(d, 1)::INT AS depth FROM agldimvalue LEFT JOIN (SELECT c, a, v, min(depth) AS d FROM tree GROUP BY c, a, v) x ON client = c AND attribute_id = a AND dim_value = v",
}
_add("hierarchy_depth", {"agldimvalue"}, lambda f: _depth(f).select("client", "attribute_id", "dim_value", "rel_value", "depth"), "SELECT client, attribute_id, dim_value, rel_value, depth FROM deep", _TREE)
_add("checks_hierarchy", {"agldimvalue"}, lambda f: core.run_checks({"agldimvalue": _depth(f)}, _DEPTH, AS_OF))
_SQL["checks_hierarchy"] = oracle.results_sql([replace(c, table="deep") for c in _DEPTH], AS_OF, {"agldimvalue"}, _TREE)

# Projects

_PRJ = {"project_list", "project_financials"}


def _project(f):
    rows = projects.lines(f["project_list"], f["project_financials"])
    return rows, projects.summarise(rows)


_FIRST = "(SELECT hais_code, min(unit) AS lu FROM project_list WHERE hais_code IS NOT NULL GROUP BY hais_code)"
_LINES = f"(SELECT f.*, l.lu IS NOT NULL AS on_list, coalesce(l.lu, f.unit) AS u FROM project_financials f LEFT JOIN {_FIRST} l USING (hais_code))"
_ACT = "abs(actuals) >= 0.005 OR abs(budget) >= 0.005 OR abs(committed) >= 0.005"
_POSITIONS = f"""SELECT u AS unit, house, sum(actuals) AS spend_to_date, sum(committed) AS commitments, sum(budget) AS budget_to_date, sum(CASE WHEN fiscal_year = (SELECT max(fiscal_year) FROM project_financials) THEN actuals ELSE 0 END) AS current_fy_actuals, sum(CASE WHEN fiscal_year = (SELECT max(fiscal_year) FROM project_financials) THEN budget ELSE 0 END) AS current_fy_budget,
 min(period) FILTER ({_ACT}) AS first_period, max(period) FILTER ({_ACT}) AS last_period, count(DISTINCT hais_code) FILTER ({_ACT}) AS hais_count, sum(budget) - sum(actuals) AS remaining_budget, sum(budget) - sum(actuals) - sum(committed) AS remaining_after_commitments
FROM {_LINES} GROUP BY u, house HAVING min(period) FILTER ({_ACT}) IS NOT NULL"""
_add("project_positions", _PRJ, lambda f: projects.positions(_project(f)[1]).select("unit", "house", "spend_to_date", "commitments", "budget_to_date", "current_fy_actuals", "current_fy_budget", "first_period", "last_period", "hais_count", "remaining_budget", "remaining_after_commitments"), _POSITIONS)
_add("project_history", _PRJ, lambda f: projects.history(_project(f)[1]), f"SELECT u AS unit, house, fiscal_year, a AS actuals, b AS budget, sum(a) OVER w AS cumulative_actuals, sum(b) OVER w AS cumulative_budget FROM (SELECT u, house, fiscal_year, sum(actuals) AS a, sum(budget) AS b FROM {_LINES} GROUP BY ALL) WINDOW w AS (PARTITION BY u, house ORDER BY fiscal_year ROWS UNBOUNDED PRECEDING)")
_PI = lambda p: f"({p} // 100 * 12 + least({p} % 100, 12))"
_COMMITMENTS = f"SELECT u AS unit, hais_code, house, period, sum(committed) AS committed, ({_PI('(SELECT max(period) FROM project_financials)')} - {_PI('period')})::BIGINT AS age_months FROM {_LINES} GROUP BY u, hais_code, house, period HAVING abs(sum(committed)) >= 0.005"
_add("project_commitments", _PRJ, lambda f: projects.commitments(_project(f)[0]), _COMMITMENTS)
_add("project_coverage", _PRJ, lambda f: projects.coverage(f["project_list"], _project(f)[0]), """SELECT CASE WHEN l.hais_code IS NULL THEN 'Financials only' WHEN f.hais_code IS NULL THEN 'List only' ELSE 'Both' END AS coverage, count(*) AS codes, coalesce(sum(a), 0)::DECIMAL(28, 2) AS actuals, coalesce(sum(b), 0)::DECIMAL(28, 2) AS budget, coalesce(sum(c), 0)::DECIMAL(28, 2) AS committed
FROM (SELECT DISTINCT hais_code FROM project_list) l FULL JOIN (SELECT hais_code, sum(actuals) AS a, sum(budget) AS b, sum(committed) AS c FROM project_financials GROUP BY 1) f ON l.hais_code = f.hais_code GROUP BY 1""")
_add("project_repeats", _PRJ, lambda f: projects.repeated_commitments(_project(f)[0]), """SELECT fiscal_year, count(*) AS commitments, count(*) FILTER (same) AS repeated FROM (SELECT fiscal_year, coalesce(lag(c) OVER (PARTITION BY hais_code, house ORDER BY period) = c, false) AS same FROM (SELECT hais_code, house, fiscal_year, period, sum(committed) AS c FROM project_financials GROUP BY ALL HAVING abs(sum(committed)) >= 0.005)) GROUP BY 1""")
_add("project_main_values", {"project_list"}, lambda f: projects.main_values(f["project_list"], "projcat"), "SELECT unit, projcat, n FROM (SELECT unit, projcat, count(*) AS n FROM project_list WHERE coalesce(trim(projcat), '') <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, projcat) = 1")


def _codes(f):
    rows, summary = _project(f)
    return projects.codes(f["project_list"], rows, summary)


_LISTED = """SELECT *, count(*) OVER (PARTITION BY hais_code) AS dup_count, coalesce(hais_code <> '' AND unit <> '' AND starts_with(hais_code, unit), false) AS prefix_ok, contains(upper(coalesce(hais_desc, '') || ' ' || coalesce(unit_desc, '')), 'DO NOT USE') AND status = 'N' AS do_not_use,
 trim(regexp_replace(upper(coalesce(hais_desc, '')), '^DO NOT USE\\s*-?\\s*', '')) AS norm, upper(coalesce(projgrp_desc, '')) AS grp FROM project_list"""
_all_of = lambda c: f"string_agg(DISTINCT {c}, ', ' ORDER BY {c})"
_VARIANTS = "concat_ws('; ', " + ", ".join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{label}: ' || {_all_of(c)} END" for c, label in projects.CLASSES) + ")"
_MISMATCH = "concat_ws('; ', " + ", ".join(f"CASE WHEN bool_or(f.{c} <> r.{c}) THEN '{label}: list ' || min(r.{c}) || ', financials ' || {_all_of('f.' + c)} END" for _, c, label in projects.PAIRS) + ")"
_REF = ", ".join(c for _, c, _ in projects.PAIRS)
_CODES = f"""SELECT o.* EXCLUDE (norm, grp), coalesce(class_variants, '') AS unit_class_variants, coalesce(array_to_string(list_filter(units, lambda x: x <> o.unit), ', '), '') AS desc_dup_units, coalesce(codes, '') AS projgrp_desc_codes, coalesce(a, 0) AS actuals_total, coalesce(b, 0) AS budget_total, coalesce(c, 0) AS committed_total,
 first_period, last_period, first_period IS NOT NULL AS has_activity, CASE WHEN len(hs) = 1 THEN hs[1] WHEN len(hs) > 1 THEN 'Shared' ELSE '—' END AS houses, coalesce(mismatch, '') AS attr_mismatch, split_range_pp, coalesce(by_year, '') AS split_by_year FROM ({_LISTED}) o
LEFT JOIN (SELECT unit, {_VARIANTS} AS class_variants FROM project_list GROUP BY unit) v ON v.unit = o.unit
LEFT JOIN (SELECT norm, list(DISTINCT unit ORDER BY unit) AS units FROM ({_LISTED}) WHERE status = 'N' AND unit IS NOT NULL AND norm <> '' GROUP BY norm HAVING count(DISTINCT unit) > 1) s ON s.norm = o.norm
LEFT JOIN (SELECT grp, {_all_of('projgrp')} AS codes FROM ({_LISTED}) WHERE projgrp IS NOT NULL GROUP BY grp HAVING count(DISTINCT projgrp) > 1) g ON g.grp = o.grp
LEFT JOIN (SELECT hais_code, sum(actuals) AS a, sum(budget) AS b, sum(committed) AS c, min(period) FILTER ({_ACT}) AS first_period, max(period) FILTER ({_ACT}) AS last_period, list(DISTINCT house) FILTER ({_ACT}) AS hs FROM {_LINES} WHERE on_list GROUP BY hais_code) t ON t.hais_code = o.hais_code
LEFT JOIN (SELECT f.hais_code, {_MISMATCH} AS mismatch FROM project_financials f JOIN (SELECT hais_code, {_REF} FROM project_list QUALIFY row_number() OVER (PARTITION BY hais_code ORDER BY {_REF}) = 1) r USING (hais_code) GROUP BY f.hais_code) m ON m.hais_code = o.hais_code
LEFT JOIN (SELECT hais_code, round(max(share) - min(share), 1) AS split_range_pp, string_agg(printf('%d/%02d', fiscal_year, (fiscal_year + 1) % 100) || ' ' || round(share)::INT || '%', ' · ' ORDER BY fiscal_year) AS by_year FROM (
 SELECT hais_code, fiscal_year, hoc::DOUBLE / (hoc::DOUBLE + hol::DOUBLE) * 100 AS share FROM (SELECT hais_code, fiscal_year, sum(x) FILTER (house = 'HOC') AS hoc, sum(x) FILTER (house = 'HOL') AS hol FROM (
  SELECT hais_code, house, fiscal_year, sum(actuals) AS x FROM {_LINES} WHERE on_list GROUP BY hais_code, house, fiscal_year, regexp_matches(upper(coalesce(mipck_l1_desc, '')), 'INCOME|RECEIPT|GRANT')) WHERE x > 0 GROUP BY ALL) WHERE hoc > 0 AND hol > 0) GROUP BY hais_code) y ON y.hais_code = o.hais_code"""
_UNITS = f"SELECT *, {_PI('first_period')} - (SELECT {_PI(f'min(period) FILTER ({_ACT})')} FROM project_financials) < 3 AS truncated FROM ({_POSITIONS})"
_add("project_codes", _PRJ, _codes, _CODES)
_add("project_opening", _PRJ, lambda f: projects.opening_table(projects.positions(_project(f)[1]), f["project_list"]), f"""
SELECT unit, hais_listed, * EXCLUDE (unit, hais_listed, now), CASE WHEN last_activity IS NULL THEN 'No activity' WHEN abs(now) >= 0.005 THEN 'Active this year' ELSE 'Dormant this year' END AS signal FROM (SELECT unit, count(DISTINCT hais_code) AS hais_listed FROM project_list WHERE unit IS NOT NULL GROUP BY unit)
LEFT JOIN (SELECT unit, {", ".join(f"sum({c}) FILTER (house = '{h}') AS {h.lower()}_{c}" for h in ("HOC", "HOL") for c in ("spend_to_date", "budget_to_date", "commitments"))}, max(last_period) AS last_activity, sum(current_fy_actuals) AS now FROM ({_POSITIONS}) GROUP BY unit) USING (unit)""")
_built_checks("checks_project_codes", "project_codes", _PRJ, _codes, _CODES)
_built_checks("checks_project_units", "project_units", _PRJ, lambda f: projects.positions(_project(f)[1]), _UNITS)
_built_checks("checks_project_commitments", "project_commitments", _PRJ, lambda f: projects.commitments(_project(f)[0]), _COMMITMENTS)

_TASKS = f"(SELECT u AS unit, hais_code, house, sum(actuals) AS spend_to_date, sum(committed) AS commitments, sum(budget) AS budget_to_date, min(period) FILTER ({_ACT}) AS first_period, max(period) FILTER ({_ACT}) AS last_period, sum(budget) - sum(actuals) AS remaining_budget FROM {_LINES} WHERE on_list AND NOT regexp_matches(upper(coalesce(mipck_l1_desc, '')), 'INCOME|RECEIPT|GRANT') GROUP BY ALL HAVING min(period) FILTER ({_ACT}) IS NOT NULL)"
_tasks = lambda f: projects.tasks(projects.in_scope(_project(f)[1], expenditure_only=True))
_add("project_tasks", _PRJ, _tasks, f"SELECT * FROM {_TASKS}")
_add("project_idle_codes", _PRJ, lambda f: projects.idle_codes(f["project_list"], _tasks(f)), f"SELECT hais_code, l.* FROM (SELECT hais_code, min({{'unit': unit, 'hais_desc': hais_desc, 'status': status}}) AS l FROM project_list WHERE hais_code IS NOT NULL GROUP BY 1) WHERE hais_code NOT IN (SELECT hais_code FROM {_TASKS} WHERE hais_code IS NOT NULL)")

# The project extract

_extracted = lambda f: project_extract.extract(f["project_list"], f["project_financials"])
_ON_LIST = f"(SELECT * FROM {_LINES} WHERE on_list)"
_LATEST = f"(SELECT {_PI(f'max(period) FILTER ({_ACT})')} FROM project_financials)"
_SIGNAL = f"CASE WHEN last_period IS NULL THEN 'No activity' WHEN {_LATEST} - {_PI('last_period')} <= 12 THEN 'Live' ELSE 'Dormant' END"
_ACTIVE_BY = lambda k: f"(SELECT {k}, min(period) AS first_period, max(period) AS last_period, CASE WHEN count(DISTINCT house) = 1 THEN min(house) ELSE 'Shared' END AS houses, count(DISTINCT hais_code) AS active_lines FROM {_ON_LIST} WHERE {_ACT} GROUP BY 1)"
_MAIN = lambda c: f"(SELECT unit, {c} FROM (SELECT unit, {c}, count(*) AS n FROM project_list WHERE coalesce(trim({c}), '') <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, {c}) = 1)"
_add("project_extract_header", _PRJ, lambda f: _extracted(f)["header"].drop("project_manager", "start_date", "end_date"), f"""SELECT unit, unit_desc, hais_listed, costc, directorate, department, first_period, last_period, coalesce(active_lines, 0) AS active_lines, coalesce(houses, '—') AS houses, projcat, projgrp, 'Unclassified' AS project_type, {_SIGNAL} AS signal
FROM (SELECT unit, min(unit_desc) AS unit_desc, count(DISTINCT hais_code) AS hais_listed, min(costc) AS costc, min(directorate) AS directorate, min(department) AS department FROM project_list WHERE coalesce(trim(unit), '') <> '' GROUP BY unit) LEFT JOIN {_ACTIVE_BY('u AS unit')} USING (unit) LEFT JOIN {_MAIN('projcat')} USING (unit) LEFT JOIN {_MAIN('projgrp')} USING (unit)""")
_add("project_extract_tasks", _PRJ, lambda f: _extracted(f)["tasks"], f"""SELECT hais_code, l.unit AS unit, l.unit_desc AS unit_desc, l.hais_desc AS hais_desc, l.status AS status, first_period, last_period, coalesce(houses, '—') AS houses, first_period IS NOT NULL AS has_activity, {_SIGNAL} AS signal
FROM (SELECT hais_code, min({{'unit': unit, 'unit_desc': unit_desc, 'hais_desc': hais_desc, 'status': status}}) AS l FROM project_list WHERE hais_code IS NOT NULL GROUP BY 1) LEFT JOIN {_ACTIVE_BY('hais_code')} USING (hais_code)""")
_add("project_extract_reconciliation", _PRJ, lambda f: _extracted(f)["reconciliation"], f"""SELECT * FROM (WITH c AS (SELECT DISTINCT hais_code FROM project_list WHERE hais_code IS NOT NULL), a AS (SELECT DISTINCT hais_code FROM {_ON_LIST} WHERE {_ACT}), n AS (SELECT DISTINCT hais_code FROM project_financials WHERE hais_code IS NOT NULL),
 p AS (SELECT u AS unit, house, sum(actuals) AS s, sum(committed) AS c, sum(budget) AS b FROM {_ON_LIST} GROUP BY ALL HAVING min(period) FILTER ({_ACT}) IS NOT NULL), k AS (SELECT u AS unit, hais_code, house, sum(actuals) AS s FROM {_ON_LIST} GROUP BY ALL HAVING min(period) FILTER ({_ACT}) IS NOT NULL), h AS (SELECT DISTINCT unit FROM project_list WHERE coalesce(trim(unit), '') <> '')
SELECT "check", value::DOUBLE AS value FROM (SELECT 'listed codes' AS "check", count(*) AS value FROM c UNION ALL SELECT 'codes in the financials', count(*) FROM n UNION ALL SELECT 'listed codes with activity', count(*) FROM a UNION ALL SELECT 'listed codes without activity', count(*) FROM c ANTI JOIN a USING (hais_code) UNION ALL SELECT 'codes off the list', count(*) FROM n ANTI JOIN c USING (hais_code)
UNION ALL SELECT 'actuals on listed codes', sum(actuals) FROM {_ON_LIST} UNION ALL SELECT 'spend to date', sum(s) FROM p UNION ALL SELECT 'open commitments', sum(c) FROM p UNION ALL SELECT 'budget to date', sum(b) FROM p UNION ALL SELECT 'tasks and positions apart', (SELECT sum(s) FROM k) - (SELECT sum(s) FROM p) UNION ALL SELECT 'history and positions apart', 0
UNION ALL SELECT 'positions without a project', count(*) FROM p ANTI JOIN h USING (unit) UNION ALL SELECT 'task positions without a task', count(*) FROM k ANTI JOIN c USING (hais_code) UNION ALL SELECT 'tasks without a project', count(*) FROM (SELECT hais_code, min({{'unit': unit}}).unit AS unit FROM project_list WHERE hais_code IS NOT NULL GROUP BY 1) ANTI JOIN h USING (unit)))""")

# Evidence of every check

_BUILDS = {"asset_nbv": (_NBV, _nbv, _ASSET_ROWS), "project_codes": (_PRJ, _codes, _CODES), "project_units": (_PRJ, lambda f: projects.positions(_project(f)[1]), _UNITS), "project_commitments": (_PRJ, lambda f: projects.commitments(_project(f)[0]), _COMMITMENTS)}


def _domain_evidence(domain: str) -> None:
    own = [c for c in CATALOGUE if c.domain == domain]
    built = [t for t in _BUILDS if any(c.table == t for c in own)]
    deep = any(c in _DEPTH for c in own)
    tables = ({c.table for c in own} | core.needs(own)).union(*[_BUILDS[t][0] for t in built]) - set(_BUILDS)

    def rows(spark, sf_dir):
        f = bindings.frames(spark, sf_dir, tables)
        f |= {t: _BUILDS[t][1](f) for t in built} | ({"agldimvalue": _depth(f)} if deep else {})
        told = F.conv(F.substring(F.md5("evidence"), 1, 8), 16, 10).cast("long")
        return evidence.failing(f, own, AS_OF, apart=("apoheader", "apodetail")).groupBy("check_id", "house").agg(F.count("*").alias("rows"), F.sum(told).alias("told"))

    _QUERIES[f"evidence_{domain.lower()}"] = rows
    made = {t: _BUILDS[t][2] for t in built} | (_TREE if deep else {})
    checks = [replace(c, table="deep") if c in _DEPTH else c for c in own]
    _EVIDENCE[domain] = (checks, tables, made)


_EVIDENCE: dict = {}
for _domain in dict.fromkeys(c.domain for c in CATALOGUE):
    _domain_evidence(_domain)


def _evidence_sql() -> None:
    """The columns shown follow from those of the tables, which DuckDB tells for empty sources."""
    import duckdb

    base = duckdb.connect()
    for name, columns in bindings.SOURCE_COLUMNS.items():
        base.execute(f"CREATE TABLE {name} ({columns})")
    for domain, (checks, tables, made) in _EVIDENCE.items():
        columns = {t: [r[0] for r in base.execute("DESCRIBE " + bindings.with_tables(tables, f"SELECT * FROM {t}", made)).fetchall()] for t in {c.table for c in checks}}
        plain = {c.id: next(x for x in CATALOGUE if x.id == c.id) for c in checks}
        _SQL[f"evidence_{domain.lower()}"] = oracle.evidence_sql(checks, AS_OF, {c.id: evidence.shown(plain[c.id], columns[c.table]) for c in checks}, tables, made)


# Contracts, budgets, staff

_add("contract_reliability", {"atamis_contracts"}, lambda f: money.organisation_reliability(f["atamis_contracts"]), "SELECT s AS stated, house AS derived, CASE WHEN house = 'Unknown' THEN 'No match' WHEN s = 'JOINT' THEN 'Joint' WHEN s = house THEN 'Agrees' WHEN s IN ('HOC', 'HOL') THEN 'Differs' ELSE 'Not a house' END AS verdict, count(*) AS contracts FROM (SELECT upper(trim(organisation)) AS s, house FROM atamis_contracts) GROUP BY ALL")
_add("contract_metrics", {"atamis_contracts"}, lambda f: money.contract_metrics(f["atamis_contracts"], AS_OF), f"SELECT house, count(*) AS contracts, count(*) FILTER (start_date <= {DAY} AND end_date >= {DAY}) AS live, count(*) FILTER (end_date < {DAY}) AS expired, count(*) FILTER (start_date <= {DAY} AND end_date >= {DAY} AND end_date <= {DAY} + 90) AS ending_soon, sum(total_award_value)::DECIMAL(28, 2) AS value FROM atamis_contracts GROUP BY house")
_add("contract_gaps", {"atamis_contracts", "unit4_commitments", "unit4_spend", "apodetail"}, lambda f: money.contract_gaps(f["atamis_contracts"], f["unit4_commitments"], f["unit4_spend"], f["apodetail"]), """
SELECT in_contracts, in_commitments, in_spend, in_orders, count(*) AS refs FROM (SELECT ref, bool_or(s = 1) AS in_contracts, bool_or(s = 2) AS in_commitments, bool_or(s = 3) AS in_spend, bool_or(s = 4) AS in_orders FROM (
SELECT trim(contract_ref) AS ref, 1 AS s FROM atamis_contracts UNION ALL SELECT trim(u4_contract_id), 2 FROM unit4_commitments UNION ALL SELECT trim(u4_contract_id), 3 FROM unit4_spend UNION ALL SELECT trim(contract_id), 4 FROM apodetail) WHERE coalesce(ref, '') <> '' GROUP BY ref) GROUP BY ALL""")
_IDS = "(SELECT trim(apar_id) AS k, min(house) AS h FROM asuheader WHERE house IN ('HOC', 'HOL') AND apar_id IS NOT NULL GROUP BY 1)"
_BOUGHT = f"(SELECT c.* EXCLUDE (house), coalesce(h, 'Unknown') AS house FROM unit4_commitments c LEFT JOIN {_IDS} ON k = trim(supplier_id))"
_BOUGHT_BY = f"(SELECT u4_contract_id AS k, min(house) AS h FROM {_BOUGHT} WHERE u4_contract_id IS NOT NULL GROUP BY 1)"
_bought = lambda f: house.by_membership(f["unit4_commitments"], "supplier_id", f["asuheader"])
_HOUSED = {"asuheader", "unit4_commitments"}
_add("house_suppliers", {"asuheader", "atamis_suppliers"}, lambda f: house.by_membership(f["atamis_suppliers"], "creditor_ref", f["asuheader"]).select("supplier_name", "creditor_ref", "house"), f"SELECT supplier_name, creditor_ref, coalesce(h, 'Unknown') AS house FROM atamis_suppliers LEFT JOIN {_IDS} ON k = trim(creditor_ref)")
_add("house_contracts", _HOUSED | {"atamis_contracts"}, lambda f: house.of_contracts(f["atamis_contracts"], _bought(f)).select("contract_ref", "organisation", "supplier_name", "house"), f"""
SELECT contract_ref, organisation, supplier_name, CASE WHEN upper(trim(organisation)) IN ('HOC', 'HOL') THEN upper(trim(organisation)) WHEN coalesce(trim(contract_ref), '') <> '' THEN coalesce(h, 'Unknown') ELSE 'Unknown' END AS house FROM atamis_contracts LEFT JOIN {_BOUGHT_BY} ON k = contract_ref""")
_add("house_spend", _HOUSED | {"unit4_spend"}, lambda f: house.of_spend(f["unit4_spend"], _bought(f)).select("u4_contract_id", "house"), f"SELECT u4_contract_id, coalesce(h, 'Unknown') AS house FROM unit4_spend LEFT JOIN {_BOUGHT_BY} ON k = u4_contract_id")
_add("house_contract_refs", _HOUSED | {"gl_contract_values", "hol_unit4_spend"}, lambda f: house.contract_refs(_bought(f), f["gl_contract_values"], f["hol_unit4_spend"]).select("house", "u4_contract_id", "source"), f"""
SELECT house, u4_contract_id, 'unit4_commitments' AS source FROM {_BOUGHT} UNION ALL SELECT 'HOL', dim_value, 'gl_dimension_values' FROM gl_contract_values WHERE house = 'HOL' AND trim(dim_position) = '5' AND lower(trim(dim_description)) = 'contract number' AND trim(dim_value) IN (SELECT trim(u4_contract_id) FROM hol_unit4_spend WHERE trim(u4_contract_id) <> '' GROUP BY 1 HAVING sum(amount) > 0)""")
_add("house_budgets", {"budgets_report"}, lambda f: house.of_budgets(f["budgets_report"]).groupBy("house", "recharge").agg(F.count("*").alias("lines")), "SELECT CASE WHEN trim(recharge) IN ('HOC', 'HOL') THEN trim(recharge) ELSE 'Unknown' END AS house, recharge, count(*) AS lines FROM budgets_report GROUP BY ALL")
_add("house_asset_scope", {"asset_master"}, lambda f: house.in_client_scope(f["asset_master"], {"HOC": ["CA"], "HOL": ["LA"]}, ["asset_id"]).select("house", "client", "asset_id"), "SELECT house, client, trim(asset_id) AS asset_id FROM asset_master WHERE (house <> 'HOC' OR trim(client) = 'CA') AND (house <> 'HOL' OR trim(client) = 'LA')")
_add("house_open_commitments", _HOUSED | {"unit4_open_contracts"}, lambda f: house.open_only(_bought(f), "u4_contract_id", f["unit4_open_contracts"]).select("u4_contract_id", "supplier_id", "house"), f"SELECT u4_contract_id, supplier_id, house FROM {_BOUGHT} WHERE trim(u4_contract_id) IN (SELECT trim(u4_contract_id) FROM unit4_open_contracts)")
_add("house_existence", {"asuheader", "atamis_suppliers"}, lambda f: house.existence(house.by_membership(f["atamis_suppliers"], "creditor_ref", f["asuheader"]), "creditor_ref").groupBy("house", "derived_house").agg(F.count("*").alias("rows"), F.count_if(F.col("derived_house") == "Unknown").alias("failing")), f"SELECT 'Unknown' AS house, coalesce(h, 'Unknown') AS derived_house, count(*) AS rows, count(*) FILTER (h IS NULL) AS failing FROM atamis_suppliers LEFT JOIN {_IDS} ON k = trim(creditor_ref) WHERE coalesce(trim(creditor_ref), '') <> '' GROUP BY ALL")
_add("budget_kpis", {"budgets_report"}, lambda f: money.budget_kpis(f["budgets_report"]), """SELECT *, round_even(gl_actuals::DOUBLE / curr_budget::DOUBLE * 100, 2) AS utilisation_pct, curr_budget - orig_budget AS virement, curr_budget - gl_actuals AS remaining, live_forecast - curr_budget AS forecast_variance
FROM (SELECT house, sum(coalesce(gl_actuals, 0)) AS gl_actuals, sum(coalesce(orig_budget, 0)) AS orig_budget, sum(coalesce(curr_budget, 0)) AS curr_budget, sum(coalesce(live_forecast, 0)) AS live_forecast FROM budgets_report GROUP BY house)""")
for _column, _n in (("account_desc", 15), ("haiscode", 10)):
    _add(f"budget_top_{_column}", {"budgets_report"}, lambda f, c=_column, n=_n: money.budget_top(f["budgets_report"], c, n), f"SELECT coalesce({_column}, '(none)') AS {_column}, sum(gl_actuals) AS gl_actuals, sum(curr_budget) AS curr_budget FROM budgets_report GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {_n}")
_add("budget_by_period", {"budgets_report"}, lambda f: money.budget_by_period(f["budgets_report"]), "SELECT house, year, period, sum(gl_actuals) AS gl_actuals, sum(curr_budget) AS curr_budget FROM budgets_report GROUP BY ALL")
_add("staff_metrics", {"employee_master"}, lambda f: money.staff_metrics(f["employee_master"], AS_OF), f"""SELECT department, contract_type, CASE WHEN t <= 1 THEN 'Under 1 year' WHEN t <= 3 THEN '1-3 years' WHEN t <= 5 THEN '3-5 years' WHEN t <= 10 THEN '5-10 years' ELSE 'Over 10 years' END AS tenure, count(*) AS employees, round(avg(({DAY} - dob) / 365.25::DOUBLE), 4) AS mean_age
FROM (SELECT *, ({DAY} - start_date) / 365.25::DOUBLE AS t FROM employee_master WHERE employment_status = 'Active') GROUP BY 1, 2, 3""")
_add("payroll_metrics", {"payroll_transactions"}, lambda f: money.payroll_metrics(f["payroll_transactions"]), "SELECT pay_period, count(*) AS payments, count(DISTINCT employee_id) AS employees, " + ", ".join(f"sum(coalesce({c}, 0)) AS {c}" for c in ("gross_pay", "tax_deducted", "ni_deducted", "pension_deducted", "other_deductions", "net_pay", "overtime_pay")) + " FROM payroll_transactions GROUP BY pay_period")


# Migration

_RULES = pipeline.Rules(AS_OF)
_MIGRATION = {"asuheader", "asuhistr", "asutrans", "apoheader"}
_moved = lambda f: (f["asuheader"], f["asuhistr"], f["asutrans"], f["apoheader"].withColumn("house", F.when(F.col("client") == "LA", "HOL").otherwise("HOC")), _RULES)
_position = lambda f: pipeline.position(*_moved(f))
_SCOPED = "(SELECT *, house || '|' || apar_id AS entity_key, coalesce(status IN ('N', 'P'), false) AND NOT (coalesce(upper(trim(apar_name)) = 'SZSINGLES', false) OR (house = 'HOC' AND (starts_with(apar_id, '89') OR starts_with(apar_id, '99')))) AS in_scope, coalesce(upper(trim(apar_name)) = 'SZSINGLES', false) OR (house = 'HOC' AND (starts_with(apar_id, '89') OR starts_with(apar_id, '99'))) AS legacy FROM asuheader WHERE (house = 'HOC' AND client IN ('CA', 'CM')) OR (house = 'HOL' AND client = 'LA'))"
_ENTITIES = f"""SELECT * FROM (SELECT *, array_to_string(list_sort(list_distinct(list(client) OVER e)), ',') AS clients, array_to_string(list_sort(list_distinct(list(status) OVER e)), ',') AS statuses,
 bool_or(in_scope) OVER e AS in_population, row_number() OVER (PARTITION BY entity_key ORDER BY in_scope DESC, CASE WHEN status = 'N' THEN 0 ELSE 1 END, client, apar_name) AS n,
 coalesce((house = 'HOC' AND trim(apar_gr_id) IN ('EM', 'ME', 'SA', 'WI')) OR (house = 'HOL' AND trim(apar_gr_id) IN ('05', '06')), false) AS g, coalesce((house = 'HOC' AND (starts_with(apar_id, '1000') OR starts_with(apar_id, '74'))) OR (house = 'HOL' AND left(apar_id, 1) IN ('1', '2', '3')), false) AS p
 FROM {_SCOPED} WINDOW e AS (PARTITION BY entity_key)) WHERE n = 1"""


_COMMERCIAL = "NOT (g OR p) AND NOT coalesce(house = 'HOL' AND trim(apar_gr_id) = '03', false)"
_clean = lambda c: f"regexp_replace(upper(coalesce({c}, '')), '[^A-Z0-9]', '', 'g')"
_WORDS = "string_split(regexp_replace(replace(upper(coalesce(apar_name, '')), 'PUBLIC LIMITED COMPANY', 'PLC'), '[^A-Z0-9& ]', ' ', 'g'), ' ')"
_STD = f"list_transform(list_filter({_WORDS}, lambda w: w <> ''), lambda w: CASE w WHEN 'LIMITED' THEN 'LTD' WHEN 'AND' THEN '&' WHEN 'COMPANY' THEN 'CO' WHEN 'INCORPORATED' THEN 'INC' WHEN 'CORPORATION' THEN 'CORP' ELSE w END)"


def _keys_sql() -> dict[str, str]:
    """The keys of a row of the master by name, in SQL of their own."""
    sort, account, code = "regexp_replace(coalesce(clearing_code, ''), '[^0-9]', '', 'g')", "regexp_replace(coalesce(bank_account, ''), '[^0-9]', '', 'g')", "regexp_replace(upper(coalesce(zip_code, '')), '\\s', '', 'g')"
    iban, vat, number = "regexp_replace(upper(coalesce(iban, '')), '\\s', '', 'g')", f"regexp_replace({_clean('vat_reg_no')}, '^GB', '')", _clean("comp_reg_no")
    name = f"array_to_string(CASE WHEN ({_STD})[1] = 'THE' THEN ({_STD})[2:] ELSE {_STD} END, ' ')"
    return {
        "bank": f"CASE WHEN {sort} <> '' AND {account} <> '' AND {account} NOT IN ('00000000', '0', '11111111', '99999999') AND NOT regexp_matches({account}, '^0+$') THEN {sort} || ':' || {account} WHEN {iban} <> '' THEN {iban} END",
        "vat": f"CASE WHEN regexp_matches({vat}, '^([0-9]{{9}}|[0-9]{{12}})$') THEN {vat} END", "company": f"CASE WHEN length({number}) >= 6 AND NOT regexp_matches({number}, '^0+$') THEN {number} END", "name": f"CASE WHEN {name} <> '' AND {code} <> '' THEN {name} || '@' || {code} END",
    }


def _issues_sql() -> str:
    """(entity_key, issue, dimension) by every test of a row by itself, from the predicates of the catalogue."""
    tests = [(c.id, c.dimension, f"({core.dated(c.population, AS_OF)}) AND ({core.dated(c.fails, AS_OF)})") for c in pipeline.ROW_TESTS]
    tests += [("MS-DQ-NAME", "Completeness", "coalesce(trim(apar_name), '') IN ('', 'nan', 'None')"), ("MS-DQ-LTD-COMPNO", "Completeness", f"list_has_any({_STD}, ['LTD', 'PLC', 'LLP']) AND {_clean('comp_reg_no')} = ''")]
    parts = [f"SELECT entity_key, '{i}' AS issue, '{d}' AS dimension FROM {_SCOPED} asuheader WHERE in_scope AND coalesce({bad}, false)" for i, d, bad in tests]
    parts.append(f"SELECT entity_key, 'MS-DQ-CLIENT-DIFF', 'Consistency' FROM {_SCOPED} WHERE in_scope GROUP BY entity_key HAVING {' OR '.join(f'coalesce(min({k}) < max({k}), false)' for k in _keys_sql().values())}")
    parts.append(f"SELECT entity_key, 'MS-DQ-GROUP-ID', 'Consistency' FROM ({_ENTITIES}) WHERE in_population AND house = 'HOL' AND g <> p")
    return " UNION ALL ".join(parts)


_BLOCKING = f"issue IN {pipeline.BLOCKING_TESTS}"
_ACTIVITY = """SELECT house, apar_id, last_invoice, last_order, open_orders, greatest(last_invoice, last_order) AS last_activity FROM
(SELECT house, apar_id, max(trans_date) AS last_invoice FROM (SELECT house, apar_id, voucher_type, trans_date FROM asuhistr UNION ALL SELECT house, apar_id, voucher_type, trans_date FROM asutrans) WHERE voucher_type IN ('CP', 'ID', 'IF', 'II', 'IU', 'OP', 'PI', 'RD', 'RI', 'SI', 'SR', 'IB', 'BH', 'CN', 'IC', 'IN', 'RC') GROUP BY ALL)
FULL JOIN (SELECT house, apar_id, max(order_date) AS last_order, count(*) FILTER (status IN ('O', 'N', 'A')) AS open_orders FROM apoheader GROUP BY ALL) USING (house, apar_id)"""
_ITEMS = f"SELECT *, house || '|' || client || '|' || apar_id || '|' || voucher_no AS item_key, ({DAY} - trans_date)::INT AS age_days, coalesce(trans_date < {DAY} - INTERVAL 2 MONTH, false) AS stuck FROM (SELECT house, client, apar_id, voucher_no, sum(rest_amount) AS balance, min(trans_date) AS trans_date FROM asutrans WHERE status IS DISTINCT FROM 'C' GROUP BY ALL HAVING sum(rest_amount) <> 0)"
_KEY_ROWS = ", ".join(f"{{'k': '{n}', 'v': {sql}}}" for n, sql in _keys_sql().items())
#: Groups by reachability over pairs of record and least record with the same key.
_GROUPS = {
    "keyed": f"SELECT house, entity_key, unnest([{_KEY_ROWS}], recursive := true) FROM {_SCOPED} WHERE in_scope AND entity_key IN (SELECT entity_key FROM ({_ENTITIES}) WHERE in_population AND {_COMMERCIAL})",
    "linked": "SELECT DISTINCT entity_key AS x, a AS y, k FROM keyed JOIN (SELECT house, k, v, min(entity_key) AS a FROM keyed WHERE v IS NOT NULL GROUP BY ALL HAVING min(entity_key) < max(entity_key)) USING (house, k, v)",
    "ends": "SELECT x, y FROM linked UNION SELECT y, x FROM linked",
    "reach": "SELECT x, x AS y FROM ends UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x",
    "dups": "SELECT x AS entity_key, min(y) AS dup_group, min(reasons) AS reasons FROM reach JOIN (SELECT x, string_agg(DISTINCT k, ', ' ORDER BY k) AS reasons FROM linked GROUP BY x) USING (x) GROUP BY x",
}
_since = lambda months: f"coalesce(last_activity >= {DAY} - INTERVAL {months} MONTH, false)"
_GAPS = " + ".join(f"(coalesce(trim({c}), '') NOT IN ('', 'nan', 'None', 'NaT'))::INT" for c in pipeline.COMPLETE)
_DIMS = ("Completeness", "Validity", "Consistency")


def _pass_sql(suffix: str, groups: str, items: str, left_out: str, confirmed: str) -> dict[str, str]:
    """One pass over the records: with the groups, items and confirmed records of the tables named."""
    has = ", ".join(f"bool_or(dimension = '{d}') AS has_{d.lower()}" for d in _DIMS)
    return {
        f"facts{suffix}": f"""SELECT e.* EXCLUDE (completeness), dup_group, coalesce(n_issues, 0) AS issues, coalesce(n_blocking, 0) AS blocking, coalesce({items}, 0) AS items, coalesce(all_items, 0) AS all_items, coalesce(n_stuck, 0) AS stuck_items, coalesce(n_undecided, 0) AS stuck_undecided, {left_out} AS left_out,
 {", ".join(f"coalesce(has_{d.lower()}, false) AS has_{d.lower()}" for d in _DIMS)}, last_activity, coalesce(open_orders, 0) AS open_orders, coalesce({items}, 0) > 0 OR coalesce(open_orders, 0) > 0 AS has_open, e.completeness FROM (SELECT *, {_GAPS} AS completeness FROM ({_ENTITIES})) e
LEFT JOIN ({_ACTIVITY}) a ON a.house = e.house AND a.apar_id = e.apar_id LEFT JOIN (SELECT house, apar_id, count(*) AS all_items, count(*) FILTER (decision IS DISTINCT FROM 'DONT_MIGRATE') AS counted, count(*) FILTER (stuck) AS n_stuck, count(*) FILTER (stuck AND decision IS NULL) AS n_undecided FROM ({_ITEMS}) LEFT JOIN item_said USING (item_key) GROUP BY ALL) i ON i.house = e.house AND i.apar_id = e.apar_id
LEFT JOIN (SELECT entity_key, count(DISTINCT issue) AS n_issues, count(DISTINCT issue) FILTER ({_BLOCKING}) AS n_blocking, {has} FROM ({_issues_sql()}) GROUP BY entity_key) q ON q.entity_key = e.entity_key LEFT JOIN {groups} d ON d.entity_key = e.entity_key""",
        f"levels{suffix}": f"SELECT f.*, confirmed, confirmed_at, f.dup_group IS NOT NULL AND rank() OVER (PARTITION BY f.dup_group ORDER BY blocking, NOT has_open, coalesce(last_activity, DATE '1900-01-01') DESC, completeness DESC) = 1 AS level FROM facts{suffix} f LEFT JOIN {confirmed} c ON c.dup_group = f.dup_group",
        f"ranked{suffix}": f"SELECT *, CASE WHEN confirmed IS NULL THEN level AND many = 1 ELSE confirmed = entity_key END AS preferred, confirmed IS NULL AND level AND many > 1 AS preferred_tie FROM (SELECT *, count(*) FILTER (level) OVER (PARTITION BY dup_group) AS many FROM levels{suffix})",
        f"classed{suffix}": f"""SELECT *, CASE WHEN rule = 'MS-POP-01' THEN 'OUT_OF_SCOPE' WHEN rule IN ('MS-CAT-01', 'MS-CAT-02') THEN 'HOLD_NONCOMMERCIAL' WHEN rule = 'MS-CAT-03' THEN 'HOLD_POLICY' WHEN rule IN ('MS-CLS-01', 'MS-CLS-02', 'MS-TRN-02') THEN 'CLOSE' WHEN rule IN ('MS-DUP-03', 'MS-CLS-03') THEN 'MONITOR' WHEN rule = 'MS-CLS-04' THEN 'FIX' ELSE 'KEEP' END AS classification FROM (
SELECT *, CASE WHEN NOT in_population THEN 'MS-POP-01' WHEN g THEN 'MS-CAT-01' WHEN p THEN 'MS-CAT-02' WHEN NOT ({_COMMERCIAL}) THEN 'MS-CAT-03' WHEN NOT {_since(18)} AND NOT has_open THEN CASE WHEN left_out THEN 'MS-TRN-02' ELSE 'MS-CLS-01' END WHEN preferred_tie THEN 'MS-DUP-03'
 WHEN dup_group IS NOT NULL AND NOT preferred THEN CASE WHEN {_since(6)} OR has_open THEN 'MS-CLS-03' ELSE 'MS-CLS-02' END WHEN blocking > 0 THEN 'MS-CLS-04' ELSE 'MS-CLS-05' END AS rule FROM ranked{suffix})""",
    }


_NOBODY = {"item_said": "SELECT '' AS item_key, '' AS decision WHERE false", "unconfirmed": "SELECT '' AS dup_group, '' AS confirmed, DATE '2000-01-01' AS confirmed_at WHERE false"}
_CLASSED = _NOBODY | _GROUPS | _pass_sql("", "dups", "all_items", "false", "unconfirmed")

# With decisions: the effective ones by family, groups without the parted and with the linked, and the second pass.
_FAMILY = "CASE " + " ".join(f"WHEN decision IN {d} THEN '{name}'" for name, (_, d) in decisions.FAMILIES.items()) + " END"
_SAID = {
    "latest": f"SELECT * FROM (SELECT * REPLACE (CASE WHEN target_type = 'pair' THEN least(target_key, related_key) ELSE target_key END AS target_key, CASE WHEN target_type = 'pair' THEN greatest(target_key, related_key) ELSE related_key END AS related_key), {_FAMILY} AS family FROM decision_log) WHERE family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target_type, target_key, related_key, family ORDER BY id DESC, decision) = 1",
    "item_said": "SELECT target_key AS item_key, decision FROM latest WHERE family = 'item'",
    "no_dup": "SELECT target_key FROM latest WHERE decision = 'NOT_DUPLICATE'",
    "parted": "SELECT target_key AS a, related_key AS b, decision FROM latest WHERE family = 'pair'",
}
_REGROUPED = {
    "linked_2": "SELECT DISTINCT entity_key AS x, a AS y FROM (SELECT * FROM keyed WHERE entity_key NOT IN (FROM no_dup)) JOIN (SELECT house, k, v, min(entity_key) AS a FROM keyed WHERE v IS NOT NULL AND entity_key NOT IN (FROM no_dup) GROUP BY ALL HAVING min(entity_key) < max(entity_key)) USING (house, k, v) UNION SELECT a, b FROM parted WHERE decision = 'SAME_SUPPLIER' AND a IN (SELECT entity_key FROM keyed) AND b IN (SELECT entity_key FROM keyed) AND a NOT IN (FROM no_dup) AND b NOT IN (FROM no_dup)",
    "ends_2": "SELECT x, y FROM linked_2 UNION SELECT y, x FROM linked_2",
    "reach_2": "SELECT x, x AS y FROM ends_2 UNION SELECT reach_2.x, ends_2.y FROM reach_2 JOIN ends_2 ON reach_2.y = ends_2.x",
    "dups_2": "SELECT x AS entity_key, min(y) AS dup_group FROM reach_2 GROUP BY x",
    "confirmed_2": "SELECT dup_group, max({'id': id, 'k': target_key, 'at': recorded_at}).k AS confirmed, max({'id': id, 'k': target_key, 'at': recorded_at}).at AS confirmed_at FROM latest JOIN dups_2 ON entity_key = target_key WHERE decision = 'CONFIRM_PREFERRED' GROUP BY dup_group",
}


def _near_sql(names: str, a: str, b: str, threshold: int) -> str:
    """Pairs a < b of the rows of `names` (house, block, key, tok), by all pairs of a block: a bound by the edit distance, then the longest common subsequence row by row."""
    row = "list_transform(range(1, len(s) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(s[i]::INT, CASE WHEN i > 1 AND tb[i - 1] = e[1] THEN s[i - 1]::INT + 1 ELSE 0 END)))::VARCHAR)"
    chars = "list_transform(string_split(ta, ''), lambda c: [c])"
    first = "list_transform(range(0, length(tb) + 1), lambda i: '0')"
    lcs = f"list_reduce(list_prepend({first}, {chars}), lambda s, e: {row})[-1]::INT"
    return f"""SELECT * FROM (SELECT *, CASE WHEN ta = tb THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {lcs} / (length(ta) + length(tb)) END AS score FROM (
SELECT x.house, x.key AS {a}, y.key AS {b}, x.tok AS ta, y.tok AS tb FROM {names} x JOIN {names} y ON x.house = y.house AND x.block = y.block AND x.key < y.key AND x.tok <> '' AND y.tok <> '' WHERE levenshtein(x.tok, y.tok) <= floor({100 - threshold} * (length(x.tok) + length(y.tok)) / 100 + 1e-9))) WHERE score >= {threshold}"""


_CORE = f"array_to_string(list_filter(CASE WHEN ({_STD})[1] = 'THE' THEN ({_STD})[2:] ELSE {_STD} END, lambda w: w NOT IN ('LTD', 'PLC', 'LLP', 'INC', 'CORP', 'CO', '&')), ' ')"
_tok = lambda c: f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda w: w <> '')), ' ')"
_NEAR = {
    "named": f"SELECT house, entity_key AS key, core[1:2] AS block, {_tok('core')} AS tok FROM (SELECT house, entity_key, {_CORE} AS core FROM ({_ENTITIES}) WHERE in_population AND {_COMMERCIAL}) WHERE core <> ''",
    "near": f"{_near_sql('named', 'a', 'b', 90)}",
}
_POSSIBLE = _NEAR | {
    "met": "SELECT a, b FROM near WHERE a NOT IN (FROM no_dup) AND b NOT IN (FROM no_dup) AND (a, b) NOT IN (SELECT (a, b) FROM parted) AND (SELECT dup_group FROM dups_2 WHERE entity_key = a) IS DISTINCT FROM coalesce((SELECT dup_group FROM dups_2 WHERE entity_key = b), b)",
    "partners": "SELECT entity_key, count(*) AS partners FROM (SELECT a AS entity_key FROM met UNION ALL SELECT b FROM met) GROUP BY 1",
}
_LABELS = "CASE k " + " ".join(f"WHEN '{key[4:]}' THEN '{label}'" for key, (label, _) in pipeline.KEY_LABELS.items()) + " END"
_CROSS = {"crossed": f"""SELECT entity_key, string_agg(DISTINCT tag, '; ' ORDER BY tag) AS cross_house FROM (SELECT x.entity_key, {_LABELS.replace('CASE k', 'CASE x.k')} || ' as ' || least_key || CASE WHEN n > 1 THEN ' and ' || (n - 1) || ' more' ELSE '' END AS tag
 FROM keyed x JOIN (SELECT house, k, v, min(entity_key) AS least_key, count(DISTINCT entity_key) AS n FROM keyed WHERE v IS NOT NULL GROUP BY ALL) o ON o.k = x.k AND o.v = x.v AND o.house <> x.house) GROUP BY 1"""}
_print = lambda items: f"md5(to_json([coalesce(last_activity::DATE::VARCHAR, ''), {items}::VARCHAR, open_orders::VARCHAR, blocking::VARCHAR, coalesce(dup_group, ''), in_population::VARCHAR])::VARCHAR)[1:12]"
_KEEPS = f"c.decision IN ('KEEP', 'WILL_FIX', 'ACCEPT_AS_IS') OR (c.decision = 'AGREE' AND recommendation IN {pipeline.IN_SCOPE})"
_CLOSES = "c.decision = 'CLOSE' OR (c.decision = 'AGREE' AND recommendation = 'CLOSE')"
_HERE = "coalesce(in_population, false)"
_FINAL = _SAID | _GROUPS | _REGROUPED | {"unconfirmed": _NOBODY["unconfirmed"]} | _pass_sql("", "dups", "all_items", "false", "unconfirmed") | _pass_sql("_2", "dups_2", "counted", "coalesce(counted = 0, false)", "confirmed_2") | _POSSIBLE | _CROSS | {
    "joined": """SELECT c.* EXCLUDE (entity_key), coalesce(c.entity_key, s.target_key) AS entity_key, c.entity_key IS NULL AS missing, s.decision, s.recommendation, r.classification AS recommended, coalesce(r.rule, '') AS recommended_rule, partners IS NOT NULL AS possible, cross_house
FROM classed_2 c FULL JOIN (SELECT target_key, decision, recommendation FROM latest WHERE family = 'scope' AND target_type = 'record') s ON s.target_key = c.entity_key LEFT JOIN classed r ON r.entity_key = c.entity_key LEFT JOIN partners p ON p.entity_key = c.entity_key LEFT JOIN crossed x ON x.entity_key = c.entity_key""",
    "final": f"""SELECT c.* EXCLUDE (classification), c.classification AS by_rule, CASE WHEN missing THEN 'NOT_IN_EXTRACT' WHEN decision = 'KEEP' AND {_HERE} THEN CASE WHEN blocking > 0 THEN 'FIX' ELSE 'KEEP' END WHEN decision = 'CLOSE' AND {_HERE} THEN 'CLOSE' WHEN decision = 'ACCEPT_AS_IS' AND {_HERE} AND c.classification = 'FIX' THEN 'KEEP' ELSE c.classification END AS classification FROM joined c""",
    "waiting": f"""SELECT *, coalesce(classification <> by_rule AND decision IS NOT NULL, false) AS overridden, CASE WHEN NOT {_HERE} THEN '' ELSE concat_ws('; ', CASE WHEN classification IN ('CLOSE', 'MONITOR', 'FIX', 'HOLD_NONCOMMERCIAL', 'HOLD_POLICY') AND decision IS NULL AND rule <> 'MS-TRN-02' THEN 'Confirm classification' END,
 CASE WHEN dup_group IS NOT NULL AND confirmed IS NULL THEN 'Confirm preferred record' END, CASE WHEN possible THEN 'Review possible duplicate' END, CASE WHEN stuck_undecided > 0 THEN stuck_undecided || ' stuck open item' || CASE WHEN stuck_undecided > 1 THEN 's' ELSE '' END END) END AS pending FROM final""",
    "told": f"""SELECT c.*, CASE WHEN missing THEN 'decided' WHEN overridden THEN 'override' WHEN pending <> '' THEN 'awaiting' WHEN decision IS NOT NULL OR rule = 'MS-TRN-02' THEN 'decided' ELSE 'none' END AS decision_status,
 CASE WHEN missing THEN 'Not in latest extract' WHEN ({_CLOSES}) AND NOT {_HERE} THEN 'Actioned in Unit4' WHEN {_CLOSES} THEN 'Not yet actioned in Unit4' WHEN ({_KEEPS}) AND NOT {_HERE} THEN 'Conflict: closed in Unit4 against a Keep decision' ELSE '' END AS follow_through,
 CASE WHEN dup_group IS NOT NULL AND NOT preferred AND NOT preferred_tie AND confirmed IS NOT NULL AND last_activity > confirmed_at THEN 'Non-preferred supplier used after the preferred record was confirmed' ELSE '' END AS alert,
 coalesce(g, false) AS cat_1, coalesce(p AND NOT g, false) AS cat_2, coalesce(NOT g AND NOT p AND NOT ({_COMMERCIAL}), false) AS cat_3, coalesce(house = 'HOC' AND trim(apar_gr_id) IN ('TI', 'TO'), false) AS individual, coalesce(legacy, false) AS legacy_, {_HERE} AS here, coalesce({_since(18)}, false) AS active, coalesce({_since(6)}, false) AS recent FROM waiting c""",
}
_when = lambda pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in pairs) + "], lambda x: x IS NOT NULL), ', ')"
_TAGGED = _when([("Non-commercial", "cat_1 OR cat_2"), ("Policy", "cat_3"), ("Individual contractor", "individual"), ("Dormant", "rule IN ('MS-CLS-01', 'MS-TRN-02')"), ("Duplicate", "dup_group IS NOT NULL"), ("Possible duplicate", "possible"), ("Validity", "has_validity"), ("Completeness", "has_completeness"), ("Consistency", "has_consistency"), ("Stuck item", "stuck_items > 0"), ("Cross-House", "cross_house IS NOT NULL")])
_RULES_FIRED = [("MS-POP-01", "true"), ("MS-POP-02", "true"), ("MS-CAT-01", "cat_1"), ("MS-CAT-02", "cat_2"), ("MS-CAT-03", "cat_3"), ("MS-CAT-04", "individual"), ("MS-DUP-01", "dup_group IS NOT NULL"), ("MS-DUP-03", "dup_group IS NOT NULL AND (preferred OR preferred_tie)"), ("MS-DUP-02", "possible"), ("MS-XH-01", "cross_house IS NOT NULL"), ("MS-TRN-01", "stuck_items > 0")]
_RULES_FIRED += [(r, f"recommended_rule = '{r}'") for r in ("MS-CLS-01", "MS-CLS-02", "MS-CLS-03", "MS-CLS-04", "MS-CLS-05", "MS-TRN-02")]
_FIRED_SQL = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _RULES_FIRED) + "], lambda x: x IS NOT NULL)), ', ')"
_STEPS_SQL = """CASE WHEN NOT here THEN 'MS-POP-01:stop' WHEN cat_1 OR cat_2 OR cat_3 THEN 'MS-POP-01:pass ' || rule || ':stop' ELSE 'MS-POP-01:pass MS-CAT-01:pass ' || CASE WHEN NOT active AND NOT has_open THEN rule || ':fail' ELSE 'MS-CLS-01:pass ' || CASE WHEN preferred_tie THEN 'MS-DUP-03:fail'
 WHEN dup_group IS NOT NULL AND NOT preferred THEN rule || ':fail' ELSE CASE WHEN dup_group IS NULL THEN 'MS-DUP-01' ELSE 'MS-DUP-03' END || ':pass ' || CASE WHEN blocking > 0 THEN 'MS-CLS-04:fail' ELSE 'MS-CLS-05:pass' END END END END"""

_add("migration_entities", {"asuheader"}, lambda f: pipeline.entities(f["asuheader"], _RULES).select("entity_key", "client", "status", "clients", "statuses", "in_population", "category", "category_rule"), f"""
SELECT entity_key, client, status, clients, statuses, in_population, CASE WHEN g OR p THEN 'Non-commercial' WHEN house = 'HOL' AND trim(apar_gr_id) = '03' THEN 'Policy' ELSE 'Commercial' END AS category, CASE WHEN g THEN 'MS-CAT-01' WHEN p THEN 'MS-CAT-02' WHEN house = 'HOL' AND trim(apar_gr_id) = '03' THEN 'MS-CAT-03' END AS category_rule FROM ({_ENTITIES})""")
_add("migration_activity", _MIGRATION, lambda f: pipeline.activity(f["asuhistr"], f["asutrans"], f["apoheader"], _RULES), _ACTIVITY)
_add("migration_items", {"asutrans"}, lambda f: pipeline.open_items(f["asutrans"], _RULES).drop("decision", "item_status"), _ITEMS)
_add("migration_issues", {"asuheader"}, lambda f: pipeline.issues(f["asuheader"], _RULES).groupBy("issue", "dimension", "blocking").agg(F.count("*").alias("records")), f"SELECT issue, dimension, {_BLOCKING} AS blocking, count(*) AS records FROM ({_issues_sql()}) GROUP BY issue, dimension")
_add("migration_groups", {"asuheader"}, lambda f: pipeline.duplicate_groups(f["asuheader"], _RULES), "SELECT entity_key, dup_group, reasons FROM dups", _GROUPS)
_add("migration_position", _MIGRATION, lambda f: _position(f).select("entity_key", "classification", "rule", "dup_group", "preferred", "preferred_tie", "issues", "blocking", "items", "stuck_items", "last_activity"), "SELECT entity_key, classification, rule, dup_group, preferred, preferred_tie, issues, blocking, items, stuck_items, last_activity FROM classed", _CLASSED)
_add("migration_funnel", _MIGRATION, lambda f: pipeline.funnel(pipeline.classified(*_moved(f))), "SELECT coalesce(house, 'Total') AS house, count(*) AS records, count(*) FILTER (in_population) AS in_population, " + ", ".join(f"count(*) FILTER (classification = '{c}') AS {c.lower()}" for c in pipeline.CLASSES) + " FROM classed GROUP BY ROLLUP (house)", _CLASSED)
_DECIDING = _MIGRATION | {"decision_log"}


def _decided(f):
    return pipeline.position(*_moved(f), decisions.effective(f["decision_log"]))


_DECIDED_COLUMNS = "entity_key classification rule recommended recommended_rule decision overridden pending decision_status follow_through alert dup_group preferred preferred_tie items left_out possible_duplicate cross_house fingerprint".split()
_add("migration_decided", _DECIDING, lambda f: _decided(f).select(*_DECIDED_COLUMNS), f"""SELECT entity_key, classification, rule, coalesce(recommended, classification) AS recommended, recommended_rule, decision, overridden, pending, decision_status, follow_through, alert, dup_group, coalesce(preferred, false) AS preferred, coalesce(preferred_tie, false) AS preferred_tie, coalesce(items, 0) AS items, left_out, possible AS possible_duplicate, cross_house,
CASE WHEN missing THEN md5(to_json(['', '0', '0', '0', '', 'false'])::VARCHAR)[1:12] ELSE {_print("items")} END AS fingerprint FROM told""", _FINAL)
_add("migration_reasons", _DECIDING, lambda f: _decided(f).select("entity_key", "reasons_tags", F.array_join("fired", ", ").alias("fired"), F.array_join(F.transform("trail", lambda t: F.concat(t["rule"], F.lit(":"), t["result"])), " ").alias("steps")), f"""
SELECT entity_key, CASE WHEN missing THEN 'Not in extract' WHEN NOT here THEN CASE WHEN legacy_ THEN 'Legacy exclusion' ELSE 'Closed in Unit4' END WHEN {_TAGGED} = '' THEN 'Active' ELSE {_TAGGED} END AS reasons_tags, CASE WHEN missing THEN '' WHEN here THEN {_FIRED_SQL} WHEN legacy_ THEN 'MS-POP-03' ELSE '' END AS fired, CASE WHEN NOT missing THEN {_STEPS_SQL} END AS steps FROM told""", _FINAL)
_add("migration_possible_duplicates", {"asuheader", "decision_log"}, lambda f: pipeline.possible_duplicates(f["asuheader"], _RULES, decisions.effective(f["decision_log"])), "SELECT entity_key, partners FROM partners", _SAID | _GROUPS | _REGROUPED | _POSSIBLE)
_HOLDERS = "count(*) AS records, min(key) AS first"
_add("migration_name_classes", {"asuheader"}, lambda f: pipeline.name_classes(f["asuheader"], _RULES), f"""SELECT p.house, p.a AS name_a, p.b AS name_b, p.score, x.records AS records_a, y.records AS records_b, x.first AS first_a, y.first AS first_b
FROM (SELECT house, a, b, round_even(score, 0)::BIGINT AS score, block FROM pairs JOIN (SELECT DISTINCT house, key, block FROM tokens) t USING (house) WHERE t.key = a UNION ALL SELECT house, tok, tok, 100, block FROM named GROUP BY house, tok, block HAVING count(*) > 1) p
JOIN (SELECT house, block, tok, {_HOLDERS} FROM named GROUP BY ALL) x ON x.house = p.house AND x.block = p.block AND x.tok = p.a JOIN (SELECT house, block, tok, {_HOLDERS} FROM named GROUP BY ALL) y ON y.house = p.house AND y.block = p.block AND y.tok = p.b""", {"named": _NEAR["named"], "tokens": "SELECT DISTINCT house, block, tok AS key, tok FROM named", "pairs": _near_sql("tokens", "a", "b", 90)})
_add("near_supplier_names", {"asuheader"}, lambda f: pipeline.near_names(f["asuheader"]), f"""SELECT p.house, p.a AS name_a, p.b AS name_b, round_even(p.score, 0)::BIGINT AS score, x.records AS records_a, y.records AS records_b, x.first AS first_a, y.first AS first_b FROM pairs p
JOIN (SELECT house, block, tok, {_HOLDERS} FROM named GROUP BY ALL) x ON x.house = p.house AND x.tok = p.a JOIN (SELECT house, block, tok, {_HOLDERS} FROM named GROUP BY ALL) y ON y.house = p.house AND y.tok = p.b AND y.block = x.block JOIN (SELECT DISTINCT house, block, key FROM tokens) t ON t.house = p.house AND t.block = x.block AND t.key = p.a WHERE round_even(p.score, 0) < 100""", {
    "named": f"SELECT house, apar_id AS key, plain[1:1] AS block, {_tok('plain')} AS tok FROM (SELECT house, apar_id, upper(trim(coalesce(min({{'c': client, 'n': apar_name}}).n, ''))) AS plain FROM asuheader WHERE status IS DISTINCT FROM 'C' GROUP BY house, apar_id) WHERE plain <> ''", "tokens": "SELECT DISTINCT house, block, tok AS key, tok FROM named", "pairs": _near_sql("tokens", "a", "b", 90)})
_add("migration_item_states", {"asutrans", "decision_log"}, lambda f: pipeline.open_items(f["asutrans"], _RULES, decisions.effective(f["decision_log"])).select("item_key", "decision", "item_status"), f"SELECT item_key, decision, CASE WHEN decision = 'MIGRATE' THEN 'Migrate (steward)' WHEN decision = 'DONT_MIGRATE' THEN 'Don''t migrate (steward)' WHEN stuck THEN 'Needs review' ELSE 'Recent: no action' END AS item_status FROM ({_ITEMS}) LEFT JOIN item_said USING (item_key)", _SAID)
_SINCE = "2001-10-01"
_add("migration_changes", _DECIDING, lambda f: decisions.recommended_changes(pipeline.classified(*_moved(f), decisions.effective(f["decision_log"])), f["decision_log"], _SINCE), f"""
SELECT coalesce(b.entity_key, a.entity_key) AS entity_key, string_split(coalesce(b.entity_key, a.entity_key), '|')[1] AS house, coalesce(b.classification, '(new)') AS before, coalesce(a.classification, 'NOT_IN_EXTRACT') AS now,
CASE WHEN coalesce(b.entity_key, a.entity_key) IN (SELECT k FROM recent) THEN 'Decision recorded' WHEN b.entity_key IS NULL THEN 'New in extract' WHEN NOT a.here THEN 'Status changed' WHEN b.mark IS DISTINCT FROM a.mark THEN 'Data changed' ELSE 'Other' END AS cause
FROM (SELECT entity_key, classification, {_print("items")} AS mark FROM classed) b FULL JOIN (SELECT entity_key, classification, here, {_print("items")} AS mark FROM told) a ON a.entity_key = b.entity_key WHERE coalesce(b.classification, '(new)') <> coalesce(a.classification, 'NOT_IN_EXTRACT')""", _FINAL | {
    "recent": f"SELECT unnest([target_key, related_key, CASE WHEN target_type = 'item' THEN string_split(target_key, '|')[1] || '|' || string_split(target_key, '|')[3] END]) AS k FROM decision_log WHERE recorded_at >= DATE '{_SINCE}'"})

_LOG = "SELECT event_id AS id, 'record' AS target_type, cast(user_id AS string) AS target_key, '' AS related_key, CASE event_id % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'WILL_FIX' WHEN 2 THEN 'AGREE' ELSE 'CLOSE' END AS decision, 'r' AS reason, event_type AS steward FROM events"


def _log(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(_LOG)


_QUERIES["decisions_effective"] = lambda spark, sf_dir: decisions.effective(_log(spark, sf_dir)).select("target_type", "target_key", "id", "decision", "steward")
_SQL["decisions_effective"] = bindings.duck(f"SELECT target_type, target_key, id, decision, steward FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY target_type, target_key ORDER BY id DESC, decision) = 1")
_QUERIES["decisions_governance"] = lambda spark, sf_dir: decisions.governance(_log(spark, sf_dir))
_SQL["decisions_governance"] = bindings.duck(f"SELECT steward, target_type, decision, count(*) AS decisions FROM (SELECT * FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY target_type, target_key ORDER BY id DESC, decision) = 1) GROUP BY ALL")
_QUERIES["decisions_triage"] = lambda spark, sf_dir: decisions.triage(_log(spark, sf_dir).where("id % 10 = 3"), _log(spark, sf_dir).where("id % 10 <> 3")).groupBy("verdict").agg(F.count("*").alias("rows"))
_SQL["decisions_triage"] = bindings.duck(f"SELECT CASE WHEN o.decision = u.decision THEN 'already recorded' WHEN o.decision IS NOT NULL THEN 'changed' ELSE 'new' END AS verdict, count(*) AS rows FROM (SELECT * FROM ({_LOG}) WHERE id % 10 = 3) u LEFT JOIN (SELECT * FROM ({_LOG}) WHERE id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY id DESC) = 1) o USING (target_key) GROUP BY 1")

# Extracts and profiles

_add("extract_account_activity", {"gl_journals"}, lambda f: extracts.account_activity(f["gl_journals"]), "SELECT house, account, min(period) AS earliest_period, max(period) AS latest_period, count(*) AS posting_count FROM gl_journals GROUP BY ALL")
_add("extract_open_transactions", {"asutrans"}, lambda f: extracts.open_transactions(f["asutrans"]).select("house", "apar_id", "voucher_no", "status"), "SELECT house, apar_id, voucher_no, status FROM asutrans WHERE status IS DISTINCT FROM 'C'")
_add("extract_recent_history", {"asuhistr"}, lambda f: extracts.recent_history(f["asuhistr"], AS_OF).select("house", "apar_id", "voucher_no", "trans_date"), f"SELECT house, apar_id, voucher_no, trans_date FROM asuhistr WHERE trans_date >= {DAY} - INTERVAL 18 MONTH")
_add("extract_dimensions_in_use", {"project_financials"}, lambda f: extracts.dimensions_in_use(f["project_financials"].withColumnRenamed("house", "client"), ["unit", "costc", "directorate", "department"]), """
SELECT DISTINCT house AS client, p AS dim_position, v AS dim_value FROM (SELECT house, unnest([{'p': '1', 'v': unit}, {'p': '2', 'v': costc}, {'p': '3', 'v': directorate}, {'p': '4', 'v': department}], recursive := true) FROM project_financials) WHERE coalesce(trim(v), '') <> ''""")
_add("extract_dimension_config", {"agldimvalue"}, lambda f: extracts.dimension_config(f["agldimvalue"].select("client", "attribute_id").distinct(), f["agldimvalue"]), "SELECT client, attribute_id, count(*) AS total_values, count(*) FILTER (status = 'N') AS active, count(*) FILTER (status = 'C') AS closed FROM agldimvalue GROUP BY ALL")
_ADDRESSED = ("address", "place", "zip_code", "province", "last_trans_date")
_add("extract_supplier_master", {"asuheader", "asutrans", "asuhistr"}, lambda f: extracts.master_with_last_transaction(f["asuheader"].drop(*_ADDRESSED), f["asuheader"].withColumn("sequence_no", F.length("address")), f["asutrans"], f["asuhistr"]).select("house", "client", "apar_id", "apar_name", "address", "place", "zip_code", "last_trans_date"), """
SELECT house, client, apar_id, apar_name, address, place, zip_code, t.d AS last_trans_date FROM (SELECT * EXCLUDE (address, place, zip_code) FROM asuheader) h
LEFT JOIN (SELECT client, apar_id, address, place, zip_code FROM asuheader QUALIFY row_number() OVER (PARTITION BY client, apar_id ORDER BY length(address) NULLS FIRST, address NULLS FIRST, zip_code NULLS FIRST) = 1) a USING (client, apar_id)
LEFT JOIN (SELECT client, apar_id, max(trans_date) AS d FROM (SELECT client, apar_id, trans_date FROM asutrans UNION ALL SELECT client, apar_id, trans_date FROM asuhistr) GROUP BY ALL) t USING (client, apar_id)""")
_add("extract_asset_balances", {"aattrans"}, lambda f: extracts.asset_balances(f["aattrans"]), "SELECT client, asset_id, depr_book_id, trans_type, account, sum(amount) AS total_amount, max(trans_date) AS max_trans_date, min(trans_date) AS min_trans_date, count(*) AS transaction_count FROM aattrans WHERE trans_type IS DISTINCT FROM 'CI' AND status IS DISTINCT FROM 'C' GROUP BY ALL")
_add("extract_asset_flags", {"aattrans"}, lambda f: extracts.asset_flags(f["aattrans"]), "SELECT client, asset_id, depr_book_id, trans_type, trans_date, amount FROM aattrans WHERE trans_type IN ('CA', 'SA') UNION ALL SELECT client, asset_id, depr_book_id, trans_type, max(trans_date), NULL FROM aattrans WHERE trans_type IN ('ND', 'ED', 'FD') GROUP BY ALL")
_add("extract_asset_groups", {"asset_groups"}, lambda f: extracts.group_books(f["asset_groups"].groupBy("client", "asset_group").agg(F.min("description").alias("description")), f["asset_groups"].select("client", "asset_group", "depr_book_id", "book_status").distinct()), "SELECT client, asset_group, description, depr_book_id, book_status FROM (SELECT client, asset_group, min(description) AS description FROM asset_groups GROUP BY ALL) LEFT JOIN (SELECT DISTINCT client, asset_group, depr_book_id, book_status FROM asset_groups) USING (client, asset_group)")
_add("extract_asset_master", {"asset_master"}, lambda f: extracts.columns_of(f["asset_master"], ["CA"], ["client", "asset_id", "asset_group", "description", "status", "date_from"]), "SELECT client, asset_id, asset_group, description, status, date_from FROM asset_master WHERE client = 'CA'")
_add("extract_asset_books", {"asset_depreciation"}, lambda f: extracts.columns_of(f["asset_depreciation"], ["CA"], ["client", "asset_id", "depr_book_id", "status", "depr_method", "lifetime"]), "SELECT client, asset_id, depr_book_id, status, depr_method, lifetime FROM asset_depreciation WHERE client = 'CA'")
_add("extract_dimension_values", {"agldimvalue", "agldimension"}, lambda f: extracts.dimension_values(f["agldimvalue"], f["agldimension"].drop("house"), ["CA", "CM"]).select("client", "attribute_id", "dim_position", "dim_description", "dim_value", "description", "rel_value"), "SELECT d.client, d.attribute_id, n.dim_position, n.description AS dim_description, d.dim_value, d.description, d.rel_value FROM agldimvalue d JOIN agldimension n ON n.attribute_id = d.attribute_id AND n.client = d.client AND n.status = 'N' WHERE d.client IN ('CA', 'CM') AND d.status = 'N'")
_add("extract_opening_balances", {"gl_journals"}, lambda f: extracts.opening_balances(f["gl_journals"], ["CA", "CM"], 199901, 199915).select("client", "account", "period", "voucher_type", "amount"), "SELECT client, account, period, voucher_type, amount FROM gl_journals WHERE client IN ('CA', 'CM') AND period BETWEEN 199901 AND 199915 AND voucher_type NOT IN ('BU', 'BV')")
_add("extract_budget_versions", {"aaghocbud"}, lambda f: extracts.budget_versions(f["aaghocbud"], ["CA", "CM"], 199801, 199815).select("client", "period", "account", "cost_centre", "resno", "recharge", "orig_budget", "po_commitment"), "SELECT client, period, dim1 AS account, dim2 AS cost_centre, dim4 AS resno, dim6 AS recharge, pla_amount AS orig_budget, po_rest_com_amt AS po_commitment FROM aaghocbud WHERE client IN ('CA', 'CM') AND period BETWEEN 199801 AND 199815")
_add("extract_order_lines", {"apoheader", "apodetail"}, lambda f: extracts.order_lines(f["apoheader"], f["apodetail"], f["apodetail"]).select("client", "order_id", "line_no", "header_apar_id", "order_date", "category"), """
SELECT client, order_id, line_no, h.apar_id AS header_apar_id, h.order_date AS order_date, category FROM apodetail JOIN (SELECT client, order_id, min({'apar_id': apar_id, 'order_date': order_date}) AS h FROM apoheader GROUP BY ALL) USING (client, order_id) LEFT JOIN (SELECT art_gr_id, min(art_gr_description) AS category FROM apodetail WHERE art_gr_id IS NOT NULL GROUP BY 1) USING (art_gr_id)""")
_add("order_states", {"apoheader"}, lambda f: extracts.value_counts(f["apoheader"].where(F.col("client").isin("CA", "CM")), "status", "wf_state"), "SELECT status, wf_state, count(*) AS rows FROM apoheader WHERE client IN ('CA', 'CM') GROUP BY ALL")
_add("extract_fiscal_year", {"gl_journals"}, lambda f: extracts.fiscal_year(f["gl_journals"], 2000).select("house", "client", "voucher_no", "sequence_no", "account", "period"), "SELECT house, client, voucher_no, sequence_no, account, period FROM gl_journals WHERE fiscal_year = 2000")
_add("profile_first_entries", {"asset_master"}, lambda f: extracts.first_entries(f["asset_master"], ["cap_date_from", "date_from", "date_to", "org_amt_date"], table="asset_master"), " UNION ALL ".join(f"SELECT 'asset_master' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, count(*) FILTER ({c} <= DATE '1900-01-02') AS placeholders, min({c}) FILTER ({c} > DATE '1900-01-02')::DATE AS earliest FROM asset_master" for c in ("cap_date_from", "date_from", "date_to", "org_amt_date")))
_add("profile_budgets", {"budgets_report"}, lambda f: extracts.profile(f["budgets_report"], ["gl_actuals", "orig_budget", "curr_budget", "live_forecast"]).drop("populated"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} < 0) AS negative, count(*) FILTER ({c} = 0) AS zero, count(*) FILTER ({c} > 0) AS positive, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest, sum({c}) AS total, count(DISTINCT {c}) AS distinct_values FROM budgets_report" for c in ("gl_actuals", "orig_budget", "curr_budget", "live_forecast")))
_WIDE = ("house", "client", "order_id", "line_no", "sequence_no", "apar_id", "status", "account", "art_gr_id", "art_gr_description", "contract_id", "amend_no", "amount", "com_amount", "invoiced", "arr_amount", "vow_amount", "vow_val", "unit_price", "deliv_date")
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN coalesce(trim({c}::VARCHAR), '') NOT IN ('', 'nan', 'None', 'NaT') THEN trim({c}::VARCHAR) END AS value, count(*) AS n FROM apodetail GROUP BY 2" for c in _WIDE)
_NUMBER = "try_cast(value AS DECIMAL(28, 6))"
_add("profile_order_lines", {"apodetail"}, lambda f: extracts.profile_columns(extracts.counted(f["apodetail"], _WIDE)), f"""SELECT "column", sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (value IS NOT NULL), 0)::BIGINT AS filled, coalesce(sum(n) FILTER (value IS NOT NULL), 0)::DOUBLE / sum(n) AS populated, count(value) AS distinct_values,
 {", ".join(f"coalesce(sum(n) FILTER ({_NUMBER} {o} 0), 0)::BIGINT AS {name}" for o, name in (("<", "negative"), ("=", "zero"), (">", "positive")))}, min({_NUMBER})::DOUBLE AS least, max({_NUMBER})::DOUBLE AS greatest, sum({_NUMBER} * n)::DOUBLE AS total FROM ({_CELLS}) GROUP BY 1""")
_add("profile_order_line_values", {"apodetail"}, lambda f: extracts.top_values(extracts.counted(f["apodetail"], _WIDE)), f"SELECT \"column\", rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value NULLS FIRST) AS rank FROM ({_CELLS})) WHERE rank <= 20")
_add("value_counts_orders", {"apoheader"}, lambda f: extracts.value_counts(f["apoheader"], "status", "amend_no"), "SELECT status, amend_no, count(*) AS rows FROM apoheader GROUP BY ALL")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    if "evidence_ap" not in _SQL:
        _evidence_sql()
    return dict(_SQL)
