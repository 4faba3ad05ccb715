"""The failing rows of all checks at once: a table is scanned once (twice where `apart`), and a row is given once for each check that it fails.

What is shown of a row: what it is known by (KEYS), then the columns that the
check's rule reads, in the table's order. Both follow from the rule, so a check
needs no list of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.checks import core
from finscope.clean import evidence_text

#: What the rows of a table are known by.
KEYS = {
    "asuheader": "client apar_id apar_name", "acuheader": "client apar_id apar_name", "asutrans": "client apar_id voucher_no sequence_no", "acutrans": "client apar_id voucher_no sequence_no", "asuhistr": "client apar_id voucher_no sequence_no", "acuhistr": "client apar_id voucher_no sequence_no",
    "apoheader": "client order_id", "apodetail": "client order_id line_no sequence_no", "aglaccounts": "client account", "agldimvalue": "client attribute_id dim_value", "gl_dimconfig": "client attribute_id", "gl_transact_dim": "client dim_position dim_value", "gl_journals": "client voucher_no sequence_no",
    "aglyearend": "client account dim_1", "gl_budgets": "client account dim_1", "asset_master": "client asset_id", "asset_depreciation": "client asset_id depr_book_id", "asset_groups": "client asset_group depr_book_id", "asset_balances": "client asset_id depr_book_id trans_type", "asset_trans_flags": "client asset_id trans_type",
    "atamis_contracts": "contract_ref", "atamis_suppliers": "supplier_name creditor_ref", "unit4_commitments": "u4_contract_id", "unit4_spend": "u4_contract_id", "budgets_report": "account haiscode costc period", "employee_master": "employee_id", "payroll_transactions": "payroll_id employee_id",
    "asset_nbv": "client asset_id", "project_codes": "hais_code unit", "project_units": "unit house", "project_commitments": "unit hais_code house period",
}
_NAME = re.compile(r"\b[a-z_][a-z0-9_]*\b")


def shown(check: core.Check, columns: list[str]) -> list[str]:
    """Columns of a table's rows that a failure of the check shows."""
    texts, todo = [check.fails], core.used(check.fails)
    while todo:
        ref = core._REFS[todo.pop()]
        own = [k if isinstance(k, str) else k[1] for k in ref.keys]
        texts += own
        todo += core.used(" ".join(own))
    read = set(_NAME.findall(re.sub(r"'[^']*'", "", " ".join(texts))))
    known = [c for c in KEYS.get(check.table, "").split() if c in columns]
    return known + [c for c in columns if c in read and c not in known and c != "house"]


def failing(frames: dict[str, DataFrame], checks: list[core.Check], as_of: str, apart: tuple = ()) -> DataFrame:
    """(check_id, dimension, severity, house, evidence): every failing row of every check, as 'column: value' texts. Checks on missing tables are left out.

    apart: large tables whose checks without values from elsewhere have a scan of
    their own, which shuffles nothing; the rows that the other checks shuffle for
    each of those values then hold only what these read.
    """
    parts = []
    sets = {t: [c for c in checks if c.table == t] for t in dict.fromkeys(c.table for c in checks) if t in frames}
    alone = {t: {c.id for c in own if not core.used(c.fails + c.population)} if t in apart else set() for t, own in sets.items()}
    for table, own in [(t, kept) for t, own in sets.items() for kept in ([c for c in own if c.id in alone[t]], [c for c in own if c.id not in alone[t]]) if kept]:
        columns = frames[table].columns
        rows = core.annotated(frames, table, own, as_of)
        found = [F.when(F.col(f"f_{i}"), F.struct(F.lit(c.id).alias("check_id"), F.lit(c.dimension).alias("dimension"), F.lit(c.severity).alias("severity"), evidence_text(shown(c, columns)).alias("evidence"))) for i, c in enumerate(own)]
        parts.append(rows.select("house", F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.check_id", "e.dimension", "e.severity", "house", "e.evidence"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
