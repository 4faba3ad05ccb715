"""DuckDB SQL for the results of a list of checks, by one plain query for each check."""

from __future__ import annotations

from finscope import bindings
from finscope.checks import core


def _in_place(sql: str, alias: str, as_of: str) -> str:
    """sql with each value from elsewhere written as a subquery or a window."""
    sql = core.dated(sql, as_of)
    for name in core.used(sql):
        ref = core._REFS[name]
        if ref.kind == "repeated":
            where = _in_place(ref.where, alias, as_of)
            text = f"(sum(CASE WHEN {where} THEN 1 ELSE 0 END) OVER (PARTITION BY {', '.join(['house', *[_in_place(k, alias, as_of) for k in ref.keys]])}, ({where})) > 1)"
        else:
            on = " AND ".join(f"o{name[-6:]}.k{i} = {_in_place(e, alias, as_of)}" for i, (_, e) in enumerate(ref.keys))
            keys = ", ".join(f"{c} AS k{i}" for i, (c, _) in enumerate(ref.keys))
            by = ", ".join(str(i + 1) for i in range(len(ref.keys)))
            inner = f"SELECT {keys}, {core.dated(ref.value, as_of)} AS v FROM {ref.table} WHERE {_in_place(ref.where, alias, as_of)} GROUP BY {by}"
            text = f"(SELECT v FROM ({inner}) o{name[-6:]} WHERE {on})"
        sql = sql.replace(name, text)
    return sql


def results_sql(checks: list[core.Check], as_of: str, sources=(), made: dict[str, str] | None = None) -> str:
    """made: SQL of the checks' tables that aren't finance tables themselves, over those of `sources`."""
    parts, tables = [], {c.table for c in checks} | core.needs(checks) | set(sources)
    for c in checks:
        population, fails = _in_place(c.population, "t", as_of), _in_place(c.fails, "t", as_of)
        parts.append(f"""SELECT '{c.id}' AS check_id, '{c.domain}' AS domain, '{c.object}' AS object, '{c.dimension}' AS dimension, '{c.severity}' AS severity, house, count(*) FILTER (p) AS total, count(*) FILTER (p AND f) AS failing
FROM (SELECT house, coalesce({population}, false) AS p, coalesce({fails}, false) AS f FROM {c.table}) GROUP BY house""")
    cases = lambda i: "CASE severity " + " ".join(f"WHEN '{s}' THEN {t[i]}" for s, t in core.RAG.items()) + " END"
    sql = f"""SELECT *, CASE WHEN error_rate <= {cases(0)} THEN 'Green' WHEN error_rate <= {cases(1)} THEN 'Amber' ELSE 'Red' END AS rag
FROM (SELECT *, round_even(100.0::DOUBLE - error_rate, 1) AS pass_rate FROM (
  SELECT *, total - failing AS passing, round_even(failing * 100.0::DOUBLE / total, 1) AS error_rate FROM ({' UNION ALL '.join(parts)}) WHERE total > 0))"""
    return bindings.with_tables(tables, sql, made)


def evidence_sql(checks: list[core.Check], as_of: str, columns: dict[str, list[str]], sources=(), made: dict[str, str] | None = None) -> str:
    """How many rows fail each check by house, and a sum over hashes of what is shown of them. columns: those shown, by check."""
    parts, tables = [], {c.table for c in checks} | core.needs(checks) | set(sources)
    shown = lambda c: f"'{c}: ' || CASE WHEN coalesce(trim({c}::VARCHAR), '') IN ('', 'nan', 'None', 'NaT') THEN '(blank)' ELSE {c}::VARCHAR END"
    for c in checks:
        bad = _in_place(f"({c.population}) AND ({c.fails})", "t", as_of)
        text = " || ' - ' || ".join(shown(x) for x in columns[c.id])
        parts.append(f"SELECT '{c.id}' AS check_id, house, count(*) AS rows, sum(('0x' || md5(told)[1:8])::BIGINT)::BIGINT AS told FROM (SELECT house, {text} AS told, coalesce({bad}, false) AS bad FROM {c.table}) WHERE bad GROUP BY house")
    return bindings.with_tables(tables, " UNION ALL ".join(parts), made)
