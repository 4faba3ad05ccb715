"""Finance tables derived from the driver's star schema, in SQL that Spark and DuckDB both take.

Dirt is planted by integer arithmetic on the keys only, and amounts are decimals,
so both engines make the same rows. AS_OF is the day everything is judged on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-12-31"
SOURCES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Columns of those tables, for SQL that depends on what columns a table has.
SOURCE_COLUMNS = {
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
}
MONEY = "decimal(18, 2)"


PRICE = f"cast(l_extendedprice AS {MONEY})"


def money(x: str) -> str:
    return f"cast({x} AS {MONEY})"


def text(x: str) -> str:
    return f"cast({x} AS string)"


def whole(x: str) -> str:
    return f"cast(floor({x}) AS bigint)"


def house(k: str) -> str:
    return f"CASE WHEN {k} % 2 = 0 THEN 'HOC' ELSE 'HOL' END"


def client(k: str) -> str:
    return f"CASE WHEN {k} % 2 = 1 THEN 'LA' WHEN {k} % 4 = 0 THEN 'CA' ELSE 'CM' END"


def pick(k: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {k} % {len(values)} {cases} END"


def unless(condition: str, x: str) -> str:
    return f"CASE WHEN NOT ({condition}) THEN {x} END"


def party(k: str) -> str:
    """Ids of suppliers and customers: every fiftieth repeats another one's."""
    return text(f"CASE WHEN {k} % 50 = 7 THEN {k} - 4 ELSE {k} END + 10000")


def _word(h: str) -> str:
    """A word of four syllables for a number below 65,536."""
    return " || ".join(f"substring('bacedifoguhajekilomunaperisotuve', cast(1 + 2 * ({whole(f'{h} / {16**i}')} % 16) AS int), 2)" for i in range(4))


#: Names unlike those of near numbers; one customer in twenty-five bears another one's with a letter more.
_LIKE = "(CASE WHEN c_custkey % 25 = 9 THEN c_custkey - 14 ELSE c_custkey END)"
COMPANY = f"""{_word(f"({_LIKE} * 40503 % 65536)")} || ' ' || {_word(f"(({_LIKE} * 30011 + 777) % 65536)")} || CASE WHEN c_custkey % 25 = 9 THEN 's' ELSE '' END || {pick(_LIKE, "' Trading'", "' Supplies Ltd'", "' Works'")}"""


def record(k: str) -> str:
    return f"{house(f'({k})')} || '|' || {party(f'({k})')}"


def _decision(n: int, kind: str, target: str, decision: str, source: str, where: str, related: str = "''", k: str = "c_custkey") -> str:
    return f"""SELECT {k} * 10 + {n} AS id, '{kind}' AS target_type, {target} AS target_key, {related} AS related_key, {decision} AS decision, 'r' AS reason, 'S' || {text(f"{k} % 5")} AS steward,
  DATE '2001-06-01' + cast({k} % 200 AS int) AS recorded_at, {pick(k, "'CLOSE'", "'KEEP'", "'FIX'", "'MONITOR'")} AS recommendation, 'Label ' || {text(k)} AS record_label FROM {source} WHERE {where}"""


def _master(k: str, extra: str, source: str, name: str) -> str:
    return f"""SELECT {house(k)} AS house, {client(k)} AS client, {party(k)} AS apar_id,
  CASE WHEN {k} % 41 = 3 THEN 'Acme Limited' WHEN {k} % 97 = 8 THEN 'SZSINGLES' ELSE {name} END AS apar_name,
  {pick(k, "'TR'", "'SA'", "'ME'", "'SC'", "'TR'", "'TR'", "'EM'")} AS apar_gr_id,
  CASE WHEN {k} % 11 = 4 THEN 'C' WHEN {k} % 29 = 6 THEN 'P' ELSE 'N' END AS status,
  CASE WHEN {k} % 7 = 1 THEN NULL WHEN {k} % 19 = 2 THEN 'GB12' WHEN {k} % 23 = 5 THEN 'GB123456789' ELSE 'GB' || {text(f"100000000 + {k}")} END AS vat_reg_no,
  CASE WHEN {k} % 5 = 1 THEN NULL WHEN {k} % 17 = 3 THEN '0' WHEN {k} % 13 = 2 THEN 'SC' || {text(f"100000 + {k} % 900000")} ELSE {text(f"10000000 + {k} % 80000000")} END AS comp_reg_no,
  {unless(f"{k} % 31 = 4", pick(k, "'30'", "'14'"))} AS terms_id,
  {unless(f"{k} % 37 = 5", pick(k, "'IP'", "'CP'", "'IN'", "'CH'", "'FC'", "'PO'", "'BB'"))} AS pay_method,
  {unless(f"{k} % 43 = 6", pick(k, "'GBP'", "'GBP'", "'EUR'"))} AS currency, {extra} FROM {source}"""


def _transactions(kind: str, where: str) -> str:
    k = "o_orderkey"
    return f"""SELECT {house("o_custkey")} AS house, {client("o_custkey")} AS client, {party("o_custkey + CASE WHEN o_orderkey % 83 = 9 THEN 100000000 ELSE 0 END")} AS apar_id,
  {text(f"CASE WHEN {k} % 101 = 3 THEN {k} - 2 ELSE {k} END")} AS voucher_no, {text("o_orderkey % 2")} AS sequence_no,
  {pick(k, "'PI'", "'SI'", "'CN'", "'DR'", "'OP'")} AS voucher_type, {unless(f"{k} % 47 = 1", f"'REF' || {text(f'{k} % 4000')}")} AS ext_inv_ref,
  {pick(k, "'N'", "'R'", "'I'", "'C'", "'P'")} AS status, {pick(k, "'GBP'", "'GBP'", "'GBP'", "'USD'")} AS currency,
  CASE WHEN {k} % 3 = 0 THEN {text(k)} END AS order_id, CASE WHEN {k} % 5 = 0 THEN {text("o_custkey")} END AS contract_id,
  CASE WHEN {k} % 2 = 0 THEN {text(f"{k} - 1")} END AS orig_reference, CASE WHEN {k} % 6 <> 0 THEN '1' END AS intrule_id,
  cast({k} % 5 AS int) AS rem_level, {pick(k, "'1'", "'0'", "NULL")} AS pay_flag, CASE WHEN {k} % 9 <> 0 THEN {money("1.25")} END AS exch_rate,
  {unless(f"{k} % 59 = 2", "cast(o_orderdate AS date)")} AS trans_date, {unless(f"{k} % 53 = 2", "cast(o_orderdate AS date) + 30")} AS due_date,
  {unless(f"{k} % 61 = 2", f"CASE WHEN {k} % 8 = 3 THEN -1 ELSE 1 END * " + money("o_totalprice"))} AS amount,
  {unless(f"{k} % 9 = 1", money("o_totalprice"))} AS cur_amount,
  CASE WHEN {k} % 4 = 0 THEN {money("0")} WHEN {k} % 71 = 3 THEN {money("o_totalprice")} + 5 WHEN {k} % 8 = 3 THEN -1 * {money("o_totalprice")} ELSE {money("o_totalprice")} END AS rest_amount
FROM orders WHERE {where}"""


CONTACT = f"""CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS apar_once,
  CASE c_nationkey % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'NL' WHEN 4 THEN 'IE' ELSE 'XX' END AS country_code,
  {unless("c_custkey % 12 = 1", "CASE WHEN c_custkey % 15 = 2 THEN '1-20-30' WHEN c_custkey % 16 = 2 THEN '12 34' ELSE '20-00-' || " + text("10 + c_custkey % 90") + " END")} AS clearing_code,
  {unless("c_custkey % 10 = 1", "CASE WHEN c_custkey % 21 = 2 THEN '12345678' WHEN c_custkey % 22 = 3 THEN '12A' ELSE " + text("10000000 + c_custkey % 90000000") + " END")} AS bank_account,
  CASE WHEN c_custkey % 4 = 1 THEN 'GB29NWBK' || {text("60161331926819 + c_custkey")} END AS iban,
  CASE WHEN c_custkey % 8 = 1 THEN 'NWBKGB2L' WHEN c_custkey % 8 = 2 THEN 'nope' END AS swift,
  CASE WHEN c_custkey % 14 = 3 THEN '' WHEN c_custkey % 41 = 3 THEN '1 High St' ELSE {text("c_custkey")} || ' Low Road' END AS address,
  {unless("c_custkey % 18 = 4", "'Town ' || " + text("c_nationkey"))} AS place,
  {unless("c_custkey % 20 = 5", "CASE c_nationkey % 5 WHEN 0 THEN 'SW1A 1AA' WHEN 1 THEN '12345' WHEN 2 THEN '1234 AB' WHEN 3 THEN 'D02 X285' ELSE 'bad' END")} AS zip_code,
  cast(NULL AS string) AS province, DATE '1999-01-01' + cast(c_custkey % 1000 AS int) AS last_update, DATE '1999-06-01' + cast(c_custkey % 900 AS int) AS last_trans_date"""
CREDIT = f"""CASE WHEN c_custkey % 9 = 1 THEN NULL WHEN c_custkey % 3 = 0 THEN {money("c_acctbal")} ELSE {money("0")} END AS credit_limit,
  CASE WHEN c_custkey % 26 = 3 THEN DATE '2000-01-01' END AS expired_date, DATE '1999-03-01' + cast(c_custkey % 1000 AS int) AS last_update, cast(c_custkey % 3 AS int) AS collect_flag,
  CASE WHEN c_custkey % 6 = 1 THEN {party("c_custkey % 700")} WHEN c_custkey % 33 = 2 THEN 'none' END AS main_apar_id"""

_LINE = "l_orderkey * 8 + l_linenumber"
_ASSET = text("l_partkey")
_PERIOD = "cast(extract(year FROM l_shipdate) * 100 + extract(month FROM l_shipdate) AS int)"
_UNIT = "l_partkey % 40"

TABLES: dict[str, str] = {
    "asuheader": _master("c_custkey", CONTACT, "customer", COMPANY),
    "asutrans": _transactions("AP", "o_orderstatus = 'P'"),
    "asuhistr": _transactions("AP", "o_orderstatus <> 'P' AND o_orderkey % 2 = 0"),
    "acuheader": _master("c_custkey", CREDIT, "customer", "c_name"),
    "acutrans": _transactions("AR", "o_orderstatus = 'O'"),
    "acuhistr": _transactions("AR", "o_orderstatus <> 'O' AND o_orderkey % 2 = 1"),
    "aglaccounts": f"""SELECT {house("p_partkey")} AS house, {client("p_partkey")} AS client, {text("5000 + CASE WHEN p_partkey % 90 = 8 THEN p_partkey - 4 ELSE p_partkey END")} AS account,
  {unless("p_partkey % 27 = 3", "p_name")} AS description, {unless("p_partkey % 22 = 3", "p_brand")} AS account_grp, {pick("p_partkey", "'GL'", "'AP'", "'AR'", "'XX'")} AS account_type,
  CASE WHEN p_partkey % 13 = 5 THEN 'C' ELSE 'N' END AS status, {pick("p_partkey", "'R'", "'B'", "'Q'", "''", "NULL")} AS res_bal, {unless("p_partkey % 16 = 3", "'1'")} AS account_rule,
  DATE '1995-01-01' + cast(p_partkey % 1500 AS int) AS period_from, {unless("p_partkey % 3 = 0", "DATE '1998-01-01' + cast(p_partkey % 2500 AS int)")} AS period_to FROM part""",
    "agldimvalue": f"""SELECT {house("p_partkey")} AS house, {client("p_partkey")} AS client, 'A' || {text("p_partkey % 3")} AS attribute_id, {text("p_partkey % 3")} AS dim_position,
  {text("CASE WHEN p_partkey % 150 = 13 THEN p_partkey - 12 ELSE p_partkey END")} AS dim_value,
  CASE WHEN p_partkey % 35 = 2 THEN NULL WHEN p_partkey % 36 = 3 THEN 'Do not use ' || p_name ELSE p_name END AS description, CASE WHEN p_partkey % 12 = 5 THEN 'C' ELSE 'N' END AS status,
  CASE WHEN p_partkey % 60 = 1 THEN {text("p_partkey")} WHEN p_partkey % 77 = 2 THEN 'gone' WHEN p_partkey >= 12 AND p_partkey % 5 <> 0 THEN {text("p_partkey - 12 * (1 + p_partkey % 4)")} END AS rel_value,
  CASE WHEN p_partkey % 14 <> 1 THEN cast(199501 + p_partkey % 700 AS int) END AS period_from, CASE WHEN p_partkey % 4 = 1 THEN cast(199801 + p_partkey % 300 AS int) END AS period_to FROM part""",
    "gl_dimconfig": f"""SELECT {house("p_partkey")} AS house, {client("p_partkey")} AS client, 'A' || {text("p_partkey")} AS attribute_id, {unless("p_partkey % 9 = 2", "p_name")} AS description,
  {text("p_partkey % 10")} AS dim_position, cast(p_partkey % 5 AS bigint) AS active, cast(p_partkey % 3 AS bigint) AS closed FROM part WHERE p_partkey % 10 = 3 OR p_partkey % 10 = 8""",
    "gl_transact_dim": f"""SELECT DISTINCT {house("l_partkey")} AS house, {client("l_partkey")} AS client, {text("l_partkey % 3")} AS dim_position, {text("l_partkey")} AS dim_value FROM lineitem""",
    "aglyearend": f"""SELECT {house("l_partkey")} AS house, {client("l_partkey")} AS client, {text("5000 + l_partkey + CASE WHEN l_orderkey % 60 = 1 THEN 9000000 ELSE 0 END")} AS account, {unless("l_orderkey % 7 = 1", text("l_partkey + CASE WHEN l_orderkey % 50 = 3 THEN 7000000 ELSE 0 END"))} AS dim_1,
  {unless("l_orderkey % 44 = 2", money("CASE WHEN l_orderkey % 3 = 1 THEN -1 ELSE 1 END * l_extendedprice"))} AS amount, {pick("l_orderkey", "1", "-1", "1", "1", "-1", "NULL")} AS dc_flag FROM lineitem WHERE l_linenumber = 1""",
    "gl_budgets": f"""SELECT {house("l_partkey")} AS house, {client("l_partkey")} AS client, {text("5000 + l_partkey + CASE WHEN l_orderkey % 70 = 1 THEN 9000000 ELSE 0 END")} AS account, {unless("l_orderkey % 8 = 1", text("l_partkey"))} AS dim_1,
  {unless("l_orderkey % 45 = 2", money("l_extendedprice"))} AS amount FROM lineitem WHERE l_linenumber = 2""",
    "gl_journals": f"""SELECT {house("l_partkey")} AS house, {client("l_partkey")} AS client, {unless("l_orderkey % 500 = 2", text("l_orderkey"))} AS voucher_no, {text("l_linenumber")} AS sequence_no,
  {unless("l_orderkey % 300 = 3", text("5000 + l_partkey + CASE WHEN l_orderkey % 80 = 1 THEN 9000000 ELSE 0 END"))} AS account, {pick("l_orderkey", "'GI'", "'ZR'", "'FA'", "'GI'")} AS voucher_type,
  CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE {text("l_suppkey")} END AS apar_id, {unless("l_orderkey % 400 = 4", "'U' || " + text("l_suppkey % 9"))} AS user_id,
  cast(l_shipdate AS date) AS trans_date, {_PERIOD} AS period, cast(extract(year FROM l_shipdate) AS int) AS fiscal_year, {unless("l_orderkey % 600 = 5", money("l_extendedprice"))} AS amount FROM lineitem""",
    "gl_active_accounts": f"""SELECT {house("l_partkey")} AS house, {text("5000 + l_partkey")} AS account, min({_PERIOD}) AS earliest_period, max({_PERIOD}) AS latest_period, count(*) AS posting_count FROM lineitem WHERE l_partkey % 6 = 1 GROUP BY 1, 2""",
    "gl_planner_accounts": f"""SELECT {house("l_partkey")} AS house, {text("5000 + l_partkey")} AS account, count(*) AS entry_count FROM lineitem WHERE l_partkey % 10 = 3 GROUP BY 1, 2""",
    "asset_groups": f"""SELECT {house("p_partkey")} AS house, {client("p_partkey")} AS client, CASE WHEN p_partkey % 120 = 5 THEN '' ELSE 'G' || {text("p_partkey % 60")} END AS asset_group,
  {unless("p_partkey % 17 = 4", "p_name")} AS description, CASE WHEN p_partkey % 9 = 1 THEN 'C' ELSE 'N' END AS grp_status, {pick("p_partkey", "'LNA'", "'LNB'", "'NON'")} AS depr_method,
  {unless("p_partkey % 5 = 1", money("p_size * 3"))} AS depr_percent, {unless("p_partkey % 6 = 3", "cast(p_size % 12 AS int)")} AS lifetime, {pick("p_partkey", "'CURR'", "'HIST'")} AS depr_book_id, CASE WHEN p_partkey % 4 = 1 THEN 'C' ELSE 'N' END AS book_status FROM part WHERE p_partkey % 4 < 2""",
    "asset_master": f"""SELECT {house("p_partkey")} AS house, {client("p_partkey")} AS client, {text("CASE WHEN p_partkey % 130 = 9 THEN p_partkey - 4 ELSE p_partkey END")} AS asset_id, CASE WHEN p_partkey % 28 = 3 THEN '' ELSE p_name END AS description,
  {unless("p_partkey % 32 = 3", "'g' || " + text("p_partkey % 64"))} AS asset_group, {pick("p_partkey", "'N'", "'N'", "'P'", "'C'", "'T'", "'X'", "'N'")} AS status, {text("10000 + p_partkey % 2000")} AS apar_id,
  CASE WHEN p_partkey % 5 = 1 THEN {text("p_partkey % 500")} END AS parent_asset, {unless("p_partkey % 3 = 1", "'D1'")} AS dim_1, cast(p_partkey % 2 AS int) AS grant_flag,
  {unless("p_partkey % 7 = 2", "DATE '1996-01-01' + cast(p_partkey % 800 AS int)")} AS cap_date_from, {unless("p_partkey % 46 = 2", "DATE '1996-01-01' + cast(p_partkey * 3 % 900 AS int)")} AS date_from,
  CASE WHEN p_partkey % 4 = 1 THEN DATE '1996-06-01' + cast(p_partkey * 7 % 1900 AS int) END AS date_to, {unless("p_partkey % 6 = 2", "DATE '1996-01-01' + cast(p_partkey * 5 % 1700 AS int)")} AS org_amt_date,
  DATE '2000-01-01' + cast(p_partkey % 1000 AS int) AS last_update, {money("p_retailprice")} AS org_amount, {money("CASE WHEN p_partkey % 21 = 4 THEN -1 ELSE 1 END * p_retailprice")} AS base_amount FROM part""",
    "asset_depreciation": f"""SELECT {house("p_partkey")} AS house, {client("p_partkey")} AS client, {text("p_partkey + CASE WHEN p_partkey % 110 = 3 THEN 5000000 WHEN p_partkey % 140 = 9 THEN -4 ELSE 0 END")} AS asset_id, book AS depr_book_id,
  {pick("p_partkey", "'N'", "'N'", "'P'", "'C'", "'T'", "'X'", "'N'")} AS status, CASE WHEN p_partkey % 19 = 3 THEN '' ELSE {pick("p_partkey", "'LNA'", "'LNB'", "'NON'")} END AS depr_method,
  cast(p_size % 10 AS int) AS lifetime, cast(p_partkey % 2 AS int) AS cap_flag, {unless("p_partkey % 24 = 3", "cast(p_partkey % 12 AS int)")} AS depr_period,
  CASE WHEN p_partkey % 18 = 3 THEN NULL WHEN p_partkey % 25 = 3 THEN {money("-5")} ELSE {money("p_size * 3")} END AS depr_percent, {money("p_partkey % 1500")} AS res_value,
  {unless("p_partkey % 7 = 3", "DATE '1996-01-01' + cast(p_partkey % 800 + CASE WHEN p_partkey % 8 = 1 THEN 1 ELSE 0 END AS int)")} AS cap_date_from, DATE '1996-01-01' + cast(p_partkey * 3 % 900 AS int) AS date_from,
  CASE WHEN p_partkey % 4 = 1 THEN DATE '1996-06-01' + cast(p_partkey * 7 % 1900 AS int) END AS date_to, DATE '2000-01-01' + cast(p_partkey % 1000 AS int) AS last_update
FROM part CROSS JOIN (SELECT 'CURR' AS book UNION ALL SELECT 'HIST' AS book) b WHERE p_partkey % 15 <> 7 AND (book = 'CURR' OR p_partkey % 3 <> 2)""",
    "asset_balances": f"""SELECT {house("l_partkey")} AS house, {client("l_partkey")} AS client, {_ASSET} AS asset_id, CASE l_returnflag WHEN 'A' THEN 'CURR' WHEN 'N' THEN 'HIST' ELSE CASE WHEN l_partkey % 40 = 1 THEN '' ELSE 'CURR' END END AS depr_book_id,
  CASE WHEN l_partkey % 55 = 3 THEN '' ELSE {pick("l_suppkey + l_partkey", "'CA'", "'OS'", "'ND'", "'SA'", "'ED'", "'TC'", "'PC'")} END AS trans_type, {pick("l_suppkey", "'11200'", "'11215'", "'70000'", "'24500.0'", "'12200'")} AS account,
  CASE WHEN l_partkey % 65 = 3 THEN NULL ELSE sum({money("CASE WHEN l_partkey % 30 = 2 THEN 0 WHEN l_suppkey % 5 = 1 THEN -1 * l_extendedprice ELSE l_extendedprice END")}) END AS total_amount, max(cast(l_shipdate AS date)) AS max_trans_date, count(*) AS transaction_count
FROM lineitem WHERE l_partkey % 16 <> 5 GROUP BY 1, 2, 3, 4, 5, 6, l_partkey""",
    "asset_trans_flags": f"""SELECT {house("l_partkey")} AS house, {client("l_partkey")} AS client, {_ASSET} AS asset_id, {pick("l_suppkey", "'CA'", "'SA'", "'ND'", "'ED'")} AS trans_type, cast(l_shipdate AS date) + CASE WHEN l_partkey % 35 = 1 THEN 900 ELSE 0 END AS trans_date,
  {money("CASE WHEN l_partkey % 26 = 1 THEN 0 ELSE l_extendedprice END")} AS amount FROM lineitem WHERE l_linenumber <= 2""",
    "apoheader": f"""SELECT 'HOC' AS house, {pick("o_custkey", "'CA'", "'CM'")} AS client, {text("CASE WHEN o_orderkey % 200 = 9 THEN o_orderkey - 1 ELSE o_orderkey END")} AS order_id,
  CASE WHEN o_orderkey % 51 = 3 THEN '' WHEN o_orderkey % 52 = 3 THEN 'nobody' ELSE {party("o_custkey")} END AS apar_id, {pick("o_orderkey", "'O'", "'N'", "'A'", "'F'", "'C'", "'T'", "'F'")} AS status,
  CASE WHEN o_orderkey % 4 = 1 THEN 'K' || {text("o_custkey")} END AS contract_id, {unless("o_orderkey % 5 = 2", "'R' || " + text("o_custkey % 30"))} AS responsible, cast(o_orderkey % 4 AS int) AS amend_no, {pick("o_custkey", "'T'", "'W'", "''", "NULL")} AS wf_state,
  CASE WHEN o_orderkey % 63 = 3 THEN NULL WHEN o_orderkey % 64 = 3 THEN cast(o_orderdate AS date) + 3000 ELSE cast(o_orderdate AS date) END AS order_date, CASE WHEN o_orderkey % 66 = 3 THEN {money("0")} ELSE {money("1")} END AS exch_rate FROM orders""",
    "apodetail": f"""SELECT 'HOC' AS house, {pick("o_custkey", "'CA'", "'CM'")} AS client, {text("l_orderkey")} AS order_id, {text("l_linenumber")} AS line_no, '0' AS sequence_no, {party("o_custkey")} AS apar_id,
  {pick("l_orderkey", "'O'", "'N'", "'A'", "'F'", "'C'", "'T'", "'O'")} AS status, {text("5000 + l_partkey + CASE WHEN l_orderkey % 90 = 1 THEN 9000000 ELSE 0 END")} AS account, {unless("l_partkey % 20 = 3", "'C' || " + text("l_partkey % 25"))} AS art_gr_id,
  'Category ' || {text("l_partkey % 25")} AS art_gr_description, CASE WHEN l_orderkey % 4 = 1 THEN 'K' || {text("o_custkey + l_linenumber % 2")} END AS contract_id, cast(l_orderkey % 4 AS int) AS amend_no,
  {money("CASE WHEN l_partkey % 70 = 3 THEN -1 ELSE 1 END * l_extendedprice")} AS amount, {money("l_extendedprice * (1 + l_orderkey % 2)")} AS com_amount,
  CASE WHEN l_suppkey % 3 = 1 THEN {money("l_extendedprice")} WHEN l_suppkey % 11 = 1 THEN {money("l_extendedprice * 2")} ELSE {money("0")} END AS invoiced, CASE WHEN l_suppkey % 4 = 1 THEN {money("l_extendedprice")} END AS arr_amount,
  {money("l_extendedprice")} AS vow_amount, {money("l_quantity")} AS vow_val, {money("floor(l_extendedprice * 100 / l_quantity + 0.5) / 100")} AS unit_price, {unless("l_partkey % 10 = 9", "cast(l_shipdate AS date)")} AS deliv_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "unit4_commitments": f"""SELECT CASE WHEN o_custkey % 9 = 4 THEN 'Unknown' ELSE {house("o_custkey")} END AS house, CASE WHEN o_custkey % 58 = 3 THEN '' ELSE 'K' || {text("o_custkey")} END AS u4_contract_id, {unless("o_custkey % 25 = 3", party("o_custkey"))} AS supplier_id,
  min(cast(o_orderdate AS date)) AS date_from, CASE WHEN o_custkey % 34 = 3 THEN DATE '1990-01-01' ELSE max(cast(o_orderdate AS date)) END AS date_to, sum({money("o_totalprice")}) AS award_amount, sum({money("o_totalprice")}) + 1000 AS amount_limit,
  {money("0")} + CASE WHEN o_custkey % 8 = 1 THEN -500 ELSE 1000 END AS remaining_amount, sum(CASE WHEN o_orderstatus = 'F' THEN {money("o_totalprice")} ELSE {money("0")} END) AS posted_amount FROM orders GROUP BY o_custkey""",
    "unit4_spend": f"""SELECT CASE WHEN o_custkey % 9 = 4 THEN 'Unknown' ELSE {house("o_custkey")} END AS house, 'K' || {text("o_custkey + CASE WHEN o_custkey % 75 = 3 THEN 8000000 ELSE 0 END")} AS u4_contract_id,
  sum(CASE WHEN o_orderstatus = 'F' THEN {money("o_totalprice")} ELSE {money("0")} END) * CASE WHEN o_custkey % 39 = 3 THEN -1 ELSE 1 END AS posted, sum({money("o_totalprice")}) AS amount_c FROM orders WHERE o_custkey % 6 <> 0 GROUP BY o_custkey""",
    "unit4_contract_refs": f"""SELECT house, u4_contract_id FROM unit4_commitments UNION ALL SELECT 'HOL' AS house, 'L' || {text("c_custkey")} AS u4_contract_id FROM customer WHERE c_custkey % 40 = 1""",
    "unit4_open_contracts": f"""SELECT 'K' || {text("c_custkey")} AS u4_contract_id FROM customer WHERE c_custkey % 5 <> 2""",
    "atamis_contracts": f"""SELECT CASE WHEN c_custkey % 9 = 4 THEN 'Unknown' ELSE {house("c_custkey")} END AS house, CASE WHEN c_custkey % 30 = 4 THEN '' WHEN c_custkey % 78 = 3 THEN 'K' || {text("c_custkey - 2")} ELSE 'K' || {text("c_custkey + CASE WHEN c_custkey % 42 = 5 THEN 6000000 ELSE 0 END")} END AS contract_ref,
  {unless("c_custkey % 23 = 4", "c_name")} AS supplier_name, {pick("c_custkey", "'HOC'", "'hol '", "'Joint'", "'Other'")} AS organisation, coalesce(date_from, DATE '1999-01-01') + CASE WHEN c_custkey % 12 = 3 THEN 1 ELSE 0 END AS start_date,
  CASE WHEN c_custkey % 27 = 4 THEN NULL WHEN c_custkey % 31 = 4 THEN DATE '1980-01-01' ELSE coalesce(date_to, DATE '2001-01-01') END AS end_date,
  CASE WHEN c_custkey % 10 = 1 THEN {money("award_amount * 1.2")} WHEN c_custkey % 10 = 2 THEN award_amount + 90000 ELSE award_amount END AS total_award_value FROM customer LEFT JOIN unit4_commitments ON u4_contract_id = 'K' || {text("c_custkey")}""",
    "atamis_suppliers": f"""SELECT CASE WHEN c_custkey % 12 = 5 THEN 'Unknown' ELSE {house("c_custkey")} END AS house, c_name AS supplier_name, CASE WHEN c_custkey % 21 = 4 THEN '' ELSE {party("c_custkey")} END AS creditor_ref FROM customer""",
    "atamis_suppliers_existence": "SELECT 'Unknown' AS house, house AS derived_house, creditor_ref FROM atamis_suppliers WHERE coalesce(trim(creditor_ref), '') <> ''",
    "unit4_commitments_existence": "SELECT 'Unknown' AS house, house AS derived_house, u4_contract_id, supplier_id FROM unit4_commitments WHERE coalesce(trim(supplier_id), '') <> ''",
    "unit4_spend_existence": "SELECT 'Unknown' AS house, house AS derived_house, u4_contract_id FROM unit4_spend WHERE coalesce(trim(u4_contract_id), '') <> ''",
    "budgets_report": f"""SELECT {house("l_suppkey")} AS house, {pick("l_suppkey", "'HOC'", "'HOL'", "' HOL '", "'hoc'", "NULL")} AS recharge, {unless("l_orderkey % 99 = 3", text("5000 + l_partkey + CASE WHEN l_orderkey % 66 = 1 THEN 9000000 ELSE 0 END"))} AS account, {unless("l_partkey % 38 = 3", "'M' || " + text("l_suppkey % 5"))} AS mipck_l1, {unless("l_partkey % 29 = 3", "'H' || " + text("l_partkey % 300"))} AS haiscode,
  CASE WHEN l_partkey % 33 = 3 THEN ' ' ELSE 'CC' || {text("l_partkey % 50")} END AS costc, CASE WHEN l_orderkey % 49 = 3 THEN NULL WHEN l_orderkey % 48 = 3 THEN 17 ELSE cast(extract(month FROM l_shipdate) AS int) END AS period, cast(extract(year FROM l_shipdate) AS int) AS year,
  {money("l_extendedprice")} AS gl_actuals, {unless("l_partkey % 31 = 3", money(PRICE + ' * 1.1'))} AS orig_budget, CASE WHEN l_partkey % 37 = 3 THEN NULL WHEN l_partkey % 41 = 3 THEN {money("0")} ELSE {money(PRICE + ' * 1.05')} END AS curr_budget,
  {money(PRICE + ' * 1.02')} AS live_forecast, 'Category ' || {text("l_partkey % 25")} AS account_desc FROM lineitem""",
    "decision_log": " UNION ALL ".join([
        _decision(0, "record", record("c_custkey"), pick(whole("c_custkey / 7"), "'AGREE'", "'KEEP'", "'CLOSE'", "'WILL_FIX'", "'ACCEPT_AS_IS'"), "customer", "c_custkey % 3 = 1"),
        _decision(1, "record", record("c_custkey"), pick(whole("c_custkey / 5"), "'CLOSE'", "'KEEP'", "'ACCEPT_AS_IS'", "'unknown'"), "customer", "c_custkey % 12 = 1"),
        _decision(2, "record", "'HOC|gone' || " + text("c_custkey"), "'CLOSE'", "customer", "c_custkey % 37 = 3"),
        _decision(3, "record", record("c_custkey"), pick("c_custkey", "'NOT_DUPLICATE'", "'CONFIRM_PREFERRED'", "'CONFIRM_PREFERRED'"), "customer", "c_custkey % 9 = 2 OR c_custkey % 41 = 3"),
        _decision(4, "pair", record("c_custkey"), pick(whole("c_custkey / 50"), "'DIFFERENT_SUPPLIER'", "'SAME_SUPPLIER'"), "customer", "c_custkey % 50 = 9 AND c_custkey % 3 <> 2", record("c_custkey - 14")),
        _decision(5, "item", "item_key", pick("k", "'DONT_MIGRATE'", "'MIGRATE'", "'DONT_MIGRATE'"), "(SELECT DISTINCT house || '|' || client || '|' || apar_id || '|' || voucher_no AS item_key, cast(voucher_no AS bigint) AS k FROM asutrans) i", "k % 7 < 4", k="k"),
    ]),
    "agldimension": """SELECT DISTINCT house, client, attribute_id, dim_position, 'Dimension ' || dim_position AS description, CASE WHEN attribute_id = 'A1' AND client = 'CM' THEN 'C' ELSE 'N' END AS status FROM agldimvalue""",
    "gl_contract_values": f"""SELECT {house("c_custkey")} AS house, {pick("c_custkey", "'5'", "' 5'", "'4'")} AS dim_position, {pick("c_custkey", "'Contract Number'", "'contract number '", "'Contract Number'", "'Cost centre'")} AS dim_description, 'L' || {text("c_custkey")} AS dim_value FROM customer""",
    "hol_unit4_spend": f"""SELECT CASE WHEN o_orderkey % 30 = 3 THEN ' ' ELSE ' L' || {text("o_custkey")} END AS u4_contract_id, CASE WHEN o_custkey % 5 = 2 THEN -1 ELSE 1 END * {money("o_totalprice")} AS amount FROM orders WHERE o_custkey % 7 <> 1""",
    "aattrans": f"""SELECT {house("l_partkey")} AS house, {client("l_partkey")} AS client, {_ASSET} AS asset_id, {pick("l_orderkey", "'CURR'", "'HIST'")} AS depr_book_id, {pick("l_suppkey + l_partkey", "'CA'", "'ND'", "'CI'", "'SA'", "'ED'", "NULL", "'FD'")} AS trans_type, {pick("l_suppkey", "'11200'", "'11215'", "'70000'")} AS account,
  {pick("l_orderkey", "'N'", "'C'", "NULL")} AS status, cast(l_shipdate AS date) AS trans_date, {money("l_extendedprice")} AS amount FROM lineitem""",
    "aaghocbud": f"""SELECT {client("l_partkey")} AS client, {_PERIOD} AS period, {text("5000 + l_partkey")} AS dim1, 'CC' || {text("l_partkey % 50")} AS dim2, 'U' || {text(_UNIT)} AS dim3, {unless("l_partkey % 5 <> 1", text("l_suppkey"))} AS dim4, 'H' || {text("l_partkey % 300")} AS dim5, {house("l_suppkey")} AS dim6,
  {", ".join(f"{money(f'{PRICE} * 1.0{i}')} AS {c}" for i, c in enumerate(("pla_amount", "plb_amount", "ple_amount", "plc_amount", "plf_amount", "plg_amount", "plh_amount", "pli_amount", "plk_amount")))}, {money(PRICE)} AS plm_amount, {money("0")} AS plo_amount, CASE WHEN l_linestatus = 'O' THEN {money("l_extendedprice")} END AS po_rest_com_amt FROM lineitem""",
    "project_list": f"""SELECT 'Parliament' AS house, 'U' || {text("p_partkey % 40")} AS unit, 'Unit ' || {text("p_partkey % 40")} AS unit_desc, CASE WHEN p_partkey % 90 = 3 THEN 'X' ELSE 'U' || {text("p_partkey % 40")} END || '-' || {text("CASE WHEN p_partkey % 160 = 45 THEN p_partkey - 40 ELSE p_partkey END")} AS hais_code,
  CASE WHEN p_partkey % 70 = 3 THEN 'DO NOT USE - ' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {text("p_partkey")} END AS hais_desc, {unless("p_partkey % 44 = 3", "'C' || " + text("p_partkey % 40 % 4 + CASE WHEN p_partkey = 41 THEN 1 ELSE 0 END"))} AS projcat,
  {unless("p_partkey % 54 = 3", "'P' || " + text("p_partkey % 40 % 8"))} AS projgrp, 'Portfolio ' || {text("p_partkey % 40 % 8 % 5")} AS projgrp_desc, 'CC' || {text("p_partkey % 40")} AS costc, 'DIR' || {text("p_partkey % 40 % 6 + CASE WHEN p_partkey % 333 = 2 THEN 1 ELSE 0 END")} AS directorate,
  'DEP' || {text("p_partkey % 40 % 3")} AS department, CASE WHEN p_partkey % 8 = 5 THEN 'C' ELSE 'N' END AS status FROM part WHERE p_partkey % 10 <> 9""",
    "project_financials": f"""SELECT {house("l_suppkey")} AS house, 'U' || {text(_UNIT)} || '-' || {text("l_partkey")} AS hais_code, 'U' || {text("(l_partkey + CASE WHEN l_partkey % 45 = 2 THEN 1 ELSE 0 END) % 40")} AS unit, 'CC' || {text(_UNIT)} AS costc, 'DIR' || {text("l_partkey % 40 % 6")} AS directorate, 'DEP' || {text("l_partkey % 40 % 3")} AS department,
  cast(extract(year FROM l_shipdate) AS int) AS fiscal_year, {_PERIOD} AS period, CASE WHEN l_suppkey % 7 = 1 THEN 'Income' ELSE 'Costs' END AS mipck_l1_desc,
  {money("CASE WHEN l_linestatus = 'F' AND l_partkey % 12 <> 1 THEN l_extendedprice ELSE 0 END")} AS actuals, {money("CASE WHEN l_partkey % 12 = 1 OR l_partkey % 9 = 2 THEN 0 ELSE cast(l_extendedprice AS decimal(18, 2)) * 0.9 END")} AS budget,
  {money("CASE WHEN l_linestatus = 'O' AND l_partkey % 12 <> 1 THEN CASE WHEN l_orderkey % 20 = 3 THEN -1 * l_extendedprice WHEN l_orderkey % 20 = 4 THEN 2 ELSE l_extendedprice END ELSE 0 END")} AS committed FROM lineitem""",
    "employee_master": f"""SELECT 'RM' AS house, {text("CASE WHEN c_custkey % 140 = 9 THEN c_custkey - 1 ELSE c_custkey END")} AS employee_id, CASE WHEN c_custkey % 26 = 2 THEN NULL WHEN c_custkey % 28 = 2 THEN 'GB123456A' WHEN c_custkey % 30 = 2 THEN 'AB12' ELSE 'AB' || {text("100000 + c_custkey % 800000")} || 'C' END AS ni_number,
  CASE WHEN c_custkey % 6 = 1 THEN 'Leaver' ELSE 'Active' END AS employment_status, {unless("c_custkey % 25 = 2", text("10000000 + c_custkey"))} AS bank_account, {unless("c_custkey % 35 = 2", "'20-00-' || " + text("10 + c_custkey % 90"))} AS sort_code,
  CASE WHEN c_custkey % 22 = 2 THEN NULL ELSE DATE '1920-01-01' + cast(c_custkey * 13 % 25000 AS int) END AS dob, DATE '1995-01-01' + cast(c_custkey % 2000 AS int) AS start_date, CASE WHEN c_custkey % 6 = 1 THEN DATE '1997-01-01' + cast(c_custkey * 7 % 1500 AS int) END AS leaving_date,
  CASE WHEN c_custkey % 9 = 2 THEN 'ghost' WHEN c_custkey % 9 <> 3 THEN {text("c_custkey % 100")} END AS manager_id, {unless("c_custkey % 15 = 2", "'a@b.c'")} AS email, CASE WHEN c_custkey % 13 = 2 THEN 'bad' ELSE 'SW1A 1AA' END AS postcode, {unless("c_custkey % 21 = 2", "'1257L'")} AS tax_code,
  c_mktsegment AS department, {pick("c_custkey", "'F'", "'M'", "'X'")} AS gender, {pick("c_custkey", "'Permanent'", "'Temporary'")} AS contract_type FROM customer""",
    "payroll_transactions": f"""SELECT 'RM' AS house, {text("o_orderkey")} AS payroll_id, {text("o_custkey + CASE WHEN o_orderkey % 100 = 3 THEN 9000000 ELSE 0 END")} AS employee_id, {text("extract(year FROM o_orderdate)")} || '-' || {text("extract(month FROM o_orderdate)")} AS pay_period,
  {unless("o_orderkey % 67 = 3", "'1257L'")} AS tax_code, {unless("o_orderkey % 68 = 3", "'A'")} AS ni_category, {text("10000000 + o_custkey + CASE WHEN o_orderkey % 83 = 3 THEN 1 ELSE 0 END")} AS bank_account, '20-00-' || {text("10 + o_custkey % 90")} AS sort_code,
  {pick("o_orderkey", "'Paid'", "'Pending'", "'Paid'", "'Paid'")} AS status, cast(o_orderdate AS date) + CASE WHEN o_orderkey % 333 = 3 THEN 3000 ELSE 0 END AS pay_date, CASE WHEN o_orderkey % 74 = 3 THEN -1 * {money("o_totalprice")} ELSE {money("o_totalprice")} END AS gross_pay,
  {money("100")} AS tax_deducted, {money("50")} AS ni_deducted, {money("25")} AS pension_deducted, CASE WHEN o_orderkey % 2 = 0 THEN {money("5")} END AS other_deductions,
  CASE WHEN o_orderkey % 72 = 3 THEN {money("0")} WHEN o_orderkey % 73 = 3 THEN {money("o_totalprice")} + 10 ELSE {money("o_totalprice")} - 175 - CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END END AS net_pay,
  CASE WHEN o_orderkey % 7 = 3 THEN {money("40")} ELSE {money("0")} END AS overtime_pay, CASE WHEN o_orderkey % 14 = 3 THEN {money("2")} END AS overtime_hours FROM orders""",
}


def order(names) -> list[str]:
    """The tables named and those they are made from, each after its own sources."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out or name not in TABLES:
            return
        for other in TABLES:
            if other != name and f" {other}" in TABLES[name].replace("\n", " "):
                visit(other)
        out.append(name)

    for name in names:
        visit(name)
    return out


def frames(spark: SparkSession, sf_dir: str, names, dealt=()) -> dict[str, DataFrame]:
    """The finance tables named, over the Parquet tables of sf_dir. dealt: tables of few bytes of which much is made, so their rows go to all tasks."""
    for source in SOURCES:
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        if source in dealt:
            rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows.createOrReplaceTempView(source)
    out = {}
    for name in order(names):
        out[name] = spark.sql(TABLES[name])
        out[name].createOrReplaceTempView(name)
    return {n: df for n, df in out.items() if n in names}


def duck(sql: str) -> str:
    """The few names that differ between the two engines."""
    for spark_name, duck_name in (("regexp_like(", "regexp_matches("), ("bround(", "round_even("), ("datediff(DAY, dob, ", "date_diff('day', dob, ")):
        sql = sql.replace(spark_name, duck_name)
    return sql


def with_tables(names, sql: str, made: dict[str, str] | None = None) -> str:
    """DuckDB SQL: `sql` over the finance tables named, and over those `made` from them, each by its own SQL."""
    ctes = [f"{n} AS (\n{TABLES[n]}\n)" for n in order(names)] + [f"{n} AS (\n{text}\n)" for n, text in (made or {}).items()]
    return duck(("WITH RECURSIVE " if made else "WITH ") + ",\n".join(ctes) + "\n" + sql)
