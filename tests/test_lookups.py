"""Values from elsewhere, evidence of all checks, and hierarchies."""

import random
from collections import defaultdict

from finscope import bindings, hierarchy
from finscope.checks import CATALOGUE, core, evidence
from tests.test_finance import AS_OF, check, supplier


def plain_depths(rows):
    """Least depth over all listings, by going down from the roots."""
    children, depth = defaultdict(set), {}
    for node, parent in rows:
        if parent:
            children[parent].add(node)
    level = {n for n, p in rows if not p}
    d = 1
    while level:
        depth |= {n: d for n in level if n not in depth}
        level = {c for n in level for c in children[n] if c not in depth}
        d += 1
    return {n: depth.get(n, 1) for n, _ in rows}


def depths(spark, rows):
    df = spark.createDataFrame([("c", n, p) for n, p in rows], "client string, node string, parent string")
    out = hierarchy.with_depth(df, ["client"], "node", "parent").collect()
    assert len(out) == len(rows)
    return {r["node"]: r["depth"] for r in out}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    keep = hierarchy.written
    monkeypatch.setattr(hierarchy, "written", lambda df, label: rounds.append(label) or keep(df, label))
    rows = [(f"n{i}", f"n{i - 1}" if i else "") for i in range(10_000)] + [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("lost", "gone")]
    assert depths(spark, rows) == plain_depths(rows)
    assert rounds.count("pointers") < 20


def test_depths_match_a_plain_walk(spark):
    rng = random.Random(6)
    for n in (6, 30, 60):
        rows = [(f"n{rng.randrange(n)}", rng.choice(["", None, " "]) if rng.random() < 0.15 else f"n{rng.randrange(n + 3)}") for _ in range(n)]
        plain = [(a, (p or "").strip()) for a, p in rows]
        assert depths(spark, rows) == plain_depths(plain), rows


def test_evidence_has_a_row_for_each_failure(spark):
    own = [check(i) for i in ("SUP_TERMS_MISSING", "SUP_PAY_METHOD_MISSING", "SUP_VAT_DUP", "SUP_VAT_MISSING")]
    frames = {"asuheader": supplier(spark, {}, {"apar_id": "20002", "terms_id": None, "pay_method": " "}, {"apar_id": "20003", "vat_reg_no": None}, {"apar_id": "20004", "status": "C", "terms_id": None})}
    got = evidence.failing(frames, own, AS_OF)
    counted = {(r["check_id"], r["house"]): r["count"] for r in got.groupBy("check_id", "house").count().collect()}
    assert counted == {(r["check_id"], r["house"]): r["failing"] for r in core.run_checks(frames, own, AS_OF).collect() if r["failing"]}
    texts = {(r["check_id"], r["evidence"]) for r in got.collect()}
    assert ("SUP_TERMS_MISSING", "client: CA - apar_id: 20002 - apar_name: Alpha Ltd - terms_id: (blank)") in texts
    assert {t for i, t in texts if i == "SUP_VAT_DUP"} == {f"client: CA - apar_id: {i} - apar_name: Alpha Ltd - status: N - vat_reg_no: GB123456789" for i in ("20001", "20002")}


def test_values_of_the_same_keys_are_one_lookup():
    ref = lambda value, where="true", keys=(("k", "k"),): core.Ref("found", keys, "t", value, where)
    refs = {"a": ref("count(*)"), "b": ref("min(x)", "y = 1"), "c": ref("sum(coalesce(x, 0))"), "d": ref("count(DISTINCT x)"), "e": ref("count(*)", keys=(("k", "trim(k)"),))}
    assert [sorted(g) for g in core._lookups(refs)] == [["a", "b", "c"], ["d"], ["e"]]


def test_lookups_with_and_without_rows(spark):
    df = spark.createDataFrame([("HOC", "a"), ("HOC", "b"), ("HOC", None), ("HOC", "z"), ("HOC", "a")], "house string, k string")
    other = spark.createDataFrame([("a", 1, "n"), ("a", None, "o"), ("b", None, "o"), (None, 5, "n")], "k string, x int, s string")
    many, some = core.found("t", k="k"), core.found("t", "min(x)", k="k")
    new, twice, kept = core.found("t", where="s = 'n'", k="k"), core.repeated("k"), core.repeated("k", where=core.exists("t", k="k"))
    out = core.with_refs(df, {"t": other}, " ".join([many, some, new, twice, kept]), AS_OF).selectExpr("k", f"{many} AS many", f"{some} AS some", f"{new} AS new", f"{twice} AS twice", f"{kept} AS kept").collect()
    assert sorted(map(tuple, out), key=repr) == sorted([("a", 2, 1, 1, True, True)] * 2 + [("b", 1, None, None, False, False), (None, None, None, None, False, False), ("z", None, None, None, False, False)], key=repr)


def test_repeated_keys_are_counted_before_values_from_elsewhere_are_joined(spark):
    rows = spark.createDataFrame([("HOC", "1", "a"), ("HOC", "1", "b"), ("HOC", "2", "a")], "house string, apar_id string, account string")
    accounts = spark.createDataFrame([("HOC", "a", "C")], "house string, account string, status string")
    rules = (core.repeated("apar_id"), f"coalesce({core.found('accounts', 'min(status)', house='house', account='account')}, 'N') = 'C'")
    out = core.annotated({"rows": rows, "accounts": accounts}, "rows", [core.Check("", "", "", "", "Low", "rows", r) for r in rules], AS_OF)
    assert {(r["apar_id"], r["account"], r["f_0"], r["f_1"]) for r in out.collect()} == {("1", "a", True, True), ("1", "b", True, False), ("2", "a", False, True)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_evidence_is_the_same_where_checks_without_lookups_stand_apart(spark):
    f = bindings.frames(spark, "/root/testdata/sf0.001", {"apoheader", "apodetail", "asuheader", "aglaccounts"})
    own = [c for c in CATALOGUE if c.domain == "PO"]
    found = [sorted(map(tuple, evidence.failing(f, own, AS_OF, apart).collect())) for apart in ((), ("apoheader", "apodetail"))]
    assert found[0] == found[1] and len({r[0] for r in found[0]}) > 10
    shuffled = evidence.failing(f, [c for c in own if not core.used(c.fails + c.population) and c.table == "apoheader"], AS_OF, ("apoheader",))
    assert "Join " not in shuffled._jdf.queryExecution().optimizedPlan().toString()
