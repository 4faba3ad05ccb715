import difflib
import random

import pytest
from pyspark.sql import functions as F

from finscope import bindings, clean, hierarchy, io, queries, standardise
from finscope.checks import CATALOGUE, core
from finscope.matching import components, pairs
from finscope.migration import decisions, pipeline

AS_OF = "2026-11-01"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def check(id):
    return next(c for c in CATALOGUE if c.id == id)


def fails(frames, id):
    return core.failing_rows(frames, check(id), AS_OF)


def supplier(spark, *rows):
    base = {"house": "HOC", "client": "CA", "apar_id": "20001", "apar_name": "Alpha Ltd", "apar_gr_id": "TR", "status": "N", "vat_reg_no": "GB123456789", "comp_reg_no": "01234567", "terms_id": "30", "pay_method": "IP", "currency": "GBP", "clearing_code": "20-00-00", "bank_account": "12345679", "iban": None, "swift": None, "address": "1 Rd", "place": "X", "zip_code": "SW1A 1AA", "country_code": "GB", "apar_once": "N", "last_update": None}
    schema = ", ".join(f"{k} string" for k in base)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schema)


def test_catalogue_is_whole():
    assert len(CATALOGUE) == 283 and len({c.id for c in CATALOGUE}) == 283
    assert {c.severity for c in CATALOGUE} == set(core.RAG)


@pytest.mark.parametrize("id,bad", [
    ("SUP_VAT_MISSING", {"vat_reg_no": None}), ("SUP_TERMS_MISSING", {"terms_id": None}), ("SUP_VAT_FORMAT", {"vat_reg_no": "GB12"}), ("SUP_COMP_REG_FORMAT", {"comp_reg_no": "XX1"}),
    ("SUP_SORT_FORMAT", {"clearing_code": "1234"}), ("SUP_BANK_FORMAT", {"bank_account": "123456789"}), ("SUP_ZIP_FORMAT", {"zip_code": "nowhere"}), ("SUP_BACS_NO_BANK", {"bank_account": None}), ("SUP_SWIFT_MISSING", {"iban": "GB1"}),
])
def test_supplier_rules(spark, id, bad):
    frames = {"asuheader": supplier(spark, {}, {"apar_id": "20002", **bad})}
    assert [r["apar_id"] for r in fails(frames, id).collect()] == ["20002"]


def test_exclusions_and_population(spark):
    frames = {"asuheader": supplier(spark, {"apar_id": "71001", "vat_reg_no": None}, {"apar_id": "99001", "terms_id": None}, {"status": "C", "terms_id": None}, {"house": "HOL", "client": "LA", "apar_id": "30001", "vat_reg_no": None})}
    assert fails(frames, "SUP_VAT_MISSING").count() == 0 and fails(frames, "SUP_TERMS_MISSING").count() == 0
    odd = {"asuheader": supplier(spark, {"status": None, "terms_id": None})}
    assert fails(odd, "SUP_TERMS_MISSING").count() == 1  # a null status isn't closed


def test_duplicates_count_the_population_only(spark):
    rows = [{"apar_id": "1"}, {"apar_id": "2"}, {"apar_id": "3", "status": "C"}, {"apar_id": "4", "vat_reg_no": None}, {"apar_id": "5", "vat_reg_no": None}, {"apar_id": "6", "vat_reg_no": "GB999999999"}]
    frames = {"asuheader": supplier(spark, *rows)}
    assert sorted(r["apar_id"] for r in fails(frames, "SUP_VAT_DUP").collect()) == ["1", "2"]


def test_results_add_up_and_are_rated(spark):
    frames = {"asuheader": supplier(spark, *[{"apar_id": str(i), "terms_id": None if i % 4 == 0 else "30"} for i in range(16)])}
    own = [check("SUP_TERMS_MISSING"), check("SUP_CLIENT_APAR_DUP")]
    got = {r["check_id"]: r for r in core.run_checks(frames, own, AS_OF).collect()}
    assert all(r["passing"] + r["failing"] == r["total"] for r in got.values())
    assert got["SUP_TERMS_MISSING"]["error_rate"] == 25.0 and got["SUP_TERMS_MISSING"]["rag"] == "Red" and got["SUP_CLIENT_APAR_DUP"]["rag"] == "Green"


def test_null_keys_are_orphans(spark):
    items = spark.createDataFrame([("HOC", "CA", None, "N"), ("HOC", "CA", "20001", "N"), ("HOC", "CA", "gone", "N")], "house string, client string, apar_id string, status string")
    frames = {"asutrans": items, "asuheader": supplier(spark, {})}
    assert fails(frames, "AP_ORPHANED_TRANS").count() == 2


def test_dates_and_numbers(spark):
    day = lambda t: str(one(spark, clean.parse_date(F.lit(t))))
    assert day("2024-03-01") == day("01/03/2024") == day("45352") == day("45352.7") == day("2024-03-01 10:00:00") == "2024-03-01"
    assert day("12") == day("hello") == day("99999999") == "None"
    assert str(one(spark, clean.clean_number(F.lit("GBP1,234.50")))) == "1234.50" and one(spark, clean.clean_number(F.lit("x"))) is None
    assert one(spark, clean.period_index(F.lit(202014))) == 2020 * 12 + 12 and one(spark, clean.period_label(F.lit(202012))) == "FY2020/21 P12"
    assert one(spark, clean.fiscal_year_of(F.lit("2025-03-31").cast("date"))) == "FY2024/25"
    assert one(spark, clean.longest_prefix(F.lit("741x"), {"7": "a", "74": "b"}, "c")) == "b"
    assert one(spark, clean.band(F.lit(30), [30, 60], ["a", "b", "c"])) == "a"


def test_standard_forms(spark):
    assert one(spark, standardise.std_name(F.lit("The  Acme, Trading Limited"))) == "ACME TRADING LTD"
    assert one(spark, standardise.name_core(F.lit("Acme and Sons Public Limited Company"))) == "ACME SONS"
    assert one(spark, standardise.std_vat(F.lit("gb 123 456"))) == "123456" and one(spark, standardise.is_org_name(F.lit("Acme Limited"))) and not one(spark, standardise.is_org_name(F.lit("Acme & Co")))


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(50)} == {100}


def test_indel_ratio_matches_a_table():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        want = 100.0 if not a and not b else 200.0 * t[-1][-1] / (len(a) + len(b))
        assert abs(pairs.indel_ratio(a, b) - want) < 1e-9


def test_hierarchy(spark):
    rows = [("c", "a", "1", ""), ("c", "a", "2", "1"), ("c", "a", "3", "2"), ("c", "a", "4", "9"), ("c", "a", "5", "6"), ("c", "a", "6", "5"), ("c", "b", "3", None)]
    df = spark.createDataFrame(rows, "client string, attribute_id string, dim_value string, rel_value string")
    got = {(r["attribute_id"], r["dim_value"]): r["depth"] for r in hierarchy.with_depth(df, ["client", "attribute_id"], "dim_value", "rel_value").collect()}
    assert got == {("a", "1"): 1, ("a", "2"): 2, ("a", "3"): 3, ("a", "4"): 1, ("a", "5"): 1, ("a", "6"): 1, ("b", "3"): 1}


def test_readers(spark, tmp_path):
    (tmp_path / "asuheader_HOC.csv").write_text("apar_id,name\n0012,Alpha\n")
    (tmp_path / "asuheader_HOL.csv").write_text("apar_id,place\n7,X\n")
    df = io.read_split(spark, str(tmp_path), "asuheader")
    assert {(r["house"], r["apar_id"]) for r in df.collect()} == {("HOC", "0012"), ("HOL", "7")}
    assert io.read_split(spark, str(tmp_path), "nothing") is None
    (tmp_path / "c.csv").write_bytes("Contract: Title,Ref\nCaf\xe9,1\nTotal,\n".encode("cp1252"))
    one_file = io.read_single(spark, str(tmp_path / "c.csv"), {"Contract: Title": "title", "Ref": "ref", "Missing": "gone"})
    assert [tuple(r) for r in io.drop_grand_total(one_file, "ref").collect()] == [("Café", "1", None)]


LOG = "id long, target_type string, target_key string, related_key string, decision string, reason string, steward string"


def test_decisions(spark):
    log = spark.createDataFrame([(1, "record", "HOC|1", None, "KEEP", "r", "s"), (2, "record", "HOC|1", None, "CLOSE", "r", "s"), (3, "pair", "b", "a", "SAME_SUPPLIER", "r", "s"), (4, "record", "HOC|1", None, "NOT_DUPLICATE", "r", "s"), (5, "record", "HOC|1", None, "FIX", "r", "s")], LOG)
    now = {(r["target_key"], r["related_key"], r["family"]): r["decision"] for r in decisions.effective(log).collect()}
    assert now == {("HOC|1", "", "scope"): "CLOSE", ("a", "b", "pair"): "SAME_SUPPLIER", ("HOC|1", "", "dup"): "NOT_DUPLICATE"}  # FIX is no decision
    upload = [(9, "record", "HOC|1", None, "CLOSE", "r", "s"), (10, "record", "HOC|1", None, "AGREE", "r", "s"), (11, "record", "HOC|2", None, "KEEP", "", "s"), (12, "record", "HOC|3", None, "what", "r", "s"), (13, "pair", "a", "c", "SAME_SUPPLIER", "r", "s"), (14, "item", "HOC|CA|1|v", None, "DONT_MIGRATE", "r", "s"), (15, "item", "HOC|CA|1|v", None, "KEEP", "r", "s"), (16, "record", " ", None, "KEEP", "r", "s"), (17, "record", "HOC|1", None, "WILL_FIX", "r", None)]
    got = {r["id"]: (r["verdict"], r["rejected_because"]) for r in decisions.triage(spark.createDataFrame(upload, LOG), log).collect()}
    assert got == {9: ("already recorded", None), 10: ("changed", None), 11: ("rejected", "no reason"), 12: ("rejected", "unknown decision"), 13: ("new", None), 14: ("new", None), 15: ("rejected", "unknown decision"), 16: ("rejected", "no target"), 17: ("rejected", "no steward")}


def positions(spark, suppliers, invoices=(), open_items=(), said=(), rules=None):
    """All positions. invoices: (id, day); open_items: (id, day) or (id, day, voucher, client); said: (target type, target, related, decision[, day, recommendation, label])."""
    keys = lambda r: {"vat_reg_no": f"GB{100000000 + int(r['apar_id'])}", "comp_reg_no": f"{10000000 + int(r['apar_id'])}", "bank_account": f"{30000000 + int(r['apar_id'])}", "apar_name": named(r["apar_id"]), "zip_code": "SW1A 1AA", **r}
    master = supplier(spark, *map(keys, suppliers)).withColumn("last_update", F.lit("2026-01-01").cast("date"))
    tx = "house string, client string, apar_id string, voucher_no string, voucher_type string, status string, trans_date string, rest_amount double"
    rows = lambda found, amount: spark.createDataFrame([("HOC", (*x, "CA")[3] if len(x) > 3 else "CA", x[0], x[2] if len(x) > 2 else f"v{x[0]}", "PI", "N", x[1], amount) for x in found], tx).withColumn("trans_date", F.to_date("trans_date"))
    orders = spark.createDataFrame([], "house string, apar_id string, order_date string, status string").withColumn("order_date", F.to_date("order_date"))
    log = spark.createDataFrame([(i, *x[:4], "r", "s", *(*x[4:], *[None] * 3)[:3]) for i, x in enumerate(said)], LOG + ", recorded_at string, recommendation string, record_label string").withColumn("recorded_at", F.to_date("recorded_at"))
    return pipeline.position(master, rows(invoices, 0.0), rows(open_items, 5.0), orders, rules or pipeline.Rules(AS_OF), decisions.effective(log) if said else None)


NAMES = ("Quartz", "Heron", "Maple", "Tundra", "Sable", "Onyx", "Pewter", "Lagoon", "Cobalt", "Juniper")


def named(apar_id):
    """A name unlike that of any other id: the words stand for digits, and differ by place."""
    first, second, third = (NAMES[int(d)] for d in apar_id[-3:])
    return f"{first}{first} {second[::-1]} {third} Ltd"


def migrated(*args, **more):
    return {r["apar_id"]: r for r in positions(*args, **more).collect()}


def test_migration_classes(spark):
    rows = [{"apar_id": "20001"}, {"apar_id": "20002", "terms_id": None}, {"apar_id": "20003"}, {"apar_id": "20004", "status": "C"}, {"apar_id": "20005", "apar_gr_id": "ME"}, {"apar_id": "74001"}, {"apar_id": "89001"}, {"apar_id": "20006", "client": "ZZ"}, {"apar_id": "20007", "apar_gr_id": "03"}]
    got = migrated(spark, rows, [(i, "2026-09-01") for i in ("20001", "20002", "20005", "20007")])
    assert {k: (r["classification"], r["rule"]) for k, r in got.items()} == {
        "20001": ("KEEP", "MS-CLS-05"), "20002": ("FIX", "MS-CLS-04"), "20003": ("CLOSE", "MS-CLS-01"), "20004": ("OUT_OF_SCOPE", "MS-POP-01"), "20005": ("HOLD_NONCOMMERCIAL", "MS-CAT-01"),
        "74001": ("HOLD_NONCOMMERCIAL", "MS-CAT-02"), "89001": ("OUT_OF_SCOPE", "MS-POP-01"), "20007": ("KEEP", "MS-CLS-05"),
    }


def test_preferred_records(spark):
    bank = {"bank_account": "55555555"}
    now, old = "2026-10-20", "2026-02-01"  # within six months, and within eighteen
    trio = [{"apar_id": i, **bank} for i in ("20001", "20002", "20003")]
    got = migrated(spark, trio, [("20001", now), ("20002", now), ("20003", old)], [("20002", now)])
    assert got["20002"]["preferred"] and got["20002"]["classification"] == "KEEP"  # open items before completeness or activity
    assert (got["20001"]["classification"], got["20001"]["rule"]) == ("MONITOR", "MS-CLS-03") and (got["20003"]["classification"], got["20003"]["rule"]) == ("CLOSE", "MS-CLS-02")
    blocked = [{"apar_id": "20001", **bank, "terms_id": None}, {"apar_id": "20002", **bank, "place": None}]
    got = migrated(spark, blocked, [("20001", now), ("20002", old)])
    assert got["20002"]["preferred"] and not got["20001"]["preferred"]  # fewest blocking issues first
    got = migrated(spark, trio[:2], [("20001", now), ("20002", now)])
    assert all(r["preferred_tie"] and not r["preferred"] and (r["classification"], r["rule"]) == ("MONITOR", "MS-DUP-03") for r in got.values())
    got = migrated(spark, trio[:2], [("20001", now), ("20002", now)], said=[("record", "HOC|20002", "", "CONFIRM_PREFERRED"), ("record", "HOC|20002", "", "CLOSE")])
    assert got["20002"]["preferred"] and got["20002"]["classification"] == "CLOSE" and got["20001"]["rule"] == "MS-CLS-03"  # both decisions stand
    assert got["20001"]["group_confirmed"] and {r["recommended"] for r in got.values()} == {"MONITOR"}


def test_groups_and_stewards(spark):
    bank = {"bank_account": "55555555"}
    trio = [{"apar_id": i, **bank} for i in ("20001", "20002", "20003")]
    now = [(i, "2026-10-20") for i in ("20001", "20002", "20003")]
    assert {r["dup_group"] for r in migrated(spark, trio, now).values()} == {"HOC|20001"}
    got = migrated(spark, trio, now, said=[("record", "HOC|20002", "", "NOT_DUPLICATE"), ("pair", "HOC|20001", "HOC|20003", "DIFFERENT_SUPPLIER")])
    assert got["20002"]["dup_group"] is None and got["20001"]["dup_group"] == got["20003"]["dup_group"] == "HOC|20001"
    placeholder = [{"apar_id": i, "bank_account": "11111111"} for i in ("20001", "20002")]
    assert {r["dup_group"] for r in migrated(spark, placeholder, now).values()} == {None}
    mixed = [{"apar_id": "20001", **bank}, {"apar_id": "20002", **bank, "apar_gr_id": "ME"}]
    assert {r["dup_group"] for r in migrated(spark, mixed, now).values()} == {None}  # commercial records only
    same = [{"apar_id": "20001"}, {"apar_id": "20002"}]
    assert {r["dup_group"] for r in migrated(spark, same, now, said=[("pair", "HOC|20002", "HOC|20001", "SAME_SUPPLIER")]).values()} == {"HOC|20001"}


def test_issues_are_those_of_the_rows_in_scope(spark):
    rows = [{"apar_id": "20001", "comp_reg_no": None}, {"apar_id": "20001", "client": "CM", "vat_reg_no": "GB999999999", "comp_reg_no": None}, {"apar_id": "20002", "apar_name": " "}, {"apar_id": "20003", "status": "C", "terms_id": None}]
    found = {(r["entity_key"], r["issue"], r["blocking"]) for r in pipeline.issues(supplier(spark, *rows), pipeline.Rules(AS_OF)).collect()}
    assert {("HOC|20001", "MS-DQ-LTD-COMPNO", True), ("HOC|20001", "MS-DQ-CLIENT-DIFF", False), ("HOC|20002", "MS-DQ-NAME", True)} <= found
    assert not any(e == "HOC|20003" for e, _, _ in found)


def test_depth_has_no_limit(spark):
    from finscope import hierarchy

    rows = [("C", "A", f"n{i}", f"n{i - 1}" if i else "") for i in range(25)] + [("C", "A", "x", "y"), ("C", "A", "y", "x")]
    got = {r["dim_value"]: r["depth"] for r in hierarchy.with_depth(spark.createDataFrame(rows, "client string, attribute_id string, dim_value string, rel_value string"), ["client", "attribute_id"], "dim_value", "rel_value").collect()}
    assert all(got[f"n{i}"] == i + 1 for i in range(25)) and got["x"] == got["y"] == 1
