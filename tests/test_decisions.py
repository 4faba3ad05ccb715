"""What stewards' decisions do to a position, and what doesn't change because of them."""

import pytest
from pyspark.sql import functions as F

from finscope.migration import decisions, pipeline, trace
from tests.test_finance import AS_OF, LOG, migrated, positions, supplier

NOW, AGO, LONG_AGO = "2026-10-20", "2026-02-01", "2024-01-01"


def near(first, name, other, **more):
    """Two records with names that are nearly the same."""
    return [{"apar_id": str(first), "apar_name": name, **more}, {"apar_id": str(first + 1), "apar_name": other, **more}]


@pytest.fixture(scope="module")
def world(spark):
    """One position with a case in each range of ids."""
    bad, closed = {"terms_id": None}, {"status": "C"}
    rows = [{"apar_id": i} for i in ("20001", "20011", "20012", "20016", "20017", "20031", "20032", "20033", "20034", "20042")]
    rows += [{"apar_id": i, **bad} for i in ("20013", "20015", "20018", "20019")] + [{"apar_id": i, **closed} for i in ("20014", "20041")]
    rows += [{"apar_id": i, "bank_account": b} for i, b in (("20021", "51111111"), ("20022", "51111111"), ("20051", "52222222"), ("20052", "52222222"), ("20053", "53333333"), ("20054", "53333333"))]
    rows += near(20061, "Brightwater Catering Services Ltd", "Brightwater Catering Service Limited") + near(20063, "Silverlake Printing Works", "Silverlake Printing Work") + near(20065, "Northgate Laundry Supplies", "Northgate Laundry Supply")
    rows += near(20067, "Foxglove Timber Merchants", "Foxglove Timber Merchant") + near(20069, "Elmwood Garden Machines", "Elmwood Garden Machine", bank_account="54444444")
    rows += [{"apar_id": "20081", "apar_name": "Kestrel Window Cleaners"}, {"apar_id": "20082", "apar_name": "Kestrel Window Cleaner", "apar_gr_id": "ME"}]
    now = ["20011", "20012", "20014", "20015", "20018", "20019", "20021", "20022", "20033", "20051", *(str(i) for i in range(20061, 20071)), "20081", "20082"]
    invoices = [*((i, NOW) for i in now), *((i, LONG_AGO) for i in ("20001", "20013", "20016", "20017", "20042")), *((i, AGO) for i in ("20052", "20053", "20054"))]
    items = [*((i, LONG_AGO, "OLD") for i in ("20031", "20032", "20033", "20034")), ("20032", LONG_AGO, "OTHER")]
    own = {"20001": "KEEP", "20011": "CLOSE", "20013": "KEEP", "20014": "KEEP", "20015": "ACCEPT_AS_IS", "20016": "ACCEPT_AS_IS", "20018": "WILL_FIX", "20041": "CLOSE", "20042": "CLOSE", "20022": "NOT_DUPLICATE", "20068": "NOT_DUPLICATE", "20099": "NOT_DUPLICATE"}
    said = [("record", "HOC|20012", "", "KEEP"), ("record", "HOC|20012", "", "CLOSE"), *(("record", f"HOC|{i}", "", d) for i, d in own.items()), ("record", "HOC|20017", "", "AGREE", NOW, "CLOSE"), ("record", "HOC|20044", "", "CLOSE", NOW, None, "Gone Ltd")]
    said += [("item", f"HOC|CA|{i}|OLD", "", "DONT_MIGRATE") for i in ("20031", "20032", "20033")] + [("record", f"HOC|{i}", "", "CONFIRM_PREFERRED", "2026-06-01") for i in ("20052", "20054")]
    said += [("pair", "HOC|20064", "HOC|20063", "DIFFERENT_SUPPLIER"), ("pair", "HOC|20065", "HOC|20066", "SAME_SUPPLIER")]
    return migrated(spark, rows, invoices, items, said)


def test_keep_over_close_and_close_over_keep(world):
    got = world["20001"]
    assert (got["classification"], got["recommended"], got["decision_status"], got["decision_by"], got["overridden"]) == ("KEEP", "CLOSE", "override", "s", True)
    got = world["20011"]
    assert (got["classification"], got["recommended"], got["follow_through"]) == ("CLOSE", "KEEP", "Not yet actioned in Unit4")
    assert world["20012"]["classification"] == "CLOSE"  # the latest stands


def test_keep_of_a_blocked_record_is_fix_and_of_a_closed_one_nothing(world):
    assert world["20013"]["classification"] == "FIX"
    got = world["20014"]
    assert (got["classification"], got["follow_through"], got["overridden"]) == ("OUT_OF_SCOPE", "Conflict: closed in Unit4 against a Keep decision", False)
    assert got["reasons_tags"] == "Closed in Unit4" and got["fired"] == [] and got["trail"][-1]["result"] == "stop"


def test_accept_as_is_and_agree(world):
    got = world["20019"]
    assert got["classification"] == "FIX" and got["decision_status"] == "awaiting" and got["pending"] == "Confirm classification" and "Completeness" in got["reasons_tags"]
    got = world["20015"]
    assert (got["classification"], got["recommended"], got["overridden"]) == ("KEEP", "FIX", True)
    assert world["20016"]["classification"] == "CLOSE"  # only a FIX is accepted
    got = world["20017"]
    assert (got["classification"], got["decision_status"], got["overridden"], got["follow_through"]) == ("CLOSE", "decided", False, "Not yet actioned in Unit4")
    got = world["20018"]
    assert (got["classification"], got["decision_status"]) == ("FIX", "decided")


def test_recommended_is_the_rules_alone(world):
    pair = [world["20021"], world["20022"]]
    assert [(r["recommended"], r["recommended_rule"], r["classification"], r["rule"], r["dup_group"]) for r in pair] == [("MONITOR", "MS-DUP-03", "KEEP", "MS-CLS-05", None)] * 2


def test_items_left_out(world):
    got = world["20031"]
    assert (got["classification"], got["rule"], got["decision_status"], got["recommended"], got["items"], got["all_items"]) == ("CLOSE", "MS-TRN-02", "decided", "KEEP", 0, 1)
    assert "left out" in got["trail"][-1]["text"] and got["pending"] == ""
    got = world["20032"]
    assert got["classification"] == "KEEP" and not got["left_out"] and got["pending"] == "1 stuck open item"
    assert world["20033"]["classification"] == "KEEP" and world["20034"]["classification"] == "KEEP"


def test_the_same_voucher_of_two_clients_is_two_items(spark):
    rows = [("HOC", c, "1", "7", "N", "2026-01-01", a) for c, a in (("CA", 5.0), ("CM", -5.0), ("CA", 0.0))]
    df = spark.createDataFrame(rows, "house string, client string, apar_id string, voucher_no string, status string, trans_date string, rest_amount double").withColumn("trans_date", F.to_date("trans_date"))
    assert sorted((r["item_key"], r["balance"], r["item_status"]) for r in pipeline.open_items(df, pipeline.Rules(AS_OF)).collect()) == [("HOC|CA|1|7", 5.0, "Needs review"), ("HOC|CM|1|7", -5.0, "Needs review")]


def test_follow_through_and_missing_records(world):
    assert {i: (world[i]["classification"], world[i]["follow_through"]) for i in ("20041", "20042", "20044")} == {"20041": ("OUT_OF_SCOPE", "Actioned in Unit4"), "20042": ("CLOSE", "Not yet actioned in Unit4"), "20044": ("NOT_IN_EXTRACT", "Not in latest extract")}
    gone = world["20044"]
    assert (gone["apar_name"], gone["house"], gone["decision_status"], gone["reasons_tags"], gone["fired"], gone["trail"]) == ("Gone Ltd", "HOC", "decided", "Not in extract", [], None)
    assert "20099" not in world  # only decisions about the class bring a record back


def test_alert_where_another_record_is_used_after_confirmation(world):
    assert world["20052"]["preferred"] and world["20051"]["alert"] and not world["20052"]["alert"] and world["20051"]["classification"] == "MONITOR"
    assert world["20054"]["preferred"] and not world["20053"]["alert"]


def test_possible_duplicates_and_what_settles_them(world):
    for i in ("20061", "20062"):
        r = world[i]
        assert r["possible_duplicate"] and "Review possible duplicate" in r["pending"] and "Possible duplicate" in r["reasons_tags"] and "MS-DUP-02" in r["fired"]
    settled = [str(i) for i in range(20063, 20071)] + ["20081", "20082"]  # parted, linked, no duplicate, one group already, not commercial
    assert not any(world[i]["possible_duplicate"] for i in settled)
    assert {i for i in settled if world[i]["dup_group"]} == {"20065", "20066", "20069", "20070"}


def test_cross_house_is_a_tag_and_no_group(spark):
    rows = [{"apar_id": "20005", "vat_reg_no": "GB245719348"}, {"apar_id": "52000", "house": "HOL", "client": "LA", "apar_gr_id": "01", "vat_reg_no": "GB245719348"}, {"apar_id": "52001", "house": "HOL", "client": "LA", "apar_gr_id": "01", "vat_reg_no": "GB245719348", "bank_account": "77777777"}]
    got = migrated(spark, rows, [("20005", NOW)])
    assert got["20005"]["cross_house"] == "Same VAT number as HOL|52000 and 1 more" and got["20005"]["dup_group"] is None
    assert got["52000"]["cross_house"] == got["52001"]["cross_house"] == "Same VAT number as HOC|20005" and got["52000"]["dup_group"] == "HOL|52000"
    assert "Cross-House" in got["20005"]["reasons_tags"] and "MS-XH-01" in got["20005"]["fired"]
    got = migrated(spark, rows, [("20005", NOW)], rules=pipeline.Rules(AS_OF, cross_house_as_duplicate=True))
    assert {r["dup_group"] for r in got.values()} == {"HOC|20005"}


def test_mask_gives_class_rules_and_tags(spark):
    row = lambda **on: {n: F.lit(n in on) for n in trace.NAMES}
    cases = {
        "population active": ("KEEP", "MS-CLS-05"), "population": ("CLOSE", "MS-CLS-01"), "population left_out": ("CLOSE", "MS-TRN-02"), "population left_out open": ("KEEP", "MS-CLS-05"), "population active tie grouped": ("MONITOR", "MS-DUP-03"),
        "population active grouped": ("CLOSE", "MS-CLS-02"), "population active recent grouped": ("MONITOR", "MS-CLS-03"), "population open grouped": ("MONITOR", "MS-CLS-03"), "population active grouped preferred blocked": ("FIX", "MS-CLS-04"),
        "population by_group by_range": ("HOLD_NONCOMMERCIAL", "MS-CAT-01"), "population policy": ("HOLD_POLICY", "MS-CAT-03"), "legacy active": ("OUT_OF_SCOPE", "MS-POP-01"),
    }
    for text, want in cases.items():
        m = trace.mask(row(**dict.fromkeys(text.split())))
        got = spark.range(1).select(trace.classed(m).alias("c"), trace.fired(m, F.lit(want[1])).alias("f"), trace.tags(m, F.lit(want[1])).alias("t")).first()
        assert tuple(got["c"]) == want, text
        assert (want[1] in got["f"]) == ("population" in text) and len(set(got["f"])) == len(got["f"])
        assert got["t"] == {"legacy active": "Legacy exclusion", "population active": "Active", "population": "Dormant"}.get(text, got["t"])


def test_a_trail_ends_with_the_rule_of_the_class(spark):
    rows = [{"apar_id": "20001"}, {"apar_id": "20002", "terms_id": None}, {"apar_id": "20003"}, {"apar_id": "20004", "status": "C"}, {"apar_id": "20005", "apar_gr_id": "ME"}, {"apar_id": "20006", "bank_account": "55555555", "apar_gr_id": "TI"}, {"apar_id": "20007", "bank_account": "55555555"}, {"apar_id": "20008", "bank_account": "66666666"}, {"apar_id": "20009", "bank_account": "66666666"}]
    got = migrated(spark, rows, [*((i, NOW) for i in ("20001", "20002", "20006", "20008", "20009")), ("20007", AGO)])
    for r in got.values():
        assert r["trail"][-1]["rule"] == r["rule"] and r["trail"][-1]["result"] == {"KEEP": "pass"}.get(r["classification"], "stop" if r["rule"].startswith(("MS-POP", "MS-CAT")) else "fail")
    assert "Member" in got["20005"]["trail"][-1]["text"] and "Individual contractor" in got["20006"]["reasons_tags"] and "MS-CAT-04" in got["20006"]["fired"]
    assert {r["rule"] for r in got.values()} == {"MS-CLS-05", "MS-CLS-04", "MS-CLS-01", "MS-POP-01", "MS-CAT-01", "MS-CLS-02", "MS-DUP-03"}


def test_causes_of_changes(spark):
    rows = [{"apar_id": f"2000{i}"} for i in range(1, 7)]
    now = [(f"2000{i}", NOW) for i in range(1, 7)]
    before = positions(spark, rows, now)
    later = [*({**r, "status": "C"} if r["apar_id"] == "20002" else {**r, "terms_id": None} if r["apar_id"] == "20003" else r for r in rows[:5]), {"apar_id": "20007"}]
    said = [("record", "HOC|20001", "", "CLOSE", "2026-10-30"), ("record", "HOC|20004", "", "KEEP", "2026-01-01")]
    after = positions(spark, later, [*now, ("20007", NOW)], said=said)
    log = spark.createDataFrame([(i, *x[:4], "r", "s", x[4]) for i, x in enumerate(said)], LOG + ", recorded_at string").withColumn("recorded_at", F.to_date("recorded_at"))
    want = {"HOC|20001": ("KEEP", "CLOSE", "Decision recorded"), "HOC|20002": ("KEEP", "OUT_OF_SCOPE", "Status changed"), "HOC|20003": ("KEEP", "FIX", "Data changed"), "HOC|20006": ("KEEP", "NOT_IN_EXTRACT", "Status changed"), "HOC|20007": ("(new)", "KEEP", "New in extract")}
    got = {r["entity_key"]: (r["before"], r["now"], r["cause"]) for r in decisions.changes(before, after, log, "2026-10-25").collect()}
    assert got == want
    moved = before.withColumn("classification", F.lit("FIX"))
    causes = lambda same: {r["cause"] for r in decisions.changes(moved, before, log.limit(0), "2026-10-25", same).collect()}
    assert causes(True) == {"Other"} and causes(False) == {"Rule change"}
    items = spark.createDataFrame([(1, "item", "HOC|CA|20005|v", None, "MIGRATE", "r", "s", "2026-10-30"), (2, "pair", "HOC|20001", "HOC|20003", "SAME_SUPPLIER", "r", "s", "2026-10-30")], LOG + ", recorded_at string").withColumn("recorded_at", F.to_date("recorded_at"))
    assert {r["entity_key"] for r in decisions.touched(items, F.lit("2026-10-25").cast("date")).collect()} == {"HOC|20005", "HOC|CA|20005|v", "HOC|20001", "HOC|20003"}


def test_near_names_of_the_search(spark):
    rows = [("1", "Alpha Catering Limited", "N"), ("2", "ALPHA CATERING LIMITED ", "N"), ("3", "Alpha Catering Limted", "N"), ("4", "Catering Alpha Limited", "N"), ("5", "Alpha Catering Limitd", "C"), ("6", "Omega", "N")]
    got = pipeline.near_names(supplier(spark, *[{"apar_id": i, "apar_name": n, "status": s} for i, n, s in rows])).collect()
    assert [(r["name_a"], r["name_b"], r["score"], r["records_a"], r["records_b"], r["first_a"]) for r in got] == [("ALPHA CATERING LIMITED", "ALPHA CATERING LIMTED", 98, 2, 1, "1")]
