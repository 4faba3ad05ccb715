"""Classes, changes and tables whose rows go to all tasks, over the smallest test tables."""

from finscope import bindings, queries
from finscope.matching import names
from finscope.migration import decisions, pipeline

SMALL = "/root/testdata/sf0.001"


def test_classes_and_changes_are_those_of_positions_and_need_no_names(spark, monkeypatch):
    f = bindings.frames(spark, SMALL, queries._DECIDING)
    said = decisions.effective(f["decision_log"])
    alone, full = queries._position(f), queries._decided(f)
    fields = ("in_population", "classification", "fingerprint")
    want = {r["entity_key"]: tuple(r[c] for c in fields) for r in full.select("entity_key", *fields).collect()}
    by_rule = {r["entity_key"]: (r["classification"], r["fingerprint"]) for r in alone.select("entity_key", "classification", "fingerprint").collect()}
    changed = sorted(map(tuple, decisions.changes(alone, full, f["decision_log"], "2001-10-01").collect()))

    def compared(*_):
        raise AssertionError("names are compared")

    monkeypatch.setattr(names, "links", compared)
    rows = pipeline.classified(*queries._moved(f), said)
    got = rows.collect()
    assert {r["entity_key"]: tuple(r[c] for c in fields) for r in got} == want
    assert {r["entity_key"]: (r["recommended"], r["recommended_fingerprint"]) for r in got if r["recommended"] is not None} == by_rule and len(by_rule) < len(want)
    assert sorted(map(tuple, decisions.recommended_changes(rows, f["decision_log"], "2001-10-01").collect())) == changed and changed
    assert {r["entity_key"]: (r["classification"], r["fingerprint"]) for r in pipeline.classified(*queries._moved(f)).collect()} == by_rule


def test_rows_of_dealt_tables_go_to_all_tasks(spark):
    rows = [bindings.frames(spark, SMALL, {"asuheader"}, dealt)["asuheader"] for dealt in ((), ("customer",))]
    sizes = [len(p) for p in rows[1].select("apar_id").rdd.glom().collect()]
    assert len(sizes) == 4 and min(sizes) > 0 and sorted(map(str, rows[0].collect())) == sorted(map(str, rows[1].collect()))
