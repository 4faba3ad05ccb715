"""The supplier position: entities, activity, items, issues, groups, classes.

`position` goes over the records twice: by the rules alone (what is recommended)
and with the stewards' decisions. What doesn't depend on decisions is made once
and shared by both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscope.checks import CATALOGUE, core
from finscope.clean import fingerprint, is_blank
from finscope.matching import names, pairs
from finscope.migration import decisions as log
from finscope.migration import trace
from finscope.scratch import written
from finscope.standardise import match_keys, name_core, std_company_no, std_name

CLASSES = ("OUT_OF_SCOPE", "HOLD_NONCOMMERCIAL", "HOLD_POLICY", "CLOSE", "FIX", "MONITOR", "KEEP")
#: What is handed over as it stands.
IN_SCOPE = ("KEEP", "FIX", "MONITOR")
#: What a shared key is called, and the check that looks for it.
KEY_LABELS = {"key_vat": ("Same VAT number", "SUP_VAT_DUP"), "key_company": ("Same company number", "SUP_XHOUSE_COMP_REG_DUP"), "key_bank": ("Same bank details", "SUP_BANK_SORT_DUP"), "key_name": ("Same name and postcode", "SUP_NAME_DUP")}
#: What a group or a range of ids stands for.
GROUP_MEANING = {("HOC", "EM"): "Employee", ("HOC", "ME"): "Member", ("HOC", "SA"): "Specialist Advisor", ("HOC", "WI"): "Witness", ("HOL", "05"): "Member (Peer)", ("HOL", "06"): "Employee", ("HOL", "03"): "Card account"}
RANGE_MEANING = {("HOC", "1000"): "Employee (iTrent)", ("HOC", "74"): "Legacy employee", ("HOL", "1"): "Employee", ("HOL", "2"): "Employee (weekly payroll)", ("HOL", "3"): "Member (Peer)"}
#: Checks that a position leaves out, and those that keep a record from being migrated as it is.
IGNORED_TESTS = ("SUP_NAME_DUP", "SUP_NAME_DUP_ANY", "SUP_VAT_DUP", "SUP_BANK_SORT_DUP", "SUP_BANK_DUP", "SUP_CLIENT_APAR_DUP", "SUP_DORMANT")
BLOCKING_TESTS = (
    "SUP_TERMS_MISSING", "SUP_PAY_METHOD_MISSING", "SUP_CURRENCY_MISSING", "SUP_SORT_IBAN_MISSING", "SUP_SORT_FORMAT", "SUP_BANK_FORMAT", "SUP_BACS_NO_BANK", "SUP_INT_NO_IBAN",
    "SUP_VAT_MISSING", "SUP_VAT_FORMAT", "SUP_COMP_REG_FORMAT", "SUP_ADDR_MISSING", "SUP_ZIP_MISSING", "MS-DQ-NAME", "MS-DQ-LTD-COMPNO",
)
#: What makes a record complete.
COMPLETE = ("vat_reg_no", "comp_reg_no", "bank_account", "address", "zip_code", "place", "terms_id", "pay_method")
#: What of a record's data its class depends on.
FINGERPRINT = ["last_activity", "items", "open_orders", "blocking", "dup_group", "in_population"]
#: Keys of which the rows of one record should hold one value.
AGREE = ("key_bank", "key_vat", "key_company", "key_name")
ROW_TESTS = [c for c in CATALOGUE if c.table == "asuheader" and c.id not in IGNORED_TESTS and not core.used(c.fails + c.population)]


@dataclass(frozen=True)
class Rules:
    """Lists (by house where they differ) and thresholds of the classification."""

    as_of: str
    statuses: tuple = ("N", "P")
    clients: tuple = (("HOC", ("CA", "CM")), ("HOL", ("LA",)))
    legacy_prefixes: tuple = (("HOC", ("89", "99")),)
    legacy_names: tuple = ("SZSINGLES",)
    noncommercial_groups: tuple = (("HOC", ("EM", "ME", "SA", "WI")), ("HOL", ("05", "06")))
    noncommercial_prefixes: tuple = (("HOC", ("1000", "74")), ("HOL", ("1", "2", "3")))
    policy_groups: tuple = (("HOL", ("03",)),)
    individual_groups: tuple = (("HOC", ("TI", "TO")),)
    group_id_houses: tuple = ("HOL",)
    invoice_types: tuple = ("CP", "ID", "IF", "II", "IU", "OP", "PI", "RD", "RI", "SI", "SR", "IB", "BH", "CN", "IC", "IN", "RC")
    open_order_statuses: tuple = ("O", "N", "A")
    dormant_months: int = 18
    monitor_months: int = 6
    stuck_months: int = 2
    similarity: float = 90.0
    cross_house_as_duplicate: bool = False


def _by_house(lists: tuple, test) -> Column:
    """True where the row's house has a list and test(list) holds."""
    out = F.lit(False)
    for house, values in lists:
        out = out | ((F.col("house") == house) & test(values))
    return F.coalesce(out, F.lit(False))


def _in(column: str):
    return lambda values: F.trim(column).isin(*values)


def _starts(column: str):
    def test(values):
        out = F.lit(False)
        for v in values:
            out = out | F.col(column).startswith(v)
        return out

    return test


def scoped(master: DataFrame, rules: Rules) -> DataFrame:
    """Rows of the clients in scope, with entity_key, match keys, and whether a row is of the population (its status, and no legacy record)."""
    rows = match_keys(master).where(_by_house(rules.clients, _in("client")))
    legacy = F.coalesce(F.upper(F.trim("apar_name")).isin(*rules.legacy_names), F.lit(False)) | _by_house(rules.legacy_prefixes, _starts("apar_id"))
    return rows.withColumns({"entity_key": F.concat_ws("|", "house", "apar_id"), "legacy": legacy, "in_scope": F.coalesce(F.col("status").isin(*rules.statuses), F.lit(False)) & ~legacy})


def entities(master: DataFrame, rules: Rules) -> DataFrame:
    """One row for each house and id: its best row (of the population, active, first client), all its clients and statuses, and its category.

    The category comes from the group, else from the range of the id.
    """
    return _entities(scoped(master, rules), rules)


def _entities(rows: DataFrame, rules: Rules) -> DataFrame:
    best = Window.partitionBy("entity_key").orderBy(F.desc("in_scope"), F.when(F.col("status") == "N", 0).otherwise(1), "client", "apar_name")
    every = Window.partitionBy("entity_key")
    out = rows.withColumns({
        "_n": F.row_number().over(best),
        "clients": F.array_join(F.array_sort(F.collect_set("client").over(every)), ","),
        "statuses": F.array_join(F.array_sort(F.collect_set("status").over(every)), ","),
        "in_population": F.max("in_scope").over(every),
    })
    by_group, by_id = _by_house(rules.noncommercial_groups, _in("apar_gr_id")), _by_house(rules.noncommercial_prefixes, _starts("apar_id"))
    policy = _by_house(rules.policy_groups, _in("apar_gr_id"))
    return out.where("_n = 1").drop("_n", "in_scope").withColumns({
        "category": F.when(by_group | by_id, "Non-commercial").when(policy, "Policy").otherwise("Commercial"),
        "category_rule": F.when(by_group, "MS-CAT-01").when(by_id, "MS-CAT-02").when(policy, "MS-CAT-03"),
        "category_detail": F.coalesce(F.when(by_group | policy, _meaning(GROUP_MEANING, _in("apar_gr_id"))), F.when(by_id, _meaning(RANGE_MEANING, _starts("apar_id"))), F.lit("")),
        "individual": _by_house(rules.individual_groups, _in("apar_gr_id")),
        "group_id_mismatch": F.col("house").isin(*rules.group_id_houses) & (by_group != by_id),
        "completeness": sum((F.when(is_blank(F.col(c)), 0).otherwise(1) for c in COMPLETE), F.lit(0)),
    })


def _meaning(meanings: dict, test) -> Column:
    out = F.lit(None).cast("string")
    for (house, value), text in meanings.items():
        out = F.when((F.col("house") == house) & test((value,)), F.lit(text)).otherwise(out)
    return out


def activity(history: DataFrame, items: DataFrame, orders: DataFrame, rules: Rules) -> DataFrame:
    """Last invoice and last order of each entity, open orders, and the later date of the two."""
    rows = history.select("house", "apar_id", "voucher_type", "trans_date").unionByName(items.select("house", "apar_id", "voucher_type", "trans_date"))
    invoices = rows.where(F.col("voucher_type").isin(*rules.invoice_types)).groupBy("house", "apar_id").agg(F.max("trans_date").alias("last_invoice"))
    bought = orders.groupBy("house", "apar_id").agg(F.max("order_date").alias("last_order"), F.count_if(F.col("status").isin(*rules.open_order_statuses)).alias("open_orders"))
    out = invoices.join(bought, ["house", "apar_id"], "full_outer")
    return out.withColumn("last_activity", F.greatest("last_invoice", "last_order"))


def open_items(items: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """Vouchers of a client with a balance: their age, whether they are stuck, and what a steward says about them. decisions: the effective ones."""
    live = items.where(F.coalesce(F.col("status") != "C", F.lit(True)))
    out = live.groupBy("house", "client", "apar_id", "voucher_no").agg(F.sum("rest_amount").alias("balance"), F.min("trans_date").alias("trans_date")).where("balance <> 0")
    day = F.lit(rules.as_of).cast("date")
    stuck = F.col("trans_date") < F.add_months(day, -rules.stuck_months)
    out = out.withColumns({"item_key": F.concat_ws("|", "house", "client", "apar_id", "voucher_no"), "age_days": F.datediff(day, F.col("trans_date")), "stuck": F.coalesce(stuck, F.lit(False))})
    if decisions is None:
        out = out.withColumn("decision", F.lit(None).cast("string"))
    else:
        out = out.join(log.of(decisions, "item").select(F.col("target_key").alias("item_key"), "decision"), "item_key", "left")
    status = F.when(F.col("decision") == "MIGRATE", "Migrate (steward)").when(F.col("decision") == "DONT_MIGRATE", "Don't migrate (steward)").when(F.col("stuck"), "Needs review").otherwise("Recent: no action")
    return out.withColumn("item_status", status)


def items_by_record(items: DataFrame) -> DataFrame:
    """Items of each record: all of them, those that count (not left out by a steward), stuck ones, and whether all are left out."""
    out = F.coalesce(F.col("decision") == "DONT_MIGRATE", F.lit(False))
    counted = items.groupBy("house", "apar_id").agg(
        F.count("*").alias("all_items"), F.count_if(~out).alias("items"), F.sum(F.when(~out, F.col("balance"))).alias("balance"),
        F.count_if("stuck").alias("stuck_items"), F.count_if(F.col("stuck") & F.col("decision").isNull()).alias("stuck_undecided"),
    )
    return counted.withColumn("left_out", F.col("items") == 0)


def issues(master: DataFrame, rules: Rules) -> DataFrame:
    """(entity_key, client, issue, dimension, blocking): what the catalogue's one-table supplier checks, and four tests of the migration's own, find on each row of the population.

    All tests run in one scan. Rows of a record that hold different keys are one
    issue of its first client, and so is an id whose range and group disagree.
    """
    rows = scoped(master, rules)
    return _issues(rows, _entities(rows, rules), rules)


def _issues(rows: DataFrame, records: DataFrame, rules: Rules) -> DataFrame:
    rows = rows.where("in_scope")
    tests = [(c.id, c.dimension, F.expr(core.dated(f"({c.population}) AND ({c.fails})", rules.as_of))) for c in ROW_TESTS]
    tests.append(("MS-DQ-NAME", "Completeness", is_blank(F.col("apar_name"))))
    tests.append(("MS-DQ-LTD-COMPNO", "Completeness", F.exists(F.split(std_name(F.col("apar_name")), " "), lambda w: w.isin("LTD", "PLC", "LLP")) & (std_company_no(F.col("comp_reg_no")) == "")))
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("issue"), F.lit(d).alias("dimension"))) for n, d, bad in tests])
    out = rows.select("entity_key", "client", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("entity_key", "client", "i.*")
    apart = F.lit(False)
    for key in AGREE:
        apart = apart | (F.col(f"least_{key}") < F.col(f"most_{key}"))
    each = rows.groupBy("entity_key").agg(F.min("client").alias("client"), *[f(k).alias(f"{n}_{k}") for k in AGREE for f, n in ((F.min, "least"), (F.max, "most"))])
    differ = each.where(F.coalesce(apart, F.lit(False))).select("entity_key", "client", F.lit("MS-DQ-CLIENT-DIFF").alias("issue"), F.lit("Consistency").alias("dimension"))
    mismatch = records.where("in_population AND group_id_mismatch").select("entity_key", "client", F.lit("MS-DQ-GROUP-ID").alias("issue"), F.lit("Consistency").alias("dimension"))
    return out.unionByName(differ).unionByName(mismatch).withColumn("blocking", F.col("issue").isin(*BLOCKING_TESTS))


def _commercial(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Match keys of the rows in scope of the commercial records of the population."""
    members = records.where("in_population AND category = 'Commercial'").select("entity_key")
    return rows.where("in_scope").select("entity_key", "house", *pairs.KEYS).join(members, "entity_key", "left_semi")


def duplicate_groups(master: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """(entity_key, dup_group, reasons): groups of commercial records of the population, within a house, over shared keys of any of their rows.

    Records that a steward has said are no duplicates are left out before groups
    are made; pairs said to be the same supplier are linked.
    """
    rows = scoped(master, rules)
    return _grouped(_commercial(rows, _entities(rows, rules)), rules, decisions)


def _grouped(rows: DataFrame, rules: Rules, decisions: DataFrame | None) -> DataFrame:
    if decisions is not None:
        rows = rows.join(log.of(decisions, "dup").where("decision = 'NOT_DUPLICATE'").select(F.col("target_key").alias("entity_key")), "entity_key", "left_anti")
    edges = written(pairs.key_edges(rows, "entity_key", [] if rules.cross_house_as_duplicate else ["house"]), "edges")
    links = None
    if decisions is not None:
        members = rows.select("entity_key").distinct()
        links = log.of(decisions, "pair").where("decision = 'SAME_SUPPLIER'").select(F.col("target_key").alias("a"), F.col("related_key").alias("b"))
        for end in ("a", "b"):
            links = links.join(members.withColumnRenamed("entity_key", end), end, "left_semi")
        edges = edges.unionByName(links.withColumn("key", F.lit("key_steward")))
    grouped = pairs.groups(rows, "entity_key", edges, links)
    both = edges.select(F.col("a").alias("entity_key"), "key").unionByName(edges.select(F.col("b").alias("entity_key"), "key"))
    reasons = both.groupBy("entity_key").agg(F.array_join(F.array_sort(F.collect_set(F.substring("key", 5, 20))), ", ").alias("reasons"))
    return grouped.withColumnRenamed("root", "dup_group").join(reasons, "entity_key", "left")


def cross_house(rows: DataFrame) -> DataFrame:
    """(entity_key, cross_house): the keys that records of another house have too, with the least of them and how many more there are.

    Keys are aggregated by house first, so no pair of records is made.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(key).alias("value")) for key, (label, _) in KEY_LABELS.items()]))
    keyed = rows.select("entity_key", "house", cells.alias("k")).select("entity_key", "house", "k.*").where("value IS NOT NULL").distinct()
    held = keyed.groupBy("label", "value", "house").agg(F.min("entity_key").alias("least"), F.count("*").alias("n"))
    other = held.select("label", "value", F.col("house").alias("_other"), "least", "n")
    met = held.select("label", "value", "house").join(other, ["label", "value"]).where("house <> _other").select("label", "value", "house", "least", "n")
    more = F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    tagged = keyed.join(met, ["label", "value", "house"]).select("entity_key", F.concat("label", F.lit(" as "), "least", more).alias("tag"))
    return tagged.groupBy("entity_key").agg(F.array_join(F.array_sort(F.collect_set("tag")), "; ").alias("cross_house"))


def with_preferred(rows: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """rows with `preferred`, `preferred_tie`, `group_confirmed` and `confirmed_at`.

    Best of a group is the record with the fewest blocking issues, then one with
    open items, the latest activity, the most complete. Records level with it on
    all four are a tie, which a steward settles and no rule does; a confirmed
    record is preferred. A group is aggregated and never sorted as a whole.
    """
    order = F.struct(F.col("blocking"), (~F.col("has_open")).alias("no_open"), F.datediff(F.lit("9999-12-31").cast("date"), F.coalesce("last_activity", F.lit("1900-01-01").cast("date"))).alias("quiet"), (-F.col("completeness")).alias("gaps"))
    rows = rows.withColumn("_order", order)
    best = rows.where("dup_group IS NOT NULL").groupBy("dup_group").agg(F.min("_order").alias("_best"))
    rows = rows.join(best, "dup_group", "left").withColumn("_level", F.coalesce(F.col("_order") == F.col("_best"), F.lit(False)))
    tied = rows.where("_level").groupBy("dup_group").agg(F.count("*").alias("_many"))
    rows = rows.join(tied, "dup_group", "left")
    if decisions is not None:
        said = log.of(decisions, "dup").where("decision = 'CONFIRM_PREFERRED'").select(F.col("target_key").alias("entity_key"), F.col("id").alias("_at"), "recorded_at")
        said = said.join(rows.where("dup_group IS NOT NULL").select("entity_key", "dup_group"), "entity_key")
        said = said.groupBy("dup_group").agg(F.max(F.struct("_at", "entity_key", "recorded_at")).alias("_said"))
        rows = rows.join(said, "dup_group", "left").withColumns({"_confirmed": F.col("_said.entity_key"), "confirmed_at": F.col("_said.recorded_at")}).drop("_said")
    else:
        rows = rows.withColumns({"_confirmed": F.lit(None).cast("string"), "confirmed_at": F.lit(None).cast("date")})
    confirmed = F.col("_confirmed")
    rows = rows.withColumns({
        "preferred": F.when(confirmed.isNotNull(), confirmed == F.col("entity_key")).otherwise(F.col("_level") & (F.col("_many") == 1)),
        "preferred_tie": confirmed.isNull() & F.col("_level") & (F.col("_many") > 1),
        "group_confirmed": confirmed.isNotNull(),
    })
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("preferred", "preferred_tie")}).drop("_order", "_best", "_level", "_many", "_confirmed")


def facts(rows: DataFrame, history: DataFrame, items: DataFrame, orders: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """One row an entity with all that neither pass changes, and its items counted for both. rows: the master's in scope (`scoped`)."""
    records = _entities(rows, rules)
    dims = {d: F.max(F.col("dimension") == d).alias(f"has_{d.lower()}") for d in ("Completeness", "Validity", "Consistency")}
    wrong = _issues(rows, records, rules).groupBy("entity_key").agg(F.count_distinct("issue").alias("issues"), F.count_distinct(F.when(F.col("blocking"), F.col("issue"))).alias("blocking"), *dims.values())
    counted = items_by_record(open_items(items, rules, decisions))
    out = records.join(activity(history, items, orders, rules), ["house", "apar_id"], "left").join(counted, ["house", "apar_id"], "left").join(wrong, "entity_key", "left")
    out = out.na.fill(0, ["all_items", "items", "stuck_items", "stuck_undecided", "issues", "blocking", "open_orders"])
    return out.na.fill(False, ["left_out", *(f"has_{d.lower()}" for d in dims)])


def _conditions(rules: Rules) -> dict[str, Column]:
    day = F.lit(rules.as_of).cast("date")
    since = lambda months: F.col("last_activity") >= F.add_months(day, -months)
    return {
        "population": F.col("in_population"), "legacy": F.col("legacy"), "by_group": F.col("category_rule") == "MS-CAT-01", "by_range": F.col("category_rule") == "MS-CAT-02", "policy": F.col("category_rule") == "MS-CAT-03",
        "individual": F.col("individual"), "active": since(rules.dormant_months), "recent": since(rules.monitor_months), "open": F.col("has_open"), "left_out": F.col("left_out"), "grouped": F.col("dup_group").isNotNull(),
        "preferred": F.col("preferred"), "tie": F.col("preferred_tie"), "blocked": F.col("blocking") > 0, "stuck": F.col("stuck_items") > 0,
        "validity": F.col("has_validity"), "completeness": F.col("has_completeness"), "consistency": F.col("has_consistency"),
    }


def _passed(rows: DataFrame, rules: Rules, decisions: DataFrame | None) -> DataFrame:
    """rows (with dup_group, items and left_out of this pass) with the preferred records, the mask of conditions, class and rule."""
    rows = with_preferred(rows.withColumn("has_open", (F.col("items") > 0) | (F.col("open_orders") > 0)), decisions)
    rows = rows.withColumn("mask", trace.mask(_conditions(rules))).withColumn("_r", trace.classed(F.col("mask")))
    return rows.withColumns({"classification": F.col("_r.class"), "rule": F.col("_r.rule")}).drop("_r")


def _passes(master: DataFrame, history: DataFrame, items: DataFrame, orders: DataFrame, rules: Rules, decisions: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Facts, match keys, groups, and one row an entity with its class and what the rules alone say of it. decisions: written."""
    master = written(scoped(master, rules), "scoped")
    base = written(facts(master, history, items, orders, rules, decisions), "facts")
    rows = written(_commercial(master, base), "keys")
    groups = by_rule = written(_grouped(rows, rules, None), "groups")
    if decisions is not None:
        groups = written(_grouped(rows, rules, decisions), "groups")
    out = _passed(base.join(groups, "entity_key", "left"), rules, decisions)
    said = {"recommended": F.col("classification"), "recommended_rule": F.col("rule"), "recommended_fingerprint": fingerprint(FINGERPRINT)}
    if decisions is None:
        return base, rows, groups, out.withColumns(said)
    alone = base.join(by_rule, "entity_key", "left").withColumns({"items": F.col("all_items"), "left_out": F.lit(False)})
    alone = _passed(alone, rules, None).select("entity_key", *[c.alias(n) for n, c in said.items()])
    return base, rows, groups, out.join(alone, "entity_key", "left")


def position(master: DataFrame, history: DataFrame, items: DataFrame, orders: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """One row an entity with its class, the rule behind it, what the rules alone recommend and what stewards have said.

    decisions: the effective ones. Records that only a decision knows come last,
    as NOT_IN_EXTRACT.
    """
    decisions = None if decisions is None else written(decisions, "decisions")
    base, rows, groups, out = _passes(master, history, items, orders, rules, decisions)
    near = _partners(base, groups, rules, decisions)
    out = out.drop("recommended_fingerprint").join(near, "entity_key", "left").join(cross_house(rows), "entity_key", "left")
    out = out.withColumn("possible_duplicate", F.col("partners").isNotNull()).drop("partners")
    return _traced(_decided(out, decisions), rules)


def classified(master: DataFrame, history: DataFrame, items: DataFrame, orders: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """(entity_key, house, in_population, classification, fingerprint, recommended, recommended_fingerprint) of each record of `position`: its class and fingerprint, and those that it has by the rules alone.

    recommended is null for a record that only a decision knows. Neither classes
    nor fingerprints depend on possible duplicates, so no names are compared.
    """
    decisions = None if decisions is None else written(decisions, "decisions")
    out = _passes(master, history, items, orders, rules, decisions)[-1].withColumn("possible_duplicate", F.lit(None).cast("boolean"))
    out = _decided(out, decisions).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("items", "open_orders", "blocking")})
    return out.select("entity_key", "house", "in_population", "classification", fingerprint(FINGERPRINT).alias("fingerprint"), "recommended", "recommended_fingerprint")


def _decided(rows: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """rows with what stewards have said on the record: the class it then has, what is pending, its status and what became of it in the ledger."""
    fields = {"decision": "decision", "decision_by": "steward", "decision_at": "recorded_at", "decision_reason": "reason", "decision_recommendation": "recommendation"}
    if decisions is None:
        rows = rows.withColumns({c: F.lit(None).cast("date" if c == "decision_at" else "string") for c in [*fields, "_label"]}).withColumn("missing", F.lit(False))
    else:
        said = log.of(decisions, "scope").select(F.col("target_key").alias("entity_key"), *[F.col(c).alias(n) for n, c in fields.items()], F.col("record_label").alias("_label"))
        rows = rows.withColumn("_here", F.lit(True)).join(said, "entity_key", "full_outer").withColumn("missing", F.col("_here").isNull()).drop("_here")
    parts = F.split("entity_key", r"\|")
    rows = rows.withColumns({
        "house": F.coalesce("house", parts[0]), "apar_id": F.coalesce("apar_id", F.get(parts, F.lit(1))), "apar_name": F.when(F.col("missing"), F.col("_label")).otherwise(F.col("apar_name")),
        "in_population": F.coalesce("in_population", F.lit(False)),
    }).drop("_label")
    d, by_rule, here = F.col("decision"), F.col("classification"), F.col("in_population")
    final = (
        F.when(F.col("missing"), "NOT_IN_EXTRACT")
        .when((d == "KEEP") & here, F.when(F.col("blocking") > 0, "FIX").otherwise("KEEP"))
        .when((d == "CLOSE") & here, "CLOSE").when((d == "ACCEPT_AS_IS") & here & (by_rule == "FIX"), "KEEP").otherwise(by_rule)
    )
    rows = rows.withColumns({"_final": final, "overridden": F.coalesce((final != by_rule) & d.isNotNull(), F.lit(False))})
    rows = rows.withColumn("classification", F.col("_final")).drop("_final")
    settled = F.coalesce(F.col("rule") == "MS-TRN-02", F.lit(False))  # follows from decisions on the items
    confirm = F.col("classification").isin("CLOSE", "MONITOR", "FIX", "HOLD_NONCOMMERCIAL", "HOLD_POLICY") & d.isNull() & ~settled
    waits = [
        (confirm, F.lit("Confirm classification")), (F.col("dup_group").isNotNull() & ~F.col("group_confirmed"), F.lit("Confirm preferred record")), (F.col("possible_duplicate"), F.lit("Review possible duplicate")),
        (F.col("stuck_undecided") > 0, F.concat(F.col("stuck_undecided").cast("string"), F.lit(" stuck open item"), F.when(F.col("stuck_undecided") > 1, F.lit("s")).otherwise(F.lit("")))),
    ]
    pending = F.array_join(F.array_compact(F.array(*[F.when(here & when, text) for when, text in waits])), "; ")
    rows = rows.withColumn("pending", pending)
    status = F.when(F.col("missing"), "decided").when(F.col("overridden"), "override").when(F.col("pending") != "", "awaiting").when(d.isNotNull() | settled, "decided").otherwise("none")
    agreed = F.coalesce(d == "AGREE", F.lit(False))
    close = F.coalesce(d == "CLOSE", F.lit(False)) | (agreed & F.coalesce(F.col("decision_recommendation") == "CLOSE", F.lit(False)))
    keep = F.coalesce(d.isin("KEEP", "WILL_FIX", "ACCEPT_AS_IS"), F.lit(False)) | (agreed & F.coalesce(F.col("decision_recommendation").isin(*IN_SCOPE), F.lit(False)))
    follow = F.when(F.col("missing"), "Not in latest extract").when(close & ~here, "Actioned in Unit4").when(close & here, "Not yet actioned in Unit4").when(keep & ~here, "Conflict: closed in Unit4 against a Keep decision").otherwise("")
    used = F.col("dup_group").isNotNull() & ~F.col("preferred") & ~F.col("preferred_tie") & F.col("group_confirmed") & (F.col("last_activity") > F.col("confirmed_at"))
    alert = F.when(used, "Non-preferred supplier used after the preferred record was confirmed").otherwise("")
    return rows.withColumns({"decision_status": status, "follow_through": follow, "alert": alert})


def _traced(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows with what is recommended, the rules that fired, tags, the way to the class, and a fingerprint of the data behind it."""
    bit = lambda name, c: F.when(F.coalesce(c, F.lit(False)), F.lit(1 << trace.NAMES.index(name))).otherwise(F.lit(0)).cast("long")
    m = F.coalesce("mask", F.lit(0)).cast("long").bitwiseOR(bit("possible", F.col("possible_duplicate"))).bitwiseOR(bit("cross_house", F.col("cross_house").isNotNull())).bitwiseOR(bit("missing", F.col("missing")))
    rows = rows.withColumn("mask", m).withColumns({"recommended": F.coalesce("recommended", "classification"), "recommended_rule": F.coalesce("recommended_rule", F.lit(""))})
    whole = {c: F.coalesce(c, F.lit(0)) for c in ("items", "open_orders", "issues", "blocking", "stuck_items", "stuck_undecided")} | {c: F.coalesce(c, F.lit(False)) for c in ("possible_duplicate", "preferred", "preferred_tie", "group_confirmed")}
    rows = rows.withColumns(whole)
    mask = F.col("mask")
    return rows.withColumns({
        "fired": F.when(F.col("missing"), F.array().cast("array<string>")).otherwise(trace.fired(mask, F.col("recommended_rule"))), "reasons_tags": trace.tags(mask, F.col("rule")), "trail": F.when(F.col("missing"), F.lit(None)).otherwise(trace.trail(mask, rules)),
        "fingerprint": fingerprint(FINGERPRINT),
    })


def _named(rows: DataFrame) -> DataFrame:
    """Classes of the commercial records of the population by name, within a house and the first two letters of the name."""
    named = rows.where("in_population AND category = 'Commercial'").withColumn("core", name_core(F.col("apar_name"))).where("core <> ''").withColumn("block", F.substring("core", 1, 2))
    return names.classes(named, "entity_key", "core", ["house", "block"])


def _partners(rows: DataFrame, groups: DataFrame, rules: Rules, decisions: DataFrame | None) -> DataFrame:
    """(entity_key, partners): how many records a record may be a duplicate of, without its group and what stewards have decided."""
    members = _named(rows).join(groups.select(F.col("entity_key").alias("entity"), F.col("dup_group").alias("grp")), "entity", "left")
    parted = None
    if decisions is not None:
        members = members.join(log.of(decisions, "dup").where("decision = 'NOT_DUPLICATE'").select(F.col("target_key").alias("entity")), "entity", "left_anti")
        parted = log.of(decisions, "pair").select(F.col("target_key").alias("a"), F.col("related_key").alias("b"))
    members = written(members, "names")
    linked = written(names.links(members, ["house", "block"], rules.similarity), "links")
    return names.partners(members, linked, ["house", "block"], parted).withColumnRenamed("entity", "entity_key")


def possible_duplicates(master: DataFrame, rules: Rules, decisions: DataFrame | None = None) -> DataFrame:
    """(entity_key, partners) of each commercial record whose name is near that of another one of its house: nobody has decided on the two, and they are in no group together."""
    rows = written(scoped(master, rules), "scoped")
    records = _entities(rows, rules)
    return _partners(records, _grouped(_commercial(rows, records), rules, decisions), rules, decisions)


def name_classes(master: DataFrame, rules: Rules) -> DataFrame:
    """(house, name_a, name_b, score, records_a, records_b, first_a, first_b): the names, words sorted, behind the possible duplicates, whatever was decided; equal names stand with themselves."""
    members = written(_named(entities(master, rules)), "names")
    return _with_holders(names.links(members, ["house", "block"], rules.similarity), members)


def _with_holders(linked: DataFrame, members: DataFrame) -> DataFrame:
    """linked names with how many records bear each, and the least of them."""
    held = members.groupBy("house", "block", "name").agg(F.count("*").alias("records"), F.min("entity").alias("first"))
    for end in ("a", "b"):
        linked = linked.join(held.select("house", "block", F.col("name").alias(f"name_{end}"), F.col("records").alias(f"records_{end}"), F.col("first").alias(f"first_{end}")), ["house", "block", f"name_{end}"])
    return linked.select("house", "name_a", "name_b", F.bround("score").cast("long").alias("score"), "records_a", "records_b", "first_a", "first_b")


def near_names(master: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Names of a house that are nearly but not quite the same, within a first letter, over records that aren't closed: (house, name_a, name_b, score, records_a, records_b, first_a, first_b).

    Of rows with the same id the first by client and name counts; first is the
    least id with that name.
    """
    rows = master.where(F.coalesce(F.col("status") != "C", F.lit(True)))
    first = rows.groupBy("house", "apar_id").agg(F.min(F.struct("client", "apar_name")).alias("r"))
    named = first.select("house", "apar_id", F.upper(F.trim(F.coalesce("r.apar_name", F.lit("")))).alias("plain")).where("plain <> ''").withColumn("block", F.substring("plain", 1, 1))
    members = written(names.classes(named, "apar_id", "plain", ["house", "block"]), "names")
    return _with_holders(names.near(members, ["house", "block"], "name", threshold), members).where("score < 100")


def funnel(positions: DataFrame) -> DataFrame:
    """Counts by house and in all, of the records of the extract. positions: also as `classified`."""
    rows = positions.where("classification <> 'NOT_IN_EXTRACT'")
    return rows.rollup("house").agg(F.count("*").alias("records"), F.count_if("in_population").alias("in_population"), *[F.count_if(F.col("classification") == c).alias(c.lower()) for c in CLASSES]).withColumn("house", F.coalesce("house", F.lit("Total")))
