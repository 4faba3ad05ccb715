"""Stewards' decisions, monthly snapshots, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscope.clean import is_blank
from finscope.scratch import written

#: Decisions on each kind of target by family; a later one of a family takes the place of an earlier one.
FAMILIES = {
    "scope": ("record", ("AGREE", "KEEP", "CLOSE", "WILL_FIX", "ACCEPT_AS_IS")),
    "dup": ("record", ("CONFIRM_PREFERRED", "NOT_DUPLICATE")),
    "pair": ("pair", ("SAME_SUPPLIER", "DIFFERENT_SUPPLIER")),
    "item": ("item", ("MIGRATE", "DONT_MIGRATE")),
}
#: Columns of a log besides id, target_type, target_key, related_key and decision, null where a log lacks them.
DETAILS = {"reason": "string", "steward": "string", "recorded_at": "date", "recommendation": "string", "record_label": "string", "ruleset_version": "string"}


def family(decision: Column) -> Column:
    """Null for what is no decision."""
    out = F.lit(None).cast("string")
    for name, (_, decisions) in FAMILIES.items():
        out = F.when(decision.isin(*decisions), F.lit(name)).otherwise(out)
    return out


def normalised(decisions: DataFrame) -> DataFrame:
    """Pairs with the lesser key first."""
    pair = F.col("target_type") == "pair"
    a, b = F.least("target_key", "related_key"), F.greatest("target_key", "related_key")
    return decisions.withColumns({"target_key": F.when(pair, a).otherwise(F.col("target_key")), "related_key": F.when(pair, b).otherwise(F.coalesce("related_key", F.lit("")))})


def effective(log: DataFrame, order: str = "id") -> DataFrame:
    """The latest decision of each family about each target, with `family`; ties by the decision itself. What is no decision is left out."""
    log = log.withColumns({c: F.lit(None).cast(kind) for c, kind in DETAILS.items() if c not in log.columns})
    known = normalised(log).withColumn("family", family(F.col("decision"))).where("family IS NOT NULL")
    last = Window.partitionBy("target_type", "target_key", "related_key", "family").orderBy(F.desc(order), "decision")
    return known.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def of(decisions: DataFrame, name: str) -> DataFrame:
    """Effective decisions of a family on the kind of target it is made about."""
    return decisions.where((F.col("family") == name) & (F.col("target_type") == FAMILIES[name][0]))


def triage(upload: DataFrame, log: DataFrame) -> DataFrame:
    """upload with `verdict` and `rejected_because`: rejected, already recorded, changed or new."""
    ok = F.lit(False)
    for kind, decisions in FAMILIES.values():
        ok = ok | ((F.col("target_type") == kind) & F.col("decision").isin(*decisions))
    own = family(F.col("decision")).alias("_family")
    now = effective(log).select("target_type", "target_key", "related_key", F.col("family").alias("_family"), F.col("decision").alias("_old"))
    rows = normalised(upload).withColumn("_family", own).join(now, ["target_type", "target_key", "related_key", "_family"], "left").drop("_family")
    reason = F.when(is_blank(F.col("target_key")), "no target").when(~F.coalesce(ok, F.lit(False)), "unknown decision").when(is_blank(F.col("steward")), "no steward").when(is_blank(F.col("reason")), "no reason")
    verdict = F.when(reason.isNotNull(), "rejected").when(F.col("_old") == F.col("decision"), "already recorded").when(F.col("_old").isNotNull(), "changed").otherwise("new")
    return rows.withColumns({"rejected_because": reason, "verdict": verdict}).drop("_old")


def append(upload: DataFrame, log: DataFrame, path: str) -> None:
    """Write what is new or changed behind the log; nothing is overwritten."""
    triage(upload, log).where(F.col("verdict").isin("new", "changed")).drop("verdict", "rejected_because").write.mode("append").parquet(path)


SNAPSHOT = ("entity_key", "house", "classification", "recommended", "decision_status", "dup_group", "fingerprint", "blocking", "issues")


def save_snapshot(positions: DataFrame, path: str, month: str, taken_at: str, ruleset_version: str = "") -> None:
    positions.select(F.lit(month).alias("month"), F.lit(taken_at).alias("taken_at"), F.lit(ruleset_version).alias("ruleset_version"), *SNAPSHOT).write.mode("append").parquet(path)


def current(snapshots: DataFrame) -> DataFrame:
    """Each month's latest snapshot; earlier ones of the month are superseded."""
    latest = snapshots.groupBy("month").agg(F.max("taken_at").alias("taken_at"))
    return snapshots.join(latest, ["month", "taken_at"], "left_semi")


def trend(snapshots: DataFrame) -> DataFrame:
    return current(snapshots).groupBy("month", "classification").agg(F.count("*").alias("records"))


def touched(log: DataFrame, since: Column) -> DataFrame:
    """(entity_key): records that decisions recorded on that day or later are about; an item's is that of its house and id."""
    new = log.where(F.col("recorded_at") >= since)
    parts = F.split("target_key", r"\|")
    item = F.when(F.col("target_type") == "item", F.concat_ws("|", F.get(parts, F.lit(0)), F.get(parts, F.lit(2))))
    keys = F.explode(F.array("target_key", F.coalesce("related_key", F.lit("")), item))
    return new.select(keys.alias("entity_key")).where("entity_key <> ''").distinct()


def changes(before: DataFrame, after: DataFrame, log: DataFrame, taken_at: str, same_rules: bool = True) -> DataFrame:
    """(entity_key, house, before, now, cause) of the records whose class isn't that of the snapshot `before`, taken on the day taken_at.

    The first that holds of: a decision about the record or one of its items since
    then, new in the extract, out of the population now, other data, other rules.
    """
    old = before.select("entity_key", F.col("classification").alias("before"), F.col("fingerprint").alias("_old"))
    new = after.select("entity_key", F.col("classification").alias("now"), F.col("fingerprint").alias("_new"), "in_population")
    both = old.join(new, "entity_key", "full_outer").withColumns({"before": F.coalesce("before", F.lit("(new)")), "now": F.coalesce("now", F.lit("NOT_IN_EXTRACT"))}).where("before <> now")
    both = both.join(touched(log, F.lit(taken_at).cast("date")).withColumn("_said", F.lit(True)), "entity_key", "left")
    cause = (
        F.when(F.col("_said"), "Decision recorded").when(F.col("before") == "(new)", "New in extract").when(~F.coalesce("in_population", F.lit(False)), "Status changed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "Data changed").otherwise("Other" if same_rules else "Rule change")
    )
    return both.select("entity_key", F.split("entity_key", r"\|")[0].alias("house"), "before", "now", cause.alias("cause"))


def recommended_changes(classified: DataFrame, log: DataFrame, taken_at: str) -> DataFrame:
    """`changes` from what the rules alone say of the records to their classes, both of one position (`pipeline.classified`)."""
    rows = written(classified, "classified")
    alone = rows.where("recommended IS NOT NULL").select("entity_key", F.col("recommended").alias("classification"), F.col("recommended_fingerprint").alias("fingerprint"))
    return changes(alone, rows, log, taken_at)


def worklists(positions: DataFrame) -> dict[str, DataFrame]:
    """What stewards have to look at, by kind."""
    cols = ["entity_key", "house", "apar_name", "classification", "rule", "dup_group", "issues", "blocking", "items", "last_activity", "pending"]
    p = positions.select(*cols, "preferred", "stuck_items", "decision_status")
    return {
        "close": p.where("classification = 'CLOSE'"), "fix": p.where("classification = 'FIX'"), "monitor": p.where("classification = 'MONITOR'"), "hold": p.where("classification LIKE 'HOLD%'"),
        "duplicates": p.where("dup_group IS NOT NULL"), "stuck_items": p.where("stuck_items > 0"), "overrides": p.where("decision_status = 'override'"),
    }


def governance(log: DataFrame) -> DataFrame:
    """Decisions by steward and kind."""
    return effective(log).groupBy("steward", "target_type", "decision").agg(F.count("*").alias("decisions"))
