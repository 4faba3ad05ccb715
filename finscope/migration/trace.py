"""The conditions behind a record's class, evaluated once into a mask; class, rules that fired, tags and the way there follow from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conditions, one bit each.
NAMES = (
    "population", "legacy", "by_group", "by_range", "policy", "individual", "active", "recent", "open", "left_out", "grouped", "preferred", "tie", "blocked",
    "possible", "cross_house", "stuck", "validity", "completeness", "consistency", "missing",
)
_BIT = {name: 1 << i for i, name in enumerate(NAMES)}

#: Class and rule by the first line whose conditions hold; ! in front: must not hold.
CLASSES = (
    ("OUT_OF_SCOPE", "MS-POP-01", "!population"),
    ("HOLD_NONCOMMERCIAL", "MS-CAT-01", "by_group"),
    ("HOLD_NONCOMMERCIAL", "MS-CAT-02", "by_range"),
    ("HOLD_POLICY", "MS-CAT-03", "policy"),
    ("CLOSE", "MS-TRN-02", "left_out !active !open"),
    ("CLOSE", "MS-CLS-01", "!active !open"),
    ("MONITOR", "MS-DUP-03", "tie"),
    ("MONITOR", "MS-CLS-03", "grouped !preferred recent"),
    ("MONITOR", "MS-CLS-03", "grouped !preferred open"),
    ("CLOSE", "MS-CLS-02", "grouped !preferred"),
    ("FIX", "MS-CLS-04", "blocked"),
    ("KEEP", "MS-CLS-05", ""),
)
#: Rules that have fired where the conditions hold.
FIRED = (
    ("MS-POP-01", "population"), ("MS-POP-02", "population"), ("MS-POP-03", "!population legacy"), ("MS-CAT-01", "population by_group"), ("MS-CAT-02", "population by_range !by_group"),
    ("MS-CAT-03", "population policy"), ("MS-CAT-04", "population individual"), ("MS-DUP-01", "population grouped"), ("MS-DUP-03", "population grouped preferred"), ("MS-DUP-03", "population grouped tie"),
    ("MS-DUP-02", "population possible"), ("MS-XH-01", "population cross_house"), ("MS-TRN-01", "population stuck"),
)
#: Tags, in the order in which they are given; those before `Non-commercial` stand alone.
TAGS = (
    ("Not in extract", "missing"), ("Legacy exclusion", "!missing !population legacy"), ("Closed in Unit4", "!missing !population !legacy"),
    ("Non-commercial", "population by_group"), ("Non-commercial", "population by_range !by_group"), ("Policy", "population policy"), ("Individual contractor", "population individual"), ("Dormant", "population dormant"),
    ("Duplicate", "population grouped"), ("Possible duplicate", "population possible"), ("Validity", "population validity"), ("Completeness", "population completeness"), ("Consistency", "population consistency"),
    ("Stuck item", "population stuck"), ("Cross-House", "population cross_house"),
)


def mask(conditions: dict[str, Column]) -> Column:
    """The conditions that hold as bits; those not given, and null ones, don't hold."""
    return sum((F.when(c, F.lit(_BIT[name])).otherwise(F.lit(0)) for name, c in conditions.items()), F.lit(0)).cast("long")


def holds(m: Column, text: str, more: dict[str, Column] | None = None) -> Column:
    """True where all conditions of the text hold in the mask; `more`: conditions that aren't in it."""
    words, more = text.split(), more or {}
    must, not_ = sum(_BIT[w] for w in words if w in _BIT), sum(_BIT[w[1:]] for w in words if w[0] == "!")
    out = (m.bitwiseAND(F.lit(must | not_)) == must) if must | not_ else F.lit(True)
    for w in words:
        if w in more:
            out = out & more[w]
    return out


def classed(m: Column) -> Column:
    """struct(class, rule) by the first line of CLASSES that holds."""
    out = None
    for name, rule, text in CLASSES:
        said = F.struct(F.lit(name).alias("class"), F.lit(rule).alias("rule"))
        out = (F if out is None else out).when(holds(m, text), said)
    return out


def _those(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in pairs]), lambda x: x.isNotNull()))


def fired(m: Column, recommended_rule: Column) -> Column:
    """Rules that fired, sorted: those of FIRED, and the one behind the recommended class where it is about activity, groups or data."""
    own = F.when(holds(m, "population") & recommended_rule.rlike("^MS-(CLS|TRN)"), recommended_rule)
    return F.array_sort(F.array_distinct(F.array_compact(F.array_append(_those([(r, holds(m, t)) for r, t in FIRED]), own))))


def tags(m: Column, rule: Column) -> Column:
    """Tags joined by a comma; Active where there are none."""
    dormant = {"dormant": F.coalesce(rule.isin("MS-CLS-01", "MS-TRN-02"), F.lit(False))}
    own = F.array_join(_those([(tag, holds(m, text, dormant)) for tag, text in TAGS]), ", ")
    return F.when(own == "", "Active").otherwise(own)


def trail(m: Column, rules) -> Column:
    """array(struct(rule, result, text)): the steps to the class, in order; the last one decides.

    Reads statuses, category_detail, category_rule, last_activity, items,
    open_orders, dup_group, group_confirmed, blocking and rule of the row.
    """
    day = F.coalesce(F.date_format("last_activity", "d MMM yyyy"), F.lit("none"))
    count = lambda c, what: F.concat(F.col(c).cast("string"), F.lit(f" {what}"))
    opens = F.concat(count("items", "open items, "), count("open_orders", "open orders"))
    step = lambda when, rule, result, *text: F.when(when, F.struct((rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), F.lit(result).alias("result"), F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]).alias("text")))
    at = lambda text: holds(m, text)
    commercial = at("population !by_group !by_range !policy")
    dormant = commercial & at("!active !open")
    alive = commercial & ~at("!active !open")
    settled = alive & (at("!tie !grouped") | at("!tie preferred"))
    steps = [
        step(at("!population"), "MS-POP-01", "stop", "Outside the population: ", F.coalesce("statuses", F.lit("")), F.when(at("legacy"), F.lit(", a legacy record")).otherwise(F.lit(""))),
        step(at("population"), "MS-POP-01", "pass", "In the population: ", F.coalesce("statuses", F.lit(""))),
        step(at("population") & ~commercial, F.col("category_rule"), "stop", F.col("category"), ": ", F.coalesce("category_detail", F.lit("")), ". Held."),
        step(commercial, "MS-CAT-01", "pass", "Commercial", F.when(at("individual"), F.lit(", an individual")).otherwise(F.lit(""))),
        step(dormant, F.col("rule"), "fail", "No activity for ", F.lit(str(rules.dormant_months)), " months (last: ", day, ") and nothing open", F.when(at("left_out"), F.lit("; every item is left out by a steward")).otherwise(F.lit("")), ". Close."),
        step(alive & at("!active"), "MS-CLS-01", "pass", "No recent activity (last: ", day, ") but ", opens, "."),
        step(alive & at("active"), "MS-CLS-01", "pass", "Active, last: ", day, "; ", opens, "."),
        step(alive & at("tie"), "MS-DUP-03", "fail", "Level with another record of ", F.col("dup_group"), ". A steward has to choose; monitor."),
        step(alive & at("!tie grouped preferred"), "MS-DUP-03", "pass", "Preferred in ", F.col("dup_group"), F.when(F.col("group_confirmed"), F.lit(", confirmed by a steward.")).otherwise(F.lit(", by rule."))),
        step(alive & at("!tie grouped !preferred") & (at("recent") | at("open")), "MS-CLS-03", "fail", "Not preferred in ", F.col("dup_group"), " but still in use (last: ", day, "; ", opens, "). Monitor."),
        step(alive & at("!tie grouped !preferred !recent !open"), "MS-CLS-02", "fail", "Not preferred in ", F.col("dup_group"), " and not used for ", F.lit(str(rules.monitor_months)), " months. Close."),
        step(alive & at("!tie !grouped"), "MS-DUP-01", "pass", "In no group of duplicates."),
        step(settled & at("blocked"), "MS-CLS-04", "fail", count("blocking", "blocking issues. Fix.")),
        step(settled & at("!blocked"), "MS-CLS-05", "pass", "No blocking issue. Keep."),
    ]
    return F.filter(F.array(*steps), lambda x: x.isNotNull())
