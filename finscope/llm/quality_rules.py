"""Quality rules as a short-circuit cascade, in native expressions only.

Each rule reads some features of a text and fails the document or not. On a
sample, every rule's rejections and its work (characters read and sorted, counted
and not timed, so that it is the same each time) are found in one aggregation.
Rules are then put in order one by one: next is the one that rejects most, of
what those before it leave, for its work. A document that one rule rejects is not
shown to the next (a CASE chain, whose features are computed only when it comes
to them). The order changes the work done and the name of the rule that rejected
first, never the verdict.

Defined cases: null or blank text has no words (every count 0) and fails the
word minimum; a very long text is read whole, like any other; repeated rows and
equal ids are judged row by row; rules that are equally good keep the order in
which they are listed; other columns are passed through by `with_verdict`, whose
new columns replace equally named ones, and dropped by `report`; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finscope.llm.shared import SPACE, words_of

#: A character of a word, and the limit of a long one.
INNER, LONG = r"[^\x20\x09-\x0D]", 1000


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once for the row."""
    return F.transform(F.array(value), use)[0]


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column, words: Column | None = None) -> Column:
    return F.size(words_of(text) if words is None else words).cast("long")


def without(text: Column, pattern: str) -> Column:
    """Characters of a text that a pattern leaves. (A regular expression goes through a text many times faster than `translate`.)"""
    return F.length(F.regexp_replace(_text(text), pattern, ""))


def word_chars(text: Column) -> Column:
    return without(text, SPACE).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(_text(text)) - without(text, "[#*$%&|<>]+")).cast("long")


def n_lines(text: Column, lines: Column | None = None) -> Column:
    """Lines with a word."""
    return F.size(_lines(text) if lines is None else lines).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(_text(text), "\n"), lambda x: x.rlike(INNER))


def n_dup_lines(text: Column, lines: Column | None = None) -> Column:
    """Lines with a word that equal an earlier line."""
    return _bound(_lines(text) if lines is None else lines, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(text: Column, words: Column | None = None, width: int = 3) -> Column:
    """Words inside a window of `width` words that the text holds twice or more.

    Sorted hashes of all windows tell which may be repeated. Only those are then
    sorted with their positions, so that equal ones stand together, and compared
    word by word; the positions of those with an equal neighbour are sorted and
    their cover added up.
    """

    def hashes(words: Column) -> Column:
        starts = F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))

    def twice(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda h, i: h == F.get(ordered, i + 1)))

    def likely(x: Column) -> Column:
        """Hash and position of the windows that may be repeated: all of them where there are many, as looking them up would take longer."""
        paired = F.transform(x["h"], lambda h, i: F.when((F.size(x["twice"]) > 64) | F.array_contains(x["twice"], h), F.struct(h.alias("h"), i.alias("p"))))
        return F.sort_array(F.filter(paired, lambda w: w.isNotNull()))

    def repeated(x: Column) -> Column:
        words, ordered = x["words"], x["ordered"]

        def equal(a: Column, b: Column) -> Column:
            same = a["h"] == b["h"]
            for k in range(width):
                same = same & (F.get(words, a["p"] + k) == F.get(words, b["p"] + k))
            return F.coalesce(same, F.lit(False))

        return F.transform(F.filter(ordered, lambda w, i: equal(w, F.get(ordered, i - 1)) | equal(w, F.get(ordered, i + 1))), lambda w: w["p"])

    def cover(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(width), F.get(starts, i + 1) - p), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def counted(words: Column) -> Column:
        hashed = _bound(hashes(words), lambda h: F.struct(h.alias("h"), _bound(F.sort_array(h), twice).alias("twice")))
        places = lambda x: _bound(F.struct(words.alias("words"), likely(x).alias("ordered")), repeated)
        return _bound(hashed, lambda x: F.when(F.size(x["twice"]) == 0, 0).otherwise(_bound(F.sort_array(places(x)), cover)))

    return _bound(words_of(text) if words is None else words, counted).cast("long")


def n_letterless(text: Column) -> Column:
    """Words without a letter."""
    return F.regexp_count(_text(text), F.lit(rf"(?<!{INNER})[^\x20\x09-\x0D\p{{L}}]++(?!{INNER})")).cast("long")


def n_long_words(text: Column) -> Column:
    """Words of more than LONG characters."""
    return F.regexp_count(_text(text), F.lit(f"(?<!{INNER}){INNER}{{{LONG + 1}}}")).cast("long")


def n_digits(text: Column) -> Column:
    return (F.length(_text(text)) - without(text, "[0-9]+")).cast("long")


def n_braces(text: Column) -> Column:
    return (F.length(_text(text)) - without(text, "[{}]+")).cast("long")


def n_upper(text: Column) -> Column:
    """Letters in upper case."""
    return (F.length(_text(text)) - without(text, r"\p{Lu}+")).cast("long")


def n_bullet_lines(text: Column, lines: Column | None = None) -> Column:
    return F.size(F.filter(_lines(text) if lines is None else lines, lambda x: x.rlike(r"^[ \t]*[-*\u2022\u2023]"))).cast("long")


def n_open_lines(text: Column, lines: Column | None = None) -> Column:
    """Lines that end with an ellipsis."""
    return F.size(F.filter(_lines(text) if lines is None else lines, lambda x: x.rlike(r"(\.\.\.|\u2026)[ \t\r]*$"))).cast("long")


FEATURES = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letterless, n_long_words, n_digits, n_braces, n_upper, n_bullet_lines, n_open_lines)}
#: Nanoseconds a character that each feature takes, as `calibrated` measured them once on one core; where a feature sorts, that is times the logarithm of what it sorts.
NANOS = {"n_words": 42, "word_chars": 39, "n_symbols": 21, "n_lines": 3, "n_dup_lines": 4, "n_repeat_words": 82, "n_letterless": 36, "n_long_words": 36, "n_digits": 20, "n_braces": 14, "n_upper": 11, "n_bullet_lines": 6, "n_open_lines": 26}
SORTED = {"n_repeat_words"}
#: Features that a report shows of every document.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Hashes are counted modulo this where a share of the rows is picked.
SPAN = 1 << 62


def calibrated(spark, rows: int = 4000) -> dict[str, float]:
    """Nanoseconds a character of each feature over copies of a fixed text, least of four runs; for NANOS, on one core and an idle machine."""
    line = "The quick brown fox{}, aged 12, jumps over {{one}} lazy dog near the River Thames and sleeps ..."
    text = "\n".join(line.format(i % 37) for i in range(40))
    df = spark.range(rows).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).repartition(1).persist()

    def seconds(c: Column) -> float:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            df.agg(F.sum(c)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    least = seconds(F.length("text"))
    out = {name: (seconds(f(F.col("text"))) - least) / rows / len(text) * 1e9 / (math.log2(len(text.split()) + 2) if name in SORTED else 1) for name, f in FEATURES.items()}
    df.unpersist()
    return out


@dataclass(frozen=True)
class Rule:
    """fails: from the named features to a Boolean column, true where the document is rejected."""

    name: str
    needs: tuple[str, ...]
    fails: object
    base: bool = False


def default_rules(min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 10, max_dup_line_pct: int = 50, word_len: tuple[int, int] = (2, 20), max_letterless_pct: int = 40, max_digit_pct: int = 40, max_brace_pct: int = 5, max_upper_pct: int = 60, max_bullet_pct: int = 90, max_open_pct: int = 50) -> list[Rule]:
    """The two base rules and ten more; a share counts only above its limit, in per cent."""
    low, high = word_len
    over = lambda part, whole, pct: lambda f: 100 * f[part] > pct * f[whole]
    return [
        Rule("few_words", ("n_words",), lambda f: f["n_words"] < min_words, True),
        Rule("repeated_words", ("n_words", "n_repeat_words"), over("n_repeat_words", "n_words", max_repeat_pct), True),
        Rule("symbols", ("n_symbols", "word_chars"), over("n_symbols", "word_chars", max_symbol_pct)),
        Rule("repeated_lines", ("n_lines", "n_dup_lines"), over("n_dup_lines", "n_lines", max_dup_line_pct)),
        Rule("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] < low * f["n_words"]) | (f["word_chars"] > high * f["n_words"])),
        Rule("letterless_words", ("n_letterless", "n_words"), over("n_letterless", "n_words", max_letterless_pct)),
        Rule("long_word", ("n_long_words",), lambda f: f["n_long_words"] > 0),
        Rule("digits", ("n_digits", "word_chars"), over("n_digits", "word_chars", max_digit_pct)),
        Rule("braces", ("n_braces", "word_chars"), over("n_braces", "word_chars", max_brace_pct)),
        Rule("upper_case", ("n_upper", "word_chars"), over("n_upper", "word_chars", max_upper_pct)),
        Rule("bullets", ("n_bullet_lines", "n_lines"), over("n_bullet_lines", "n_lines", max_bullet_pct)),
        Rule("open_lines", ("n_open_lines", "n_lines"), over("n_open_lines", "n_lines", max_open_pct)),
    ]


def measured(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, text_col: str = "text", free: tuple[str, ...] = (), id_col: str = "doc_id") -> list[dict]:
    """The rules in the order of the cascade, each with its gain: the rows it rejects, of those left, for the time they take it (`NANOS` x the characters of the sample's texts).

    The sample is about `sample_rows` rows, picked by a hash of id and text, so
    of a text with many copies it has its share; rows that share both are in or
    out together. It serves the order only. Features that are `free` cost nothing
    here, as they are computed anyhow.
    """
    total = docs.count()
    ids = [F.col(id_col).cast("string")] if id_col in docs.columns else []
    sample = docs.select(F.col(text_col).alias("text"), F.xxhash64(*ids, F.coalesce(text_col, F.lit(""))).alias("_pick"))
    sample = sample.where(F.pmod("_pick", F.lit(SPAN)) < int(SPAN * min(1.0, sample_rows / max(total, 1))))
    features = sample.select(F.length(_text(F.col("text"))).alias("_chars"), *[FEATURES[name](F.col("text")).alias(name) for name in sorted({n for r in rules for n in (*r.needs, "n_words")})])
    own = {name: F.col(name) for name in features.columns}
    work = lambda rule: sum((NANOS[n] * F.col("_chars") * (F.log2(F.col("n_words") + 2) if n in SORTED else 1) for n in rule.needs if n not in free), F.lit(1.0))
    mask = sum((F.when(rule.fails(own), 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))
    # At most one row for each set of rules that fail together.
    seen = features.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"), *[F.sum(work(rule)).alias(f"_{i}") for i, rule in enumerate(rules)]).collect()
    out, left = [], list(range(len(rules)))
    while left:
        best = None
        for i in left:
            bad = sum(r["n"] for r in seen if r["mask"] >> i & 1)
            gain = bad / max(1.0, sum(r[f"_{i}"] for r in seen))
            if best is None or gain > best[1]:
                best = (i, gain)
        i, gain = best
        out.append({"rule": rules[i], "gain": gain})
        left.remove(i)
        seen = [r for r in seen if not r["mask"] >> i & 1] if gain else seen
    return out


def cascade(rules: list[Rule], features: dict[str, Column]) -> Column:
    """Name of the first rule, in the order given, that rejects; null if none does. Later rules aren't evaluated."""
    chain = None
    for rule in rules:
        fails = F.coalesce(rule.fails(features), F.lit(False))
        chain = F.when(fails, rule.name) if chain is None else chain.when(fails, rule.name)
    return chain if chain is not None else F.lit(None).cast("string")


def with_verdict(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000, text_col: str = "text") -> DataFrame:
    """docs with `rejected_by` (string, null if none) and `kept`; features are computed only as far as the cascade needs them."""
    rules = [x["rule"] for x in measured(docs, rules or default_rules(), sample_rows, text_col)]
    features = {name: f(F.col(text_col)) for name, f in FEATURES.items()}
    return docs.withColumn("rejected_by", cascade(rules, features)).withColumn("kept", F.col("rejected_by").isNull())


def report(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features `SHOWN` of every document, whether a base rule fails, and the cascade's verdict; its other features are computed only as far as it comes."""
    rules = rules or default_rules()
    ordered = [x["rule"] for x in measured(docs, rules, sample_rows, text_col, free=SHOWN, id_col=id_col)]
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), words_of(F.col(text_col)).alias("_words"), _lines(F.col(text_col)).alias("_lines"))
    parts = {name: {"words": F.col("_words")} for name in ("n_words", "n_repeat_words")} | {name: {"lines": F.col("_lines")} for name in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_open_lines")}
    own = {name: f(F.col("_text"), **parts.get(name, {})) for name, f in FEATURES.items()}
    counted = split.select("doc_id", "_text", "_lines", *[own[name].alias(name) for name in SHOWN])
    features = {name: F.col(name) if name in SHOWN else own[name] for name in FEATURES}
    base = F.lit(False)
    for rule in rules:
        base = base | (rule.fails(features) if rule.base else F.lit(False))
    return counted.withColumns({"base_failed": base, "rejected_by": cascade(ordered, features)}).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("_text", "_lines")
