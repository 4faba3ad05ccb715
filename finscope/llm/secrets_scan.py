"""Secret scan: three fixed patterns, and a battery of randomness tests on whatever else looks like a key.

A candidate is a run of at least `MIN_RUN` characters of the base64 alphabets.
Its encoding is the smallest alphabet that holds it. Against independent uniform
characters of that alphabet it is tested for uniformity (chi-squared), for runs
above and below the middle, and for serial correlation; Fisher's method makes
one p-value of the three. Keys keep it large, words and names bring it down.

How often nature reaches a p-value is learned from the corpus, for each encoding
and length band: every document gives strings of its own words, joined as names,
paths and identifiers are, of lengths by its hash. Where an encoding and band has
fewer than `LEAST_NATURE` of them, it takes those of its class of alphabets in
that band, else those of all encodings there, else those of all bands up to it
(shorter strings reach larger p-values, so that errs to the safe side); where
none of these has enough, and for runs of digits alone, of which words tell
nothing, no run is accepted. Of candidates, those inside the patterns' spans too,
different ones are counted once each, however often they are copied. In each
encoding and band the least cut-off is taken at which the expected share of
natural ones among the candidates above it is at most `fdr`; how many are natural
is told by how many have small p-values, and one more. Short runs of few kinds of
characters hence need much larger p-values than long ones, or are never accepted.
The counts cover the whole corpus and are as many as encodings, bands and bins.

A UUID is an identifier and no key: its hyphens make it fail the battery.

Defined cases: null text is empty and has no span; a very long text is read
whole; rows are judged one by one, so equal ids and repeated rows each get their
result; of spans that start together the kinds' order decides, and a run that
overlaps a pattern's span is not a span of its own; an empty table gives an empty
result; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finscope.llm.shared import appended, written

#: Fixed by the contract, in its order; letters of the words in either case (ASCII only).
_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token"))) + "|" + _EITHER("api") + "_?" + _EITHER("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
LONG_HEX = re.compile("[0-9a-f]{16,}")
HINTS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 16
RUN = re.compile("[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
PART = re.compile("[A-Za-z]+|[0-9]+")
#: How words make a natural string: what becomes of each, and what stands between; a # stands for a number.
STYLES = [(str.lower, ""), (str.capitalize, ""), (str.upper, ""), (str.lower, "-"), (str.lower, "_"), (str.upper, "_"), (str.lower, "/"), (str.lower, "#"), (str.capitalize, "#"), (str.upper, "#")]

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet on.
ENCODINGS = [
    ("decimal", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("hex_upper", DIGITS + "ABCDEF"),
    ("letters", LOWER),
    ("letters_upper", UPPER),
    ("base32", UPPER + "234567"),
    ("base32_lower", LOWER + "234567"),
    ("base36", DIGITS + LOWER),
    ("base36_upper", DIGITS + UPPER),
    ("base52", UPPER + LOWER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("any", UPPER + LOWER + DIGITS + "+/-_"),
]
_INDEX = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]
#: Cut-offs are sought among this many equal steps of the p-value.
BINS = 200
#: Least lengths of the length bands.
BANDS = (16, 20, 24, 32, 40, 64)
#: Natural strings that each document gives, and how many a null needs.
STRINGS, LEAST_NATURE = 4, 100
#: Classes of alphabets whose natural strings stand in for each other.
CLASSES = {
    "one case": ("hex", "hex_upper", "letters", "letters_upper", "base32", "base32_lower", "base36", "base36_upper"),
    "both cases": ("base52", "base62", "base64", "base64url", "any"),
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost first and not overlapping within a kind."""
    low = text.lower()
    out = []
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]  # runs are maximal, so long ones are the same matches
    return sorted(out)


def encoding(token: str) -> tuple[str, np.ndarray, int]:
    """(name, places in the alphabet, size of the alphabet)."""
    body = token.rstrip("=").replace("=", "") or token
    chars = set(body)
    for name, alphabet, index in _INDEX:
        if chars <= alphabet:
            return name, np.array([index[c] for c in body]), len(index)
    return "any", np.zeros(len(body), np.int64), 64


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(x: np.ndarray, k: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for places x in an alphabet of k."""
    n = len(x)
    count = np.bincount(x, minlength=k)
    chi = float(((count - n / k) ** 2).sum() * k / n)
    # Wilson and Hilferty's cube root, which holds for few characters, too.
    df = k - 1
    uniform = _upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, 2 * a * b * (2 * a * b - n) / (n * n * max(1, n - 1))))
        in_runs = 2 * _upper_tail(max(0.0, abs(runs - mean) - 0.5) / max(spread, 0.5))
    else:
        in_runs = 2 * 0.5**n
    d = x - x.mean()
    var = float((d * d).sum())
    serial = 2 * _upper_tail(abs(float((d[1:] * d[:-1]).sum()) / var * math.sqrt(n))) if var else 0.0
    return tuple(min(1.0, max(p, 1e-12)) for p in (uniform, in_runs, serial))


def combined(ps: tuple[float, ...]) -> float:
    """Fisher: the tail of chi-squared with 2 x 3 degrees of freedom."""
    half = -sum(map(math.log, ps))
    return min(1.0, math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps))))


def natural(text: str) -> list[str]:
    """Strings of words that follow one another in the text, each in a style, of a length and from a place by the text's hash; none where too few words follow."""
    found, raw = [], text.encode()
    for number in range(STRINGS if len(text) >= 2 * MIN_RUN else 0):
        at = crc32(raw, number)
        change, between = STYLES[at % len(STYLES)]
        low = BANDS[at // 16 % len(BANDS)]
        size = low + at // 128 % (low // 4)
        parts, have = [], 0
        for i, m in enumerate(PART.finditer(text, at % (len(text) // 2))):
            parts.append(change(m[0]))
            have += len(m[0])
            if have > size:
                break
            if between:
                parts.append(str(at % 97 + i) if between == "#" else between)
        own = "".join(parts)[:size]
        if len(own) == size:
            found.append(own)
    return found


def judged(token: str) -> tuple[str, float, int]:
    """(encoding, p-value, length band)."""
    name, x, k = encoding(token)
    return name, combined(battery(x, k)), sum(len(token) >= least for least in BANDS)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, runs, nature): pattern spans; candidates with a hash, encoding, p-value, length band and whether they are inside a pattern's span; encoding, p-value and band of the document's natural strings."""
    base_kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    told = [("encoding", pa.string()), ("p", pa.float64()), ("band", pa.int32())]
    run_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("key", pa.int64()), *told, ("under", pa.bool_())]))

    def start():
        def work(batch: pa.RecordBatch):
            bases, all_runs, nature = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                text = text or ""
                base = base_spans(text)
                runs = []
                for m in RUN.finditer(text):
                    a, b = m.span()
                    name, p, band = judged(m[0])
                    runs.append({"start": a, "end": b, "key": xxhash.xxh3_64_intdigest(m[0]) - (1 << 63), "encoding": name, "p": p, "band": band, "under": any(a < e and s < b for s, _, e in base)})
                bases.append([{"start": a, "kind": kind, "end": b} for a, kind, b in base])
                all_runs.append(runs)
                nature.append([dict(zip(("encoding", "p", "band"), judged(x))) for x in natural(text)])
            return [pa.array(bases, base_kind), pa.array(all_runs, run_kind), pa.array(nature, pa.list_(pa.struct(told)))]

        return work

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    told_sql = "encoding: string, p: double, band: int"
    return appended(rows, f"base array<struct<start: bigint, kind: int, end: bigint>>, runs array<struct<start: bigint, end: bigint, key: bigint, {told_sql}, under: boolean>>, nature array<struct<{told_sql}>>", start).drop("text")


def cutoff(candidates: np.ndarray, nature: np.ndarray, fdr: float, low: int = BINS // 20) -> int | None:
    """The least bin from which on at most `fdr` of the candidates are expected to be natural, given counts by bin of both; None if there is none."""
    above = lambda x: x[::-1].cumsum()[::-1]
    n = candidates.sum()
    # One natural string more than seen may reach every bin, and one candidate more may be natural; keys are in the low bins as often as in any others.
    share = (1 + above(nature)) / (1 + nature.sum())
    small = (nature[:low].sum() + 1) / (nature.sum() + 1)
    many = min(n, (candidates[:low].sum() + 1) / small)
    kept = above(candidates)
    good = (many * share <= fdr * kept) & (kept > 0)
    return int(np.argmax(good)) if good.any() else None


def null_of(cell: tuple[str, int], nature: dict[tuple[str, int], np.ndarray]) -> np.ndarray | None:
    """Counts by bin of the natural strings that a cell (encoding, band) is held against: its own, else those of its neighbours; None if there are too few."""
    name, band = cell
    kin = next((names for names in CLASSES.values() if name in names), ())
    every = [x for names in CLASSES.values() for x in names] if kin else []
    for names, bands in (([name], [band]), (kin, [band]), (every, [band]), (every, range(band + 1))):
        pool = sum((nature[n, b] for n in names for b in bands if (n, b) in nature), np.zeros(BINS))
        if pool.sum() >= LEAST_NATURE:
            return pool
    return None


def cutoffs(scans: DataFrame, fdr: float = 0.05) -> dict[tuple[str, int], int]:
    """Least bin of p-values accepted for each encoding and length band; those in which none will do are left out."""
    at = lambda p: F.least(F.floor(p * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    seen = scans.select(F.explode("runs").alias("x")).select("x.key", "x.encoding", "x.band", at(F.col("x.p"))).distinct().withColumn("seen", F.lit(True)).drop("key")
    own = scans.select(F.explode("nature").alias("x")).select("x.encoding", "x.band", at(F.col("x.p")), F.lit(False).alias("seen"))
    counts: dict = {True: {}, False: {}}
    for r in seen.unionByName(own).groupBy("seen", "encoding", "band", "bin").agg(F.count("*").alias("n")).collect():
        counts[r["seen"]].setdefault((r["encoding"], r["band"]), np.zeros(BINS))[r["bin"]] = r["n"]
    found = {}
    for cell, candidates in sorted(counts[True].items()):
        nature = null_of(cell, counts[False])
        least = None if nature is None else cutoff(candidates, nature, fdr)
        if least is not None:
            found[cell] = least
    return found


def spans(docs: DataFrame, fdr: float = 0.05, **columns) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) in code points, by start and then kind; `spans` also has the random ones."""
    scans = written(scanned(docs, **columns), "secret-scans")
    cells = cutoffs(scans, fdr)
    names = F.array(*map(F.lit, KINDS))
    named = lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"))

    def random_ones(r: Column) -> Column:
        ok = F.lit(False)
        for (name, band), least in cells.items():
            ok = ok | ((r["encoding"] == name) & (r["band"] == band) & (F.least(F.floor(r["p"] * BINS), F.lit(BINS - 1)) >= least))
        return ~r["under"] & ok

    added = F.transform(F.filter("runs", random_ones), lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    both = F.sort_array(F.concat("base", added))
    return scans.select("doc_id", F.transform("base", named).alias("base"), F.transform(both, named).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
