import math
import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from finscope.llm import merkle_manifest, periodic_runs, queries, source_mix

# Periodic runs


def brute_runs(words, repeats=4, least=6):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(least, repeats * q) and not any(all(own[k] == own[k + p] for k in range(len(own) - p)) for p in range(1, q)):
                out.append((i, len(own), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    out = []
    while len(out) < n:
        if rng.random() < 0.3:
            out += [rng.choice("abc") for _ in range(rng.randint(1, 5))] * rng.randint(1, 9)
        else:
            out.append(rng.choice("abcdefg"))
    return out[:n]


@pytest.mark.parametrize("repeats,least", [(4, 6), (3, 6), (3, 1), (5, 12)])
def test_runs_match_brute_force(repeats, least):
    rng, seen = random.Random(repeats * 100 + least), 0
    for _ in range(600):
        words = repetitive(rng, rng.randint(0, 70))
        want = brute_runs(words, repeats, least)
        assert periodic_runs.runs_of(periodic_runs.numbered(words), repeats, least) == want
        seen += len(want)
    assert seen > 300


def test_runs_of_hard_texts():
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    for words in (list(fib[-1]), ["x"] * 3000, list("ab" * 900 + "c" + "ab" * 900), list("abcabcabcabcabc" * 3 + "q" + "abc" * 4)):
        assert periodic_runs.runs_of(periodic_runs.numbered(words), 4, 6) == brute_runs(words)
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.array([1, 1]), 2)


def test_access_colours_the_last_occurrences():
    rng = random.Random(5)
    words = [rng.choice("ab") for _ in range(60)]
    automaton = periodic_runs.SuffixAutomaton(words)
    tree = periodic_runs.LinkCutTree(automaton.link)
    for i, state in enumerate(automaton.ends):
        got = {before: automaton.length[x] for before, x in tree.access(state, i + 1) if before and automaton.length[x]}
        want = {}
        for size in range(1, i + 1):  # the last end before i of every suffix of the first i + 1 words
            ends = [j for j in range(size - 1, i) if words[j - size + 1 : j + 1] == words[i - size + 1 : i + 1]]
            if ends:
                want[ends[-1] + 1] = max(size, want.get(ends[-1] + 1, 0))
        assert got == want, (i, got, want)


def test_runs_of_documents(spark):
    long = " ".join(f"w{i}" for i in range(40_000)) + " go on" * 30_000
    texts = [None, "", " \n\t", "a a a a a", "a a a a a a", "x\ty\nx y x y\x0bx y z", "é é é é é é é", long, long]
    df = spark.createDataFrame([(i % 7 if i else None, t, "mine", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n_words int")
    out = periodic_runs.found(df)
    assert sorted(out.columns) == ["collapsed", "doc_id", "n_words", "runs", "text"] and periodic_runs.found(df.limit(0)).count() == 0
    got = [(r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()]
    tail = (100_000, [(40_000, 60_000, 2)], " ".join(f"w{i}" for i in range(40_000)) + " go on")
    want = [(0, [], "")] * 3 + [(5, [], "a a a a a"), (6, [(0, 6, 1)], "a"), (9, [(0, 8, 2)], "x y z"), (7, [(0, 7, 1)], "é"), tail, tail]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_made_periodic_as_the_contract_says(spark):
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 50))) for i in range(300)] + [(None, "a b"), (400, None)]
    got = {r["doc_id"]: r["text"] for r in queries.made_periodic(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    made = 0
    for i, text in rows:
        h = 1 if i is None else zlib.crc32(str(i).encode())
        words = (text or "").split()
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text, made = " ".join(w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)), made + 1
        assert got[i] == text
    assert made > 10


# Mixing


def plain_seats(votes, seats, limits):
    given = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i, v in enumerate(votes) if v > 0 and given[i] < limits[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


def test_seats_go_to_the_highest_quotients():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        votes = [rng.choice([0, rng.randint(1, 20), rng.randint(1, 2000), rng.random() * 50]) for _ in range(n)]
        limits = [rng.choice([0, 3, 40, 1000]) for _ in range(n)]
        seats = rng.randint(0, 200)
        assert source_mix.apportioned(np.array(votes, float), seats, np.array(limits)).tolist() == plain_seats(votes, seats, limits)
    assert source_mix.apportioned(np.array([1e12, 1.0]), 10**11, np.array([10**12, 5])).sum() == 10**11


def test_targets_hold_the_limit():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.choice([0, 1, rng.randint(1, 100), rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 9))]
        weights = [source_mix.WEIGHTS[i % 3] for i in range(len(sizes))]
        got = source_mix.targets(sizes, weights, 1.5, 2)
        assert sum(got) == Fraction(3, 2) * sum(sizes) and all(t <= 2 * n for t, n in zip(got, sizes))
        free = {t / w for t, n, w in zip(got, sizes, weights) if t < 2 * n}
        assert len(free) <= 1 and all(Fraction(2 * n, w) <= max(free, default=Fraction(10**9)) for t, n, w in zip(got, sizes, weights) if t == 2 * n)


def corpus():
    rng = random.Random(11)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", "d", "é", None])) for i in range(900)]
    return rows + [(900, None, "a"), (None, "x y", "b"), (None, "x y", "b"), (7, "z " * 30, "zz"), (901, "", "empty"), (902, "long " * 40_000, "d")]


def test_mix_comes_near_its_targets(spark):
    df = spark.createDataFrame([(*r, 5) for r in corpus()], "doc_id long, text string, source string, size int")
    for options in ({}, {"shard_words": 2000, "fan": 3, "block": 16}):
        out = source_mix.mixed(df, **options)
        rows = out.collect()
        assert len(rows) == len(corpus()) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r["source"], []).append(r)
        for source, own in by.items():
            target, size, taken = own[0]["target"], sum(r["size"] for r in own), sum(r["taken"] for r in own)
            assert {r["source_size"] for r in own} == {size} and {r["target"] for r in own} == {target}
            assert abs(taken - target) <= max(3, 0.02 * target), (source, taken, target)
        assert math.isclose(sum(own[0]["target"] for own in by.values()), 1.5 * sum(r["size"] for r in rows))
        again = source_mix.mixed(df.repartition(7), **options).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, rows))
        assert len({r["taken"] / r["size"] for r in rows if r["size"] and r["target"] < 2 * r["source_size"]}) > 2
    other = source_mix.mixed(df, seed=1).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, source_mix.mixed(df).collect()))


def test_mix_of_little_or_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert source_mix.mixed(spark.createDataFrame([], schema)).count() == 0
    empty = source_mix.mixed(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2
    one = source_mix.mixed(spark.createDataFrame([(1, "a b c", "s")], schema)).collect()[0]
    assert one["target"] == 4.5 and one["taken"] in (4, 5)


# Manifest


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hashed(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute_way(levels, at):
    way = []
    for level in levels[:-1]:
        first = at // 3 * 3
        way.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return way


def brute_manifest(rows, changed):
    """rows: (doc_id, source, lang, n_chars, text); changed(text, id) -> text. By leaf: all that the manifest says."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: brute_levels([brute_leaf(r) for r in sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))]) for s in order}
    top = brute_levels([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))):
            way = brute_way(levels[s], i) + brute_way(top, k)
            value = brute_leaf((*r[:4], changed(r[4], r[0])))
            for before, after in way:
                value = hashed(*before, value, *after)
            out.append((r[0], r[1], brute_leaf(r), levels[s][-1][0], top[-1][0], hashed(*(x for b, a in way for x in b + a)), value, value == top[-1][0]))
    return out


def manifest_rows(n):
    rng = random.Random(n)
    sources = [None, "", "a", "b", "é", "z\U0001f600", *(f"s{i}" for i in range(20))]
    rows = [(i * 7 % 1009, "hot" if i % 3 == 0 else rng.choice(sources), rng.choice(["de", None]), rng.choice([None, i]), rng.choice([None, "", "one line", f"two\nlines {i}", "é\n\n"])) for i in range(n)]
    return rows + rows[:3] + [(None, "a", None, None, "x\ny"), (5, "only", "de", 1, "a\nb")]


@pytest.mark.parametrize("n", [0, 1, 40, 2600])
def test_manifest_matches_brute_force(spark, n):
    rows = manifest_rows(n) if n > 1 else [(3, None, None, None, "a\nb")][:n]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    cut = lambda text, i: text.replace("\n", "") if text and i is not None and i % 2 == 0 else text
    changed = {"text": F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    out = merkle_manifest.manifest(df, changed, proofs=True)
    got = out.collect()
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(brute_manifest(rows, cut), key=repr)
    assert all(merkle_manifest.folded(r["leaf"], [(s["before"], s["after"]) for s in r["proof"]]) == r["root"] for r in got)
    if n > 40:
        assert {r["verified"] for r in got} == {True, False} and len({r["subroot"] for r in got}) > 20


def test_a_parent_resumes_the_state_before_a_child():
    parent = merkle_manifest.Parent(["a" * 64, "b" * 64, "c" * 64])
    assert parent.digest == hashed("a" * 64, "b" * 64, "c" * 64)
    assert parent.replaced(1, "x" * 64) == hashed("a" * 64, "x" * 64, "c" * 64) and parent.replaced(1, "b" * 64) == parent.digest


def test_manifest_without_changes_verifies(spark):
    df = spark.createDataFrame(manifest_rows(60), "doc_id string, source string, lang string, n_chars long, text string")
    assert {r["verified"] for r in merkle_manifest.manifest(df).collect()} == {True}
