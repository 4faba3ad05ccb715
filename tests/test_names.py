import random
from collections import defaultdict

import pytest

from finscope.matching import names, pairs


def words(rng):
    return "".join(rng.choice("abcdeorst") for _ in range(rng.randint(2, 7)))


def altered(rng, name):
    out = list(name)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and out:
            out.pop(min(at, len(out) - 1))
        else:
            out.insert(at, rng.choice("abcdeorst "))
    return "".join(out)


def tokens(name):
    return " ".join(sorted(w for w in name.split(" ") if w))


@pytest.mark.parametrize("threshold,fan", [(90, 2048), (90, 3), (80, 4), (70, 2048), (60, 5), (100, 2048)])
def test_near_names_are_all_found(spark, threshold, fan):
    rng = random.Random(threshold + fan)
    base = [" ".join(words(rng) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = [(rng.choice("xy"), altered(rng, rng.choice(base))) for _ in range(260)] + [("x", "0000000000 aaa"), ("x", "0000000001 aaa"), ("x", "00000000000 aaa"), ("x", ""), ("y", None), ("x", "a"), ("x", "ab")]
    df = spark.createDataFrame(rows, "house string, name string")
    got = {(r["house"], r["name_a"], r["name_b"]): r["score"] for r in names.near(df, ["house"], "name", threshold, fan).collect()}
    own, want = defaultdict(set), {}
    for h, n in rows:
        own[h].add(n)
    for h, held in own.items():
        held = sorted(n for n in held if n)
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                if pairs.indel_ratio(a, b) >= threshold:
                    want[h, a, b] = pairs.indel_ratio(a, b)
    assert got == want and (threshold == 100 or len(want) > 20)


def near_by_all_pairs(held, threshold):
    held = sorted(held)
    return {(a, b): pairs.indel_ratio(a, b) for i, a in enumerate(held) for b in held[i + 1 :] if pairs.indel_ratio(a, b) >= threshold}


@pytest.mark.parametrize("threshold", [60, 90])
def test_near_names_of_few_syllables_many_letters_and_great_length(spark, threshold):
    rng = random.Random(threshold)
    syllables = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki"]
    held = {"".join(rng.choice(syllables) for _ in range(6)) + rng.choice([" trading", " works"]) for _ in range(250)}
    held |= {"x" * n for n in (1, 2, 3, 29, 30, 63, 64, 65, 70, 120, 192, 193, 300)} | {"ab" * 40 + c * 5 for c in "abc"}
    held |= {"".join(chr(0x4E00 + rng.randrange(900)) for _ in range(20)) for _ in range(30)}
    held |= {altered(rng, n) for n in sorted(held) if len(n) > 10}
    df = spark.createDataFrame([(n,) for n in held], "name string").selectExpr("'x' AS house", "name")
    want = near_by_all_pairs(held, threshold)
    for fan in (7, 64, 2048):
        assert {(r["name_a"], r["name_b"]): r["score"] for r in names.near(df, ["house"], "name", threshold, fan).collect()} == want
    assert len(want) > 200


def test_lists_hold_no_more_pairs_than_their_blocks(spark):
    rng = random.Random(5)
    held = {"x": {"".join(rng.choice(["ba", "ce", "di", "fo"]) for _ in range(8)) for _ in range(400)}, "y": {f"{rng.randrange(10**12):012d}{chr(0x4E00 + i)}{chr(0x5E00 + i)}" for i in range(400)}, "z": {"aa", "ab", "ac"}}
    df = spark.createDataFrame([(h, n) for h, ns in held.items() for n in ns], "house string, name string")
    found = defaultdict(list)
    for r in names._lists(df, ["house"], 90, 2, 16).groupBy("house", "gram").count().collect():
        found[r["house"]].append((r["gram"], r["count"]))
    assert all(sum(n * n for _, n in lists) <= len(held[h]) ** 2 for h, lists in found.items())
    assert found["x"] == [("", len(held["x"]))] and found["z"] == [("", 3)] and len(found["y"]) > 100


def test_partners_match_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(words(rng) for _ in range(2)) for _ in range(12)]
    rows = [(f"e{i}", rng.choice("xy"), altered(rng, rng.choice(base)) if rng.random() < 0.6 else rng.choice(base), rng.choice([None, "g1", "g2"])) for i in range(150)]
    parted = [(f"e{rng.randrange(150)}", f"e{rng.randrange(150)}") for _ in range(400)]
    df = spark.createDataFrame(rows, "entity string, house string, name string, grp string")
    members = names.classes(df, "entity", "name", ["house"]).join(df.select("entity", "grp"), "entity")
    linked = names.links(members, ["house"], 85)
    got = {r["entity"]: r["partners"] for r in names.partners(members, linked, ["house"], spark.createDataFrame(parted, "a string, b string")).collect()}
    cut, want = {frozenset(p) for p in parted}, defaultdict(int)
    for i, (a, h, m, g) in enumerate(rows):
        for b, h2, m2, g2 in rows[i + 1 :]:
            if h == h2 and tokens(m) and tokens(m2) and pairs.indel_ratio(tokens(m), tokens(m2)) >= 85 and not (g and g == g2) and frozenset((a, b)) not in cut:
                want[a] += 1
                want[b] += 1
    assert got == dict(want) and len(want) > 60


def test_no_names(spark):
    df = spark.createDataFrame([], "house string, name string")
    assert names.near(df, ["house"], "name", 90).count() == 0
    with pytest.raises(ValueError):
        names.near(df, ["house"], "name", 20)
