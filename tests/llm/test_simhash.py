import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from finscope.llm import simhash


def brute_fingerprint(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    sh = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, k):
    ids, fps = [r[0] for r in rows], [r[1] for r in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= k:
                parent[top(i)] = top(j)
    least = {}
    for i in range(len(rows)):
        t = top(i)
        least[t] = min([x for x in (least.get(t), ids[i]) if x is not None], default=None)
    return sorted(((ids[i], fps[i], least[top(i)]) for i in range(len(rows))), key=str)


def test_fingerprint(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "a b c d", "ÉCLAIR éclair Straße"] + [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t, 3) for t in texts] == want
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert [simhash.fingerprint(t, 3) for t in texts] == want


def cloud(rng, centres, each, flips):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    for k, bucket in ((3, 2048), (3, 8), (8, 2048), (5, 4)):
        fps = cloud(rng, 25, 12, 5) + [0, 0, -1, 1]
        rows = [(i if i % 17 else None, fp) for i, fp in enumerate(fps)]
        df = spark.createDataFrame(rows, "doc_id long, fp long")
        got = sorted((tuple(r) for r in simhash.components(df, k, bucket).collect()), key=str)
        assert got == brute_components(rows, k), (k, bucket)


def test_every_plan_finds_every_link(spark):
    rng = random.Random(3)
    fps = sorted(set(cloud(rng, 20, 10, 4)))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    n, both = simhash.bit_counts(nodes)
    assert n == len(fps)
    want = brute_components([(i, f) for i, f in enumerate(fps)], 3)
    for m in (1, 2, 3, 4, 5):
        parts = simhash.correlated_parts(n, both, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        t, _ = simhash.allocate(n, both, parts, 3)
        assert sum(t) >= 3 - m + 1 and min(t) >= -1
        from finscope.matching.components import connected_components

        roots = {r["node"]: r["root"] for r in connected_components(simhash.links(nodes, 3, chosen=simhash.Plan(parts, t, 0.0))).collect()} if m > 1 else None
        if roots is not None:
            groups = {}
            for i, f, c in want:
                groups.setdefault(c, set()).add(roots.get(f, f))
            assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y")], "doc_id long, text string, fp string")
    out = simhash.components(simhash.fingerprints(df))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {1: 1, 2: 2}
    assert simhash.components(simhash.fingerprints(df.where(F.lit(False)))).count() == 0


def jaccard(a, b, width=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(150)] for _ in range(12)]
    rows, group = [], {}
    for g, base in enumerate(bases):
        for c in range(6):
            w = list(base)
            if c > 1:
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w).upper() if c == 1 else " ".join(w), f"s{g}"))
            group[rows[-1][0]] = g
    far = list(bases[0])
    for i in range(0, 150, 6):
        far[i] = word()
    rows.append((len(rows), " ".join(far), "far"))
    rows += [(1000, None, "a"), (1001, "", "b"), (None, "alone here", "c"), (None, "alone here", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    out = simhash.deduped(df)
    assert out.columns == df.columns
    got = out.collect()
    ids = [r["doc_id"] for r in got]
    assert len(far) and 72 in ids and ids.count(None) == 1 and 1000 in ids and 1001 not in ids
    left = [i for i in ids if i is not None and i < 72]
    assert {group[i] for i in left} == set(range(12)) and all(i % 6 == 0 for i in left[:0]) and len(left) == 12
    assert simhash.deduped(df.where("doc_id < 0")).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    while len(rows) < 240:
        base = [word() for _ in range(200)]
        other = list(base)
        for place in rng.sample(range(5, 195), 4):
            other[place] = word()
        if 0.8 <= jaccard(" ".join(base), " ".join(other)) < 0.84:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    left = {r["doc_id"] for r in simhash.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i in left for i in range(0, 240, 2))
    assert sum(i not in left for i in range(1, 240, 2)) >= 0.93 * 120


def test_pairs_of_a_family_are_verified_before_they_are_thinned(spark):
    # u and v are similar; candidates connect them only through w, which is similar to neither.
    u, w = set(range(100)), set(range(60)) | set(range(200, 240))
    v = set(range(5, 105))
    sets = spark.createDataFrame([(bytes([i]) * 16, [int(x) for x in s]) for i, s in enumerate((u, w, v))], "content binary, shingles array<bigint>")
    near = spark.createDataFrame([(bytes([0]) * 16, bytes([1]) * 16), (bytes([1]) * 16, bytes([2]) * 16)], "u binary, v binary")
    for block in (1 << 20, 100):
        got = {frozenset((r["u"][0], r["v"][0])) for r in simhash.verified(near, sets, 0.8, block).collect()}
        assert got == {frozenset((0, 2))}, block


def test_near_copies_of_large_buckets_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for _ in range(14):
            w = list(base)
            w[rng.randrange(150)] = word()
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (2048, 4):
        assert sorted(r["doc_id"] for r in simhash.deduped(df, bucket=bucket).collect()) == [0, 14, 28], bucket


def test_every_pair_of_a_large_bucket_meets_once_or_more(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(simhash.WORDS)]
    rows = [(part, value, *(rng.getrandbits(63) for _ in words)) for part, value, n in ((0, 5, 23), (0, 6, 4), (1, 5, 5)) for _ in range(n)]
    out = simhash.dealt(spark.createDataFrame(rows, "part int, value long, " + ", ".join(f"{w} long" for w in words)), words, 4).collect()
    met, cells = set(), {}
    for r in out:
        cells.setdefault((r["part"], r["value"], r["cell"]), []).append(tuple(r[w] for w in words))
    for (part, value, _), own in cells.items():
        met |= {(part, value, frozenset((a, b))) for a in own for b in own if a != b}
    assert met == {(a[0], a[1], frozenset((a[2:], b[2:]))) for a in rows for b in rows if a != b and a[:2] == b[:2]}
    assert {k[:2] for k in cells if k[2]} == {(0, 5), (1, 5)}


def test_stars_connect_what_a_forest_does():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, n // 2))
        label = list(range(n))
        for i, j in zip(a, b):
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        first, other = simhash.stars(a, b, n)
        assert dict(zip(other.tolist(), first.tolist())) == {i: x for i, x in enumerate(label) if i != x}


def test_similar_pairs_connect_what_all_pairs_do():
    rng = random.Random(8)
    for blocks in (1, 2):
        base = [rng.sample(range(400), 60) for _ in range(6)]
        sets = [np.array(sorted({x if rng.random() > 0.06 else rng.randrange(400, 9000) for x in base[rng.randrange(6)]})) for _ in range(80)] + [np.zeros(0, np.int64)]
        block = np.array([rng.randrange(blocks) for _ in sets])
        ok = lambda i, j: len(sets[i]) and (blocks == 1 or block[i] != block[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
        groups = []
        for pairs in ([(i, j) for i in range(81) for j in range(i + 1, 81) if ok(i, j)], simhash.similar_pairs(block, sets, 0.8)):
            assert all(ok(i, j) for i, j in pairs)
            label = list(range(81))
            for i, j in pairs:
                label = [label[i] if x == label[j] else x for x in label]
            groups.append({frozenset(k for k in range(81) if label[k] == x) for x in label})
        assert groups[0] == groups[1]
