import random
from collections import defaultdict

import numpy as np
import pytest

from finscope.llm import anchors, repeats, substring_dedup, suffix_dedup


def brute_words(rows, length):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - length + 1):
            key, who = tuple(w[i : i + length]), repeats.LAST if d is None else d
            first[key] = min(first.get(key, who), who)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (repeats.LAST if d is None else d):
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def brute_bytes(rows, length):
    seen = defaultdict(int)
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def corpus(rng, n=60):
    pool = [" ".join(rng.choice("the of and to in a is it on as at by".split()) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.randint(0, 6)
        text = " ".join(rng.choice("alpha beta gamma delta eps é ñandú 日本 x".split()) for _ in range(rng.randint(0, 60)))
        if kind < 3:
            text += rng.choice([" ", "\n", "  \t"]) + rng.choice(pool)
        if kind == 3:
            text = rng.choice(pool) + " " + rng.choice(pool)[: rng.randint(5, 80)] + text
        if kind == 4:
            text = "ab " * rng.randint(0, 80)
        if kind == 5 and rows:
            old = (rng.choice(rows)[1] or "").split(" ")
            if len(old) > 3:
                old[rng.randrange(len(old))] = "EDIT"
            text = " ".join(old)
        if kind == 6:
            text = rng.choice([None, "", " ", "one"])
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("group,length", [(4096, 13), (2, 5), (3, 13)])
def test_words_match_brute_force(spark, group, length):
    rng = random.Random(group * length)
    rows = corpus(rng) + [(3, "repeated id " * 8), (3, "repeated id " * 8), (None, "the of " * 20), (None, "the of " * 20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    out = substring_dedup.deduped(df, length, group)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str)
    assert got == brute_words(rows, length)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out.collect())


def test_very_long_words_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PORTION", 512)
    long = " ".join("w" * 100 + str(i) for i in range(40))
    rows = [(1, long + " end"), (2, "start " + long), (3, "x" * 5000)]
    names = "doc_id long, text string, who string, text_key string, anchor string, found string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], names)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.deduped(df, 5).collect()), key=str)
    assert got == brute_words(rows, 5)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup.deduped(df, 300).collect()), key=str)
    assert got == brute_bytes(rows, 300)


@pytest.mark.parametrize("group,length", [(4096, 60), (2, 20), (3, 33)])
def test_bytes_match_brute_force(spark, group, length):
    rng = random.Random(group + length)
    rows = corpus(rng) + [(3, "repeated id " * 8), (3, "repeated id " * 8), (None, "a" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.deduped(df, length, group)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in out.collect()), key=str)
    assert got == brute_bytes(rows, length)


def test_deep_nodes_are_the_maximal_repeats():
    rng = random.Random(2)
    for trial in range(60):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 5))]
        if trial % 3 == 0 and texts[0]:
            texts.append(list(texts[0]))  # equal texts
        length, want, occurs = rng.randint(1, 4), set(), defaultdict(list)
        for t in texts:
            for i in range(len(t)):
                for j in range(i + length, len(t) + 1):
                    occurs[tuple(t[i:j])].append((t[i - 1] if i else object(), t[j] if j < len(t) else object()))
        for s, where in occurs.items():
            if len(where) > 1 and len({a for a, _ in where}) > 1 and len({b for _, b in where}) > 1:
                want.add(s)
        assert substring_dedup.maximal_repeats(texts, length) == want, texts


def test_buckets_are_those_of_sorted_suffixes():
    rng = np.random.default_rng(3)
    for trial in range(40):
        sizes = rng.integers(1, 60, 5)
        raw = rng.integers(97, 99, sizes.sum()).astype(np.uint8)
        if trial % 2:
            raw[: sizes[0]] = 97
        stop = np.cumsum(sizes)
        ends = np.repeat(stop, sizes)
        length = int(rng.integers(8, 30))
        order, bucket = suffix_dedup.refined_buckets(raw, ends, np.zeros(len(raw), np.int64), length)
        texts = [raw[i : ends[i]].tobytes() for i in range(len(raw))]
        assert sorted(order.tolist()) == list(range(len(raw)))
        assert [texts[i][:length] for i in order] == sorted(t[:length] for t in texts)
        for i in range(len(raw)):
            for j in range(i):
                if bucket[i] == bucket[j]:
                    assert texts[i][:length] == texts[j][:length]


def test_long_texts_are_cut_alike(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PORTION", 256)
    rng = random.Random(4)
    rows = corpus(rng, 40)
    for unit in (repeats.Words(13, 5), repeats.Bytes(60, 20)):
        total = 0
        for held in repeats._portions([t for _, t in rows], unit):
            _, values, sizes, _, _ = unit.values([p for _, _, p in held])
            h = anchors.grams(values, unit.k)
            _, n, _ = anchors.runs(h, np.repeat(np.cumsum(sizes), sizes), unit.k, unit.length)
            total += int(n.sum())
        assert total == sum(max(0, len(unit.units(t)) - unit.length + 1) for _, t in rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.deduped(df).count() == 0 and suffix_dedup.deduped(df).count() == 0
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert substring_dedup.deduped(df).first()["n_words"] == 0 and suffix_dedup.deduped(df).first()["n_bytes"] == 0
