import math
import os
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from finscope.llm import language_id

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns, name
        left.append(out.count())
        docs = out
    assert 150 < left[-1] < left[0] <= 200
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("NOT round_trip").count() == 0 and last.count() == left[-1]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def plain_groups(rows, width, least):
    """Least id of each document's group: links are Jaccard similarities of word shingles, over all pairs."""
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = []
    for i, text in rows:
        words = (text or "").lower().split()
        sets.append((i, words, {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}))
    for a, (i, words_a, x) in enumerate(sets):
        for j, words_b, y in sets[a + 1 :]:
            if words_a == words_b or (words_a and words_b and len(x & y) >= least * len(x | y)):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i: top(i) for i, _ in rows}


def plain_lines(rows, width=3):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        windows = [tuple(lines[k : k + width]) for k in range(len(lines) - width + 1)]
        own = {k for k, w in enumerate(windows) if "".join(w).strip() and (w in seen or w in windows[:k])}
        seen.update(windows)
        out[i] = "\n".join(line for k, line in enumerate(lines) if not any(k - d in own for d in range(width)))
    return out


def plain_words(text):
    return [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", text.lower()) if w]


def plain_score(item, words):
    """Smith-Waterman by a full table, as a share of the item's score against itself."""
    above, best = [0] * (len(words) + 1), 0
    for x in item:
        now = [0]
        for k, y in enumerate(words):
            now.append(max(0, above[k] + (2 if x == y else -1), above[k + 1] - 1, now[k] - 1))
        above, best = now, max(best, *now)
    return best / (2 * len(item))


def plain_language(model, text):
    """(language, accepted) by the cosine with each centroid, over counts in a dictionary."""
    fold = [ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in text.encode()]
    tf = Counter()
    for n in (1, 2, 3):
        for k in range(len(fold) - n + 1):
            code = sum(b << (8 * at) for at, b in enumerate(fold[k : k + n])) + (n << 24)
            tf[(code * 2654435761 & 0xFFFFFFFF) >> (32 - (len(model.idf).bit_length() - 1))] += 1
    vector = {k: math.log1p(c) * float(model.idf[k]) for k, c in tf.items()}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    scores = [sum(v * float(c[k]) for k, v in vector.items()) / (norm or 1) for c in model.centroids]
    score = max(scores)
    return model.langs[scores.index(score)], score >= model.floor[len(text.encode()).bit_length()], score


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_each_stage_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name, given: sorted(r["doc_id"] for r in stages[name](spark, given, SF).collect())

    model = language_id.fit(docs)
    plain = {i: plain_language(model, t) for i, t in rows if t and any(map(str.isalpha, t))}
    near = lambda i, t: abs(plain[i][2] - model.floor[len(t.encode()).bit_length()]) < 1e-4
    stay = set(ids("language_id", docs))
    assert all((i in stay) == plain[i][1] or near(i, t) for i, t in rows if i in plain) and not stay - set(plain)

    lines = plain_lines(rows)
    got = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, docs, SF).collect()}
    assert all((got.get(i) or "") == lines[i] for i, _ in rows) and any(lines[i] != t for i, t in rows if t)

    groups = plain_groups(rows, 5, 0.8)
    assert ids("simhash_near_dedup", docs) == sorted(set(groups.values()))

    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"]]
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    of_items = [(item, grams(item)) for item in items if len(item) >= 3]
    held = set()
    for i, t in rows:
        words = plain_words(t or "")
        own = grams(words)
        if any(own & g and plain_score(item, words) >= 0.4 for item, g in of_items):
            held.add(i)
    assert held and ids("benchmark_decontamination", docs) == sorted(i for i, _ in rows if i not in held)

    import public_tokenizers
    import tiktoken
    import tiktoken.load

    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(rows)
    for r in stages["byte_level_bpe"](spark, docs, SF).collect():
        assert struct.unpack(f"<{r['n_tokens']}I", bytes(r["ids"])) == tuple(library.encode_ordinary(texts[r["doc_id"]] or "")) and r["round_trip"]


def test_stages_take_odd_rows(spark):
    """Nulls in any column, repeated rows and columns named like those that the stages make."""
    given = spark.read.parquet(f"{SF}/documents.parquet") if os.path.isdir(SF) else None
    if given is None:
        pytest.skip("no test data")
    nothing = given.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in given.schema.fields])
    some = given.limit(20)
    docs = some.unionByName(some).unionByName(nothing).withColumns({c: F.lit("x") for c in ("score", "lang_rejected", "leaks", "n_lines", "n_removed")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count() and (name == "byte_level_bpe" or out.columns == docs.columns), name
    assert corpus_pipeline.dedup_near(spark, docs, SF).groupBy("doc_id").count().where("count > 1").count() == 0
