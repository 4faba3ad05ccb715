import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from finscope.llm import bpe, token_counts

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "e", "th", "the ", " ", "  ", "\n", "'s", "'ll", "'", "12", "9999", "ñ", "Ünder", "日本", "🙂", "!!", "$", "\t", " \n ", "Zx"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Coder(ranks, bpe.PerfectHash.build(ranks), P.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    out = ["", " ", "\n\n", "hello world", "x" * 3000, "aé" * 500, "don't we'll I'm", "a  b   c ", "<|endoftext|>", " 　 x"]
    return out + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 200))) for _ in range(300)]


def test_perfect_hash_is_minimal_and_exact(ranks):
    table = bpe.PerfectHash.build(ranks)
    assert len(table.keys) == len(ranks) and set(table.keys) == set(ranks)
    assert table.find(list(ranks)) == list(ranks.values())
    assert table.find([b"not a token at all", b"\xff\xfe\xfd\xfc"]) == [-1, -1]


def test_ids_are_those_of_the_library(coder, library):
    for text in texts():
        got = b"".join(map(coder.encode, coder.pieces(text)))
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text), text[:50]


def test_stretches_do_not_change_the_pieces(coder, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 16)
    for text in texts():
        assert [p for found in coder.pieces(text) for p in found] == coder.split.findall(text)


def test_queries_columns_and_odd_rows(spark):
    tokenizer = bpe.Tokenizer(spark, PATH, P.PATTERN)
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "hola que tal", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decoded(bpe.encoded(df, tokenizer), tokenizer)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for r in out.collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    again = bpe.encoded(df, tokenizer, decode=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert bpe.encoded(df.limit(0), tokenizer).count() == 0


def test_little_memory_does_not_change_the_ids(ranks, library):
    own = bpe.Coder(ranks, bpe.PerfectHash.build(ranks), P.PATTERN, keep=1000)
    for text in texts():
        assert np.frombuffer(b"".join(map(own.encode, own.pieces(text))), "<u4").tolist() == library.encode_ordinary(text)
        assert own.held == sum(bpe.ENTRY + len(a) + len(b) for a, b in own.known.items())


def test_counts_follow_edits(coder):
    rng = random.Random(11)
    total = redone = 0
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 300)))
        edits = [{"start": (a := rng.randint(0, len(text))), "end": a + rng.choice([0, 1, 3, 40]), "new": rng.choice(["", " ", "x", "'", "the 12", "\n"])} for _ in range(rng.choice([1, 1, 2, 5]))]
        edits = token_counts.cleaned(edits, len(text))
        tree = token_counts.CountTree.of(coder, text)
        count = lambda t: sum(len(coder.encode(p)) // 4 for p in coder.pieces(t))
        assert tree.tokens == count(text)
        tree, again = token_counts.apply_edits(tree, coder, text, edits) if edits else (tree, 0)
        new = token_counts.edited_text(text, edits)
        assert tree.tokens == count(new)
        assert int(tree.sums[1, 0]) == len(new)
        more = token_counts.cleaned([{"start": 1, "end": 4, "new": "zz"}], len(new))
        if more:
            tree, _ = token_counts.apply_edits(tree, coder, new, more)
            assert tree.tokens == count(token_counts.edited_text(new, more))
    text = "word and more words " * 500
    tree = token_counts.CountTree.of(coder, text)
    _, again = token_counts.apply_edits(tree, coder, text, [(5000, 5004, "other")])
    assert again < 100 and tree.tokens == sum(len(coder.encode(p)) // 4 for p in coder.pieces(text[:5000] + "other" + text[5004:]))


def test_count_operator_on_odd_rows(spark):
    tokenizer = bpe.Tokenizer(spark, PATH, P.PATTERN)
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "call 555123 now", "c"), (None, "mail 99999", "d")], "doc_id long, text string, n_tokens string")
    state = token_counts.counted(token_counts.pattern_edits(df, "[0-9]{4,}", "<num>"), tokenizer)
    rows = {r["text"]: r for r in token_counts.recounted(state, tokenizer).collect()}
    assert rows[None]["n_tokens"] == 0 and rows[None]["n_edits"] == 0
    assert rows["call 555123 now"]["n_edits"] == 1
    fresh = spark.createDataFrame([(1, "call <num> now")], "doc_id long, text string")
    assert rows["call 555123 now"]["n_tokens_edited"] == token_counts.counted(fresh, tokenizer).first()["n_tokens"]
    assert sum(rows["call 555123 now"]["leaf_tokens"]) == rows["call 555123 now"]["n_tokens_edited"]
