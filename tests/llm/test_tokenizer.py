"""Tokenizer and pieces against the public library, and exact round trips."""

import random

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm import pieces, tokenizer


@pytest.fixture(scope="module")
def automaton():
    with open(tokenizer.BYTE_BPE_50K, "rb") as f:
        return tokenizer.compiled(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer.BYTE_BPE_50K)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def texts():
    given = [t for t in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"])["text"].to_pylist() if t is not None]
    rnd, chars = random.Random(5), "aab  \n\t\x1c\x85\xa0　​é漢字😀ẞ123'st ll.!ABC٣²�\x00"
    return [*given, *("".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(2000)), "", " ", "<|endoftext|>", "a" * 5000, "😀" * 900, "\n" * 1500]


def test_ids_as_library(automaton, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [automaton.encode(t) for t in texts] == want
    assert all(automaton.decode(i) == t for t, i in zip(texts, want, strict=True))


def test_small_vocabulary_as_merging():
    """Paths of the automaton against merging pair by pair, over all words of a small alphabet."""
    import itertools
    import json

    merges = [["a", "a"], ["a", "b"], ["aa", "b"], ["b", "b"], ["ab", "ab"], ["aab", "b"], ["b", "a"], ["bb", "bb"]]
    vocab = {c: i for i, c in enumerate(tokenizer.printable())}
    for u, v in merges:
        vocab[u + v] = len(vocab)
    a = tokenizer.TokenAutomaton(json.dumps({"model": {"vocab": vocab, "merges": merges}}).encode())
    rank = {tuple(m): k for k, m in enumerate(merges)}
    for n in range(1, 10):
        for w in itertools.product("ab", repeat=n):
            seq = list(w)
            while pairs := [(rank[p], i) for i, p in enumerate(zip(seq, seq[1:], strict=False)) if p in rank]:
                i = min(pairs)[1]
                seq[i : i + 2] = ["".join(seq[i : i + 2])]
            assert a.word("".join(w).encode()) == tuple(vocab[s] for s in seq), w


def test_column(spark, automaton):
    df = spark.createDataFrame([(1, "one two", "x"), (2, None, "y"), (3, "", None)], "doc_id int, text string, ids string")
    vocab = tokenizer.vocabulary(spark)
    got = {r["doc_id"]: r["got"] for r in df.select("*", tokenizer.encode(F.col("text"), vocab).alias("got")).collect()}
    assert got == {1: automaton.encode("one two"), 2: [], 3: []}
    assert df.limit(0).select(tokenizer.encode(F.col("text"), vocab)).count() == 0
    back = df.select(tokenizer.decode(tokenizer.encode(F.col("text"), vocab), vocab).alias("t"), tokenizer.count_tokens(F.col("text"), vocab).alias("n")).collect()
    assert [tuple(r) for r in back] == [("one two", 2), ("", 0), ("", 0)]


def test_pieces(automaton, texts):
    for size, overlap in ((512, 64), (32, 8), (8, 0)):
        for text, got in zip(texts, pieces.cut_batch(automaton, texts, size, overlap), strict=True):
            ids = automaton.encode(text)
            assert all(0 <= p["tokens"] <= size for p in got) and [p["piece"] for p in got] == list(range(len(got)))
            assert (len(got) == 1) == (len(ids) <= size)
            whole = automaton.decode(ids)
            assert got[0]["first"] == 0 and got[-1]["first"] + got[-1]["tokens"] == len(ids)
            joined = []
            for a, b in zip(got, got[1:], strict=False):
                shared = a["first"] + a["tokens"] - b["first"]
                assert overlap <= shared <= overlap + 12
            for p in got:
                joined += ids[max(len(joined), p["first"]) : p["first"] + p["tokens"]]
                assert automaton.decode(ids[p["first"] : p["first"] + p["tokens"]]) == p["piece_text"]
            assert automaton.decode(joined) == whole


def test_boundaries(automaton):
    text = "\n\n".join(" ".join(f"Word{i} follows word{j}." for j in range(12)) for i in range(30))
    got = pieces.cut_batch(automaton, [text], 200, 20)[0]
    assert {p["boundary"] for p in got[:-1]} == {"paragraph"} and got[-1]["boundary"] == "end"
    got = pieces.cut_batch(automaton, ["word " * 900], 200, 20)[0]
    assert {p["boundary"] for p in got[:-1]} == {"word"}


def test_doubling_as_walk():
    import numpy as np

    rng = np.random.default_rng(1)
    nxt = np.minimum(np.arange(500) + rng.integers(1, 9, 500), 499)
    walk, at = {0}, 0
    while at != nxt[at]:
        at = int(nxt[at])
        walk.add(at)
    assert set(np.flatnonzero(pieces.reached(nxt, np.array([0]))).tolist()) == walk


def test_cut_texts(spark):
    df = spark.createDataFrame([(1, "a b " * 700, "k"), (2, None, "k"), (3, "", "k")], "doc_id int, text string, first_name string")
    got = pieces.cut_texts(df, "text", tokenizer.vocabulary(spark)).collect()
    assert sorted({r["doc_id"] for r in got}) == [1, 3] and sum(r["doc_id"] == 1 for r in got) > 2
    with pytest.raises(ValueError):
        pieces.cut_texts(df.withColumn("tokens", F.lit(1)), "text", tokenizer.vocabulary(spark))


def test_split_of_every_character(automaton):
    """Python's own engine with written-out classes splits as the pattern does, around each character."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(every), 4096):
        text = "".join(f"a{c}1 {c}{c}b {c}" for c in every[k : k + 4096])
        assert automaton.split(text) == automaton.any_split(text)
