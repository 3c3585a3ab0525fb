import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemill.llm import bpe, queries

RANKS = bpe.ranks(public_tokenizers.path(queries.RANKS))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(1)
    odd = [chr(c) for c in (0x558, 0x11DE0, 0x1F600, 0xA0, 0x85, 0x2028, 0, 0x1C, 0xFEFF, 0x3000, 0x323B0, 0x301)]
    made = ["".join(rng.choice(["a", "Z", "é", "漢", " ", "  ", "\n", "\t", "1", "½", "'s", "'LL", ".", "!!", "<|endoftext|>", *odd]) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [None, "", " ", "\n\n ", "the", *made, "x" * 30000, " word" * 20000, "ab\n" * 5000, made[3], made[3]]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, block int").repartition(3)
    return sorted((tuple(r) for r in queries.bpe_rows(df, RANKS, public_tokenizers.PATTERN).collect()), key=repr)


def brute(rows, library):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "twice"), (3, "twice")]
    assert run(spark, rows) == brute(rows, library)


def test_small_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 300)
    rows = list(enumerate(texts()))
    assert run(spark, rows) == brute(rows, library)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")], tiktoken.Encoding("own", pat_str="a", mergeable_ranks=RANKS, special_tokens={}))


def test_every_character_is_split_as_in_the_library(library):
    split = bpe.Splitter(*bpe.patterns(public_tokenizers.PATTERN))
    whole = tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=RANKS, special_tokens={})
    for low in range(0, 0x110000, 0x800):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}." for c in range(low, low + 0x800) if not 0xD800 <= c <= 0xDFFF)
        assert [i for w in split(text) for i in whole.encode_ordinary(w)] == library.encode_ordinary(text), hex(low)


def test_ids_and_bytes(spark, library):
    df = spark.createDataFrame([("a", "Hello wörld\n"), ("b", None)], "name string, body string")
    found = bpe.encode(df, RANKS, public_tokenizers.PATTERN, "name", "body")
    assert {r.name: r.ids for r in found.collect()} == {"a": library.encode_ordinary("Hello wörld\n"), "b": []}
    assert {r.name: bytes(r.decoded) for r in bpe.decode(found, RANKS).collect()} == {"a": "Hello wörld\n".encode(), "b": b""}
    none = bpe.decode(found.withColumn("ids", F.when(F.col("name") == "a", F.col("ids"))), RANKS).collect()
    assert {r.name: r.decoded for r in none}["b"] is None


def test_one_shuffle_of_the_texts(spark):
    """The words' branch and the texts' branch read the same exchange."""
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    found = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
