import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import minhash, textbytes
from tidemill.operators.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(id, set size, component, kept) per row by comparing every pair."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=repr)


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünïcode", "日本", "ABC", "abc"]
    rows, shared = [], [rng.choice(vocab) for _ in range(40)]
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if g % 4 == 0:
                w += shared
            rows.append(" ".join(w).replace(" ", rng.choice([" ", "\t", "\n ", "\x0b"])))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def near(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, set_key string, mark int").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=repr)


def test_against_all_pairs(spark):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A B"), (1005, "a b c"), (7, "same text here"), (7, "same text here")]
    assert near(spark, rows) == brute(rows)


@pytest.mark.parametrize("bound, most", [("BLOCK", 3), ("BLOCK_SHINGLES", 150)])
def test_chain_and_blocks(spark, monkeypatch, bound, most):
    """A chain in which only neighbours are linked, and buckets and groups that are larger than a block."""
    monkeypatch.setattr(minhash, bound, most)
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(60)] + [(500 + i, " ".join(words[:60] + [f"z{i}"] * 4)) for i in range(30)]
    assert near(spark, rows) == brute(rows)


def test_empty(spark):
    assert near(spark, []) == []
    assert near(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_deduplicate_keeps_one_of_each(spark):
    rows = corpus(2, 5, 6) + [(7, "same text here")] * 3 + [(3, ""), (4, None)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, id string")
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    kept = sorted({r[0] for r in brute(rows) if r[3]})
    assert sorted(r.doc_id for r in out.collect()) == kept


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(3)
    off = []
    for share in (0.2, 0.5, 0.75, 0.9):
        for _ in range(40):
            n = 600
            both = int(n * share)
            x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            a, b = x[:n], np.r_[x[:both], x[n:]]
            true = both / (2 * n - both)
            off.append((minhash.signature(a) == minhash.signature(b)).mean() - true)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_shingle_sets_count_like_python():
    texts = [t for _, t in corpus(4)] + ["", None, "a", "é  è", "A a A a A a A a"]
    assert [len(s) for s in textbytes.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {v: v for e in edges for v in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {v: up[v] for e in edges if e[0] != e[1] for v in e}


def test_large_buckets(spark, monkeypatch):
    """Buckets whose facts are sent to their rows, and tiles of few rows."""
    monkeypatch.setattr(minhash, "LARGE", 4)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = corpus(6, 5, 24)
    assert near(spark, rows) == brute(rows)


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def test_words_of_one_polynomial_differ(spark):
    """Words on which any polynomial modulo a power of two agrees."""
    for n in (1024, 2048, 4096):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        one, two = textbytes.shingle_sets(pa.array([x, y]))
        assert one[0] != two[0]
    rows = [(1, thue_morse(2048)), (2, thue_morse(2048, "b", "a")), (3, "a\0"), (4, "a"), (5, "a" * 8), (6, "a" * 9), (7, "a" * 16)]
    assert near(spark, rows) == brute(rows)


def test_near_copies_without_ids(spark):
    words = [f"t{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join([*words, "other"])]
    df = spark.createDataFrame([(None, t) for t in texts] + [(None, None)], "doc_id long, text string")
    out = minhash.deduplicate(df).collect()
    assert len(out) == 2 and sum(r.text in texts for r in out) == 1
    mixed = spark.createDataFrame([(None, texts[0]), (5, texts[1]), (4, texts[2])], "doc_id long, text string")
    assert [r.doc_id for r in minhash.deduplicate(mixed).collect()] == [4]


def test_many_null_ids_are_linear(spark):
    """Each class reads its own text, not every text of its id."""
    rows = [(None, " ".join(f"w{i}x{j}" for j in range(12)) + (" tail" if k else "")) for i in range(5000) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = minhash.fingerprints(df)
    want = prints.select(F.monotonically_increasing_id().alias("nid"), "set_key", "doc_id", "mark")
    sets = minhash._sets(df, want, 5)
    assert sets.count() == 10000
    joined = df.select("doc_id", minhash.text_mark().alias("mark")).join(want.select(F.col("doc_id").alias("i"), F.col("mark").alias("m")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
    assert joined.count() == 10000
    out = minhash.near_duplicates(df)
    assert out.count() == 10000 and out.where("kept").count() == 10000
