import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, row string, part int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, tamper=False):
    d, text, lang, source, n = r[:5]
    if tamper and text is not None:
        text = text.replace("\n", "")
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, source, lang, n, text)])


def up(nodes):
    """(root, siblings of each node as lists of (left, right))"""
    own = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, beneath = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j in range(len(run)):
                for x in under[i + j]:
                    own[x].append((run[:j], run[j + 1 :]))
            above.append(H(*run))
            beneath.append(sum(under[i : i + 3], []))
        nodes, under = above, beneath
    return nodes[0], own


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    found, roots = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, own = up([leaf(r) for r in mine])
        roots.append(root)
        found.append((mine, own))
    root, upper = up(roots)
    out = []
    for (mine, own), subroot, rest in zip(found, roots, upper):
        for r, path in zip(mine, own):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, even)
            for left, right in path + rest:
                node = H(*left, node, *right)
            out.append((r[0], leaf(r), subroot, root, H(*[x for a, b in path + rest for x in a + b]), node, node == root))
    return sorted(out, key=repr)


def rows_of(n):
    rows = [(i * 7 % 1000003, f"text {i}\nline" if i % 3 else f"text {i}", "en" if i % 4 else None, ["a", "b", "ü", "", None, "one" if i == 5 else "a"][i % 6], i % 90 or None) for i in range(n)]
    rows += [(None, "x\ny", "en", "a", 3), (None, "x\ny", "en", "a", 3), (None, None, None, None, None), (4, "", "en", "a", 0), (4, "", "en", "a", 0), (8, "é" * 70000, "fr", "b", 70000)]
    return [(*r, 1, "r", 2) for r in rows]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in queries.merkle_rows(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_equals_brute_force(spark):
    rows = rows_of(2500)
    got = run(spark, rows)
    assert got == brute(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 4, 10, 28])
def test_small_tables(spark, n):
    rows = [(i, f"t{i}", "en", "s", 2, 1, "r", 2) for i in range(n)]
    assert run(spark, rows) == (brute(rows) if n else [])


def test_several_rounds_and_many_groups(spark, monkeypatch):
    """Small blocks, a tiny driver's share, more groups than that share: paths come from tables instead of the broadcast."""
    monkeypatch.setattr(merkle, "LEAST", 1)
    monkeypatch.setattr(merkle, "MOST", 1)
    monkeypatch.setattr(merkle, "TOP", 9)
    rows = [(i, f"t{i}\n", "en", f"s{i % 40:02}" if i % 2 else "hot", i, 1, "r", 2) for i in range(300)]
    assert run(spark, rows) == brute(rows)
    rows = [(i, f"t{i}", "en", "only", i, 1, "r", 2) for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_proofs_are_real(spark):
    df = spark.createDataFrame(rows_of(50), SCHEMA)
    rows = df.select("doc_id", "source", "leaf", merkle.leaf(F.col("doc_id"), F.col("text")).alias("mine"))
    got = merkle.manifest(rows, "mine", "source", "doc_id", ["doc_id"]).withColumn("back", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert got and all(r.back == r.root for r in got)
    assert {len(s.left + s.right) % 64 for r in got for s in r.proof} == {0}
