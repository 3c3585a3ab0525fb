import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ann


def brute(rows, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in sorted(ok):
        if i % 20 == 0:
            near = []
            for j, w in ok:
                if j != i and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v, w):
                        s += float(a) * float(b)
                    near.append((-s, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


def run(spark, rows, k=20):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, dim string").repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k).collect())


def rows_of(n=400, d=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=d)]) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same) for i in range(120)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * d), (5003, [float("nan")] + [1.0] * (d - 1)), (5004, [None] + [1.0] * (d - 1)), (5005, [float("inf")] * d), (5020, [1.0, 2.0]), (5021, [2.0, 1.0]), (None, same), rows[3], rows[0]]
    return rows


def test_equals_brute_force(spark):
    assert run(spark, rows_of()) == brute(rows_of(), 20)


def test_small_blocks_and_two_merges(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ann, "MERGE", 4)
    assert run(spark, rows_of(200), 7) == brute(rows_of(200), 7)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 2.0)]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(5, 2000)), rng.normal(size=(50, 2000)) * 1e3
    low, high = ann.bounds(ann.rounded(q), ann.rounded(v))
    assert ((low <= q @ v.T) & (q @ v.T <= high)).all() and np.isfinite(low).all()
    for i in range(5):
        assert set(np.argsort(-(v @ q[i]))[:10]) <= set(np.flatnonzero(ann.survivors(low[i], high[i], 10)))


@pytest.mark.parametrize("size", [1e-170, 1e-300, 1e200])
def test_very_small_and_very_large_components(spark, size):
    """Norms and products that leave the range of doubles; products that do are ranked as doubles say."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.abs(rng.normal(size=8)) * (size if i % 3 else 1.0)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(rows, 20) and len(got) == 6 * 20
