import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import negatives, queries


def brute(rows):
    """rows: (vec_id, label, vector) as mined; labels as they are."""
    ok = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in sorted(ok):
        if i % 50:
            continue
        near = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), j, z) for j, z, w in ok if j != i and len(w) == len(v))
        for s, j, _ in [x for x in near if x[2] == y][:5]:
            hard = [x for x in near if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(hard)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, dim string, at int").repartition(3)
    found = negatives.mine(df, F.col("vec_id") % 50 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def rows_of(n=600, d=16, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    axis = rng.normal(size=(labels, d))
    rows = []
    for i in range(n):
        y = int(rng.integers(labels))
        v = axis[y] + 0.8 * axis[0] + rng.normal(size=d)
        rows.append((i, y, [float(np.float32(x)) for x in v / np.linalg.norm(v)]))
    same = rows[7][2]
    rows += [(n + i, i % 2, same) for i in range(150)]
    rows += [(5000, None, same), (5001, 1, None), (5050, 1, [float("nan")] * d), (5051, 1, [None] + [1.0] * (d - 1)), (5052, 1, [float("inf")] * d), (5100, 1, []), (5101, 1, []), (5102, 2, [])]
    rows += [(5150, 1, [1.0, 2.0]), (5151, 1, [2.0, 1.0]), (5152, 2, [1.0, 1.0]), (None, 1, same), rows[3], rows[0]]
    return rows


def test_equals_brute_force(spark):
    rows = rows_of()
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "VECTOR_BLOCK", 32)
    monkeypatch.setattr(negatives, "QUERY_BLOCK", 3)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    assert run(spark, rows_of(300, 5, 2)) == brute(rows_of(300, 5, 2))


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])]) == [(0, 1, 1, 2, 65536, 32768)]


@pytest.mark.parametrize("size", [1e6, 1e9, 1e30])
def test_large_components(spark, size):
    """Products beyond 64 bits count as the end of the range."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(np.float32(x * size)) for x in rng.normal(size=6)]) for i in range(160)]
    assert run(spark, rows) == brute(rows)


def test_rows_are_discarded_early_and_rightly():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(24, 24)) * np.geomspace(8, 0.05, 24)
    whole = np.floor(256 * rng.normal(size=(900, 24)) @ base)
    turn = np.linalg.eigh(whole.T @ whole)[1][:, ::-1]
    a, v = negatives.Side(whole[:5], turn, [3, 9]), negatives.Side(whole, turn, [3, 9])
    for (i, at, scores) in negatives.surviving(a, v, lambda i, at, low, high: high >= negatives.at_least(low, 10)):
        every = whole @ whole[i]
        assert set(np.argsort(-every)[:10]) <= set(at) and len(at) < 200
        assert (scores == every[at]).all()


def test_labels_of_the_query(spark):
    rows = rows_of(400, 8, 5, 10)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    turned = [(i, (y + 1) % 10 if i is not None and y is not None and i % 7 == 0 else y, v) for i, y, v in rows]
    assert sorted(tuple(r) for r in queries.negative_rows(df).collect()) == brute(turned)
