import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.llm import quality


def text(rng, good):
    w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(8, 200))]
    return " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)


def corpus(n=400):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(n)]
    return rows


def frames(spark, rows, labels):
    return spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, quality string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_holds_out(spark):
    rows = corpus() + [(9000, None, 1), (9001, "", 1), (None, "words without id", 1), (5, "again", 1)]
    docs, labels = frames(spark, rows, [(i, q, 0) for i, _, q in rows[:400]] + [(1, 0, 0), (2, None, 0), (None, 1, 0)])
    out = quality.scores(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    truth = {i: q for i, _, q in rows[:400] if i != 5}
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_change_nothing(spark):
    rows = corpus()
    labels = [(i, q, 0) for i, _, q in rows]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1) for i, q, _ in labels]
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.scores(*frames(spark, rows, x)).collect()) for x in (labels, turned))
    assert a == b


def test_matches_plain_discriminant():
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    x = {0: rng.normal(size=(300, d)) * 2 + 1, 1: rng.normal(size=(500, d))}
    for c in x:
        x[c][:, 1] = 12  # many words: no weight is taken from the statistics
        x[c][:, 1] += rng.normal(size=len(x[c])) * 0.1
    m = quality.Discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    every = np.concatenate([x[0], x[1]])
    z = lambda v: (v - every.mean(0)) / every.std(0)
    cov = {c: np.cov(z(v).T, bias=True) for c, v in x.items()}
    pooled = (300 * cov[0] + 500 * cov[1]) / 800
    log = []
    for c, n in ((0, 300), (1, 500)):
        s = 0.9 * cov[c] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / d * np.eye(d)
        diff = z(every) - z(x[c]).mean(0)
        log.append(np.log(n / 800) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff))
    odds = np.clip(log[1] - log[0], -30, 30)
    inner = np.abs(z(every)).max(axis=1) < quality.WITHIN
    got = np.log(m.score(every) / (1 - m.score(every)))
    assert np.allclose(got[inner & (np.abs(odds) < 20)], odds[inner & (np.abs(odds) < 20)], rtol=0.02, atol=0.05)


def test_no_labels_one_class_and_empty(spark):
    docs, none = frames(spark, corpus(12), [])
    assert {r.score for r in quality.scores(docs, none).collect()} == {0.5}
    _, one = frames(spark, corpus(12), [(i, 1, 0) for i in range(12)])
    assert all(r.score > 0.8 for r in quality.scores(docs, one).collect())
    assert quality.scores(docs.limit(0), none).collect() == []


def test_statistics_do_not_depend_on_batches():
    texts = [t for _, t, _ in corpus(60)] + ["", None, "x" * 3_000_000, "é\n|"]
    whole = quality.statistics(pa.array(texts))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone) and np.isfinite(whole).all()


def test_keep_good(spark):
    rows = corpus()
    docs, labels = frames(spark, rows, [(i, q, 0) for i, _, q in rows])
    out = quality.keep_good(docs.withColumn("x", F.lit(1)), labels)
    assert out.columns == ["doc_id", "text", "quality", "x"]
    kept = {r.doc_id for r in out.collect()}
    assert len(kept ^ {i for i, _, q in rows if q}) < 8
