"""Quality classifier: regularised quadratic discriminant analysis over statistics of whole texts.

Each text becomes a vector of transformed counts and ratios.  Per class a mean and a covariance are learned from
sums that Spark adds up over all training rows; each covariance is shrunk towards the pooled one and towards a
multiple of the identity, and factored once.  A score is the logistic of the difference of the two log
densities: squared Mahalanobis distances by the cached inverse Cholesky factors, log determinants, and priors.

Nulls, ties and repeats: a null text is empty, and an empty text has a vector and so a score; a label that is
null or whose ``doc_id`` bears two different labels is not learned from; equal labels repeated count once; rows
with equal ids are scored one by one.  With no label, or labels of one class, every score is the smoothed share
of good labels.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textbytes
from tidemill.scratch import materialise

#: Byte classes: lower, upper, digit, blank, line end, full stop and comma, other sentence marks, exclamation, bar, other symbols, beyond ASCII.
_CLASS = np.full(256, 9, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]] = 0, 1, 2, 3, 4
_CLASS[[44, 46]], _CLASS[[34, 39, 40, 41, 45, 58, 59, 63]], _CLASS[33], _CLASS[124], _CLASS[128:] = 5, 6, 7, 8, 10
N_CLASS = 11
FEATURES = ("chars", "words", "word_length", "word_spread", "short", "long", "upper", "digit", "lines", "stops", "marks", "shouts", "bars", "symbols", "beyond", "end_mark", "all_upper", "distinct_words", "distinct_triples")
#: Shrinkage of a class covariance towards the pooled one, and of the result towards a multiple of the identity.
POOL, RIDGE = 0.1, 0.02
#: Standardised statistics are held within so many deviations.
WITHIN = 6.0
#: Most labelled ids that are sent to every executor (at most 40 MB).
SEND_ROWS = 500_000
#: A text of so many words has half the weight of its own statistics; the rest is the corpus mean.
HALF_WORDS = 6.0


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text."""
    out = []
    for _, data, at in textbytes.slices(texts):
        n = len(at) - 1
        size = np.diff(at)
        row = np.repeat(np.arange(n), size)
        kinds = _CLASS[data]
        c = np.bincount(row * N_CLASS + kinds, minlength=n * N_CLASS).reshape(n, N_CLASS).astype(float)
        starts, ends, first = textbytes.words(data, at)
        count = np.diff(first)
        of = np.repeat(np.arange(n), count)
        length = (ends - starts).astype(float)
        add = lambda x: np.bincount(of, x, minlength=n)
        w = np.maximum(count, 1)
        mean = add(length) / w
        last = kinds[ends - 1]
        upper = np.cumsum(np.r_[0, kinds == 1])
        lower = np.cumsum(np.r_[0, kinds == 0])
        loud = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
        hashes = textbytes.word_hashes(data, starts, ends)
        triples = textbytes.mix64(hashes[:-2] + textbytes.mix64(hashes[1:-1] + textbytes.mix64(hashes[2:]))) if len(hashes) > 2 else hashes[:0]
        one = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], float)
        three = np.array([len(np.unique(triples[a : max(a, b - 2)])) for a, b in zip(first[:-1], first[1:])], float)
        z = np.maximum(size, 1)
        part = lambda x, of_all: np.log(x / of_all + 0.002)
        out.append(np.column_stack([
            np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(np.sqrt(np.maximum(add(length**2) / w - mean**2, 0))),
            part(add(length <= 3), w), part(add(length >= 14), w), part(c[:, 1], z), part(c[:, 2], z), part(c[:, 4], z), part(c[:, 5], z), part(c[:, 6], z),
            part(c[:, 7], z), part(c[:, 8], z), part(c[:, 9], z), part(c[:, 10], z), part(add(last >= 5), w), part(add(loud) , w),
            np.where(count > 0, one / w, 1.0), np.where(count > 2, three / np.maximum(count - 2, 1), 1.0),
        ]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its text, per row of ``docs``."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = statistics(batch.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class of ``rows`` (y, x): count, sum, and sum of outer products; added up in tasks and then by Spark."""
    d = len(FEATURES)

    def run(batches):
        total = {}
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                z = x[y == c]
                total[c] = total.get(c, 0) + np.r_[len(z), z.sum(axis=0), (z.T @ z).ravel()]
        for c, v in total.items():
            yield pa.RecordBatch.from_pydict({"y": np.full(len(v), c, np.int32), "k": np.arange(len(v), dtype=np.int32), "v": v})

    sums = rows.select("y", "x").mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in sums:
            if r.y == c:
                v[r.k] = r.v
        out[c] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return out


class Discriminant:
    """The learned model: a centre and scale for all statistics, and per class a mean, an inverse Cholesky factor and a constant."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE):
        (n0, s0, q0), (n1, s1, q1) = moments[0], moments[1]
        n = n0 + n1
        self.share = (n1 + 1) / (n + 2)
        self.learned = n0 >= 2 and n1 >= 2
        if not self.learned:
            return
        self.mid = (s0 + s1) / n
        self.scale = np.sqrt(np.maximum(np.diag(q0 + q1) / n - self.mid**2, 1e-6))
        spread = {c: (q / m - np.outer(s, s) / m**2) / np.outer(self.scale, self.scale) for c, (m, s, q) in moments.items()}
        pooled = (n0 * spread[0] + n1 * spread[1]) / n
        self.classes = []
        for c, (m, s, _) in moments.items():
            cov = (1 - pool) * spread[c] + pool * pooled
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes.append(((s / m - self.mid) / self.scale, np.linalg.inv(factor), np.log(m / n) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row of ``x``."""
        if not self.learned:
            return np.full(len(x), self.share)
        words = np.expm1(x[:, [1]])
        z = np.clip((x - self.mid) / self.scale, -WITHIN, WITHIN) * (words / (words + HALF_WORDS))
        bad, good = (const - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, const in self.classes)
        return 1 / (1 + np.exp(-np.clip(good - bad, -30, 30)))


def _labelled(labels: DataFrame, train: Column) -> DataFrame:
    """doc_id and y of the labels that may be learned from."""
    return labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").select("doc_id", F.col("y").cast("int").alias("y"))


def fit(table: DataFrame, labels: DataFrame, train: Column) -> Discriminant:
    """Learn from the rows of ``table`` (doc_id, x) that ``train`` picks and ``labels`` (doc_id, quality) names."""
    return Discriminant(_moments(table.join(_labelled(labels, train), "doc_id")))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted per row of ``docs``; rows whose id's checksum is 1 modulo 3 are never learned from."""
    table = materialise(features(docs), "statistics")
    model = fit(table, labels, ~held_out(F.col("doc_id")))
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = table.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows that score under ``least``.

    Only labelled texts are read for the model, if their ids are few enough to be sent to every executor.
    """
    train = ~held_out(F.col("doc_id"))
    known = materialise(_labelled(labels, train).select("doc_id"), "labelled")
    learn = docs.select("doc_id", "text")
    if known.count() <= SEND_ROWS:
        learn = learn.join(F.broadcast(known), "doc_id", "left_semi")
    # written first, so that no task runs two Python workers at once
    model = fit(materialise(features(learn), "statistics"), labels, train)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics(pa.Array.from_pandas(texts, type=pa.string()))))

    return docs.where(judge(F.coalesce("text", F.lit(""))) >= least)
