"""Hard negatives by exact integer products: an orthogonal PCA rotation with bounds on what is not yet added up.

Every component x becomes floor(scale * x), and a row's score is its integer inner product with the anchor.  The
second moments of the rows' directions are summed over all rows; their eigenvectors, largest first, rotate each
vector, which leaves products as they are and puts most of them into the leading components.  Anchors and rows are cut into blocks, and each pair of blocks
is one tile.  There the products of the leading components are added up in stages; what the other components can still
add lies within the product of the two residual norms, and a slack covers rounding.  A row that these bounds rule out
is discarded, the rest go on to the next stage, and the survivors are multiplied in whole numbers.  One pass finds each anchor's
positives, the second its negatives within the window of each positive; a tile hands on only its best, which a window
with a limit merges.  Any orthogonal matrix gives the same result, so lengths other than the commonest, and lengths
above ``MOST_DIM``, simply stay unrotated.

Nulls, ties and repeats: rows with a null id, label or vector, or with a null or non-finite component (or one whose
multiple is not finite) take no part.  Ties go to the smaller ``vec_id``.  Rows that repeat id, label and vector count
once; other rows with an anchor's id are neither its positives nor its negatives, and each anchor row has its own.
Vectors of other lengths are not compared; empty vectors have products of 0.  A score beyond the range of ``long`` counts
as that range's end.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.scratch import materialise

#: Rows of a block of anchors and of a block of vectors; anchors are multiplied ``CHUNK`` at a time.
QUERY_BLOCK, VECTOR_BLOCK, CHUNK = 512, 4096, 64
#: Shares of the rows' second moments (of the components, where no rotation is fitted) that are added up before a row is multiplied in full.
STAGES = (0.8, 0.97)
#: Rounding of a product in doubles, as a share of the norms' product (a thousand times what ``MOST_DIM`` components need).
SLACK = 1e-9
#: The longest vectors for which a rotation is fitted (its square is summed up by every task).
MOST_DIM = 1024
#: Products below this are exact as 64-bit integers; others go through Python's.
WIDE = 2.0**62
LONG = -(2**63), 2**63 - 1

FORM = "at long, vec_id long, label string, dim int, wide int, form binary, anchor boolean"


def _usable(v: Column, scale: int) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))


def _forms(rows: DataFrame, scale: int) -> DataFrame:
    """``rows`` with the vector as whole numbers in the narrowest type that holds them: 2, 4 or 8 (doubles) bytes."""

    def run(batches):
        for batch in batches:
            wide, form = [], []
            for v in batch.column("embedding").to_pylist():
                x = np.floor(np.array(v, np.float64) * scale)
                most = np.abs(x).max(initial=0.0)
                kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64
                wide.append(np.dtype(kind).itemsize)
                form.append(x.astype(kind).tobytes())
            cols = [batch.column(c) for c in ("at", "vec_id", "label", "dim")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(wide, pa.int32()), pa.array(form, pa.binary()), batch.column("anchor")], [c.split()[0] for c in FORM.split(", ")])

    return rows.mapInArrow(run, FORM)


def _matrix(form: list[bytes], wide: list[int], dim: int) -> np.ndarray:
    kinds = {2: np.int16, 4: np.int32, 8: np.float64}
    return np.stack([np.frombuffer(f, kinds[w]).astype(np.float64) for f, w in zip(form, wide)]) if form else np.zeros((0, dim))


def rotation(rows: DataFrame, dim: int) -> tuple[np.ndarray, list[int]]:
    """Eigenvectors of the second moments of all directions of length ``dim``, largest first, as columns; and how many of them each stage takes."""

    def run(batches):
        moment = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("form").to_pylist(), batch.column("wide").to_pylist(), dim)
            m = m / np.abs(m).max(axis=1, initial=1.0)[:, None]
            m = m / np.maximum(np.linalg.norm(m, axis=1), 1e-9)[:, None]
            moment += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(moment.ravel())], ["i", "s"])

    sums = rows.where(F.col("dim") == dim).select("form", "wide").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    moment = np.zeros(dim * dim)
    moment[sums["i"].to_numpy(np.int64)] = sums["s"].to_numpy()
    values, vectors = np.linalg.eigh(moment.reshape(dim, dim))
    held = np.cumsum(np.maximum(values[::-1], 0.0))
    return vectors[:, ::-1].copy(), sorted({min(dim, int(np.searchsorted(held, held[-1] * s)) + 1) for s in STAGES})


class Side:
    """A block's vectors in whole numbers and rotated, with the norms of what follows each stage."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray | None = None, ends: list[int] | None = None):
        self.whole = whole
        self.turned = whole @ turn if turn is not None else whole
        d = whole.shape[1]
        self.most = np.abs(whole).max(initial=1.0)
        self.ints = whole.astype(np.int64) if self.most < 2**31 else None
        self.ends = ends or sorted({max(1, round(d * s)) for s in STAGES if d})
        with np.errstate(over="ignore"):
            # norms of the rest, raised by what rounding may have taken away
            self.rest = [np.sqrt(np.square(self.turned[:, m:]).sum(axis=1)) for m in self.ends]
            self.norm = np.sqrt(np.square(whole).sum(axis=1))


def exact(a: Side, i: int, v: Side, at: np.ndarray) -> np.ndarray:
    """Integer products of anchor i with rows ``at``, within the range of 64 bits; where these may not hold them, through Python's integers."""
    if a.ints is not None and v.ints is not None and a.most * v.most * a.whole.shape[1] < WIDE:
        return v.ints[at] @ a.ints[i]
    whole = [int(x) for x in a.whole[i]]
    return np.array([min(max(sum(p * int(q) for p, q in zip(whole, row)), LONG[0]), LONG[1]) for row in v.whole[at]], np.int64)


def surviving(a: Side, v: Side, keeps) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, exact scores) after all stages; ``keeps(i, at, low, high)`` says which rows ``at`` of anchor i the bounds leave."""
    for lo in range(0, len(a.whole), CHUNK):
        first = a.ends[0] if a.ends else 0
        with np.errstate(over="ignore", invalid="ignore"):
            part = a.turned[lo : lo + CHUNK, :first] @ v.turned[:, :first].T
        for i in range(lo, min(lo + CHUNK, len(a.whole))):
            at, sums = np.arange(len(v.whole)), part[i - lo]
            for k, end in enumerate(a.ends):
                with np.errstate(over="ignore", invalid="ignore"):
                    if k:
                        sums = sums + v.turned[at, a.ends[k - 1] : end] @ a.turned[i, a.ends[k - 1] : end]
                    slack = (a.rest[k][i] * v.rest[k][at]) * (1 + SLACK) + SLACK * a.norm[i] * v.norm[at]
                    low, high = sums - slack, sums + slack
                wild = ~(np.isfinite(low) & np.isfinite(high))
                low[wild], high[wild] = -np.inf, np.inf
                low, high = np.clip(low, -np.inf, 2.0**63), np.clip(high, -(2.0**63), np.inf)
                left = keeps(i, at, low, high)
                at, sums = at[left], sums[left]
            if not a.ends:
                at = at[keeps(i, at, np.zeros(len(at)), np.zeros(len(at)))]
            yield i, at, exact(a, i, v, at)


def at_least(low: np.ndarray, k: int) -> float:
    """The k-th largest of ``low``, or less than all if there are fewer."""
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    return np.lexsort((ids, ~scores))[:k]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, scale: int = 256, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` holds vec_id, label and embedding.  Each anchor's positives are the ``positives`` best rows of its label; a positive's negatives the
    ``negatives`` best rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding"), scale)).distinct()
    rows = rows.select(F.monotonically_increasing_id().alias("at"), "vec_id", "label", "embedding", F.size("embedding").alias("dim"), "anchor")
    rows = materialise(_forms(rows, scale), "whole")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 0
    turn = spark.sparkContext.broadcast((dim, *(rotation(rows, dim) if 0 < dim <= MOST_DIM else (None, None))))
    n, n_anchors = rows.count(), rows.where("anchor").count()
    q_blocks, v_blocks = -(-n_anchors // QUERY_BLOCK) or 1, -(-n // VECTOR_BLOCK) or 1
    block = F.xxhash64("vec_id", "at")
    right = rows.withColumn("vb", F.pmod(block, F.lit(v_blocks))).withColumn("qb", F.explode(F.expr(f"sequence(0L, {q_blocks - 1}L)")))

    def left(anchors: DataFrame) -> DataFrame:
        return anchors.withColumn("qb", F.pmod(block, F.lit(q_blocks))).withColumn("vb", F.explode(F.expr(f"sequence(0L, {v_blocks - 1}L)")))

    def tiles(anchors: DataFrame, work, kind: str) -> DataFrame:
        sides = [df.select([F.col(c).alias(f"{name}_{c}") for c in df.columns]).groupBy(f"{name}_dim", f"{name}_qb", f"{name}_vb") for name, df in (("a", left(anchors)), ("v", right))]
        return sides[0].cogroup(sides[1]).applyInArrow(lambda a, v: work(*(t.rename_columns([c[2:] for c in t.column_names]) for t in (a, v))), kind)

    def side(t: pa.Table) -> Side:
        own = t["dim"][0].as_py()
        fitted, *how = turn.value
        return Side(_matrix(t["form"].to_pylist(), t["wide"].to_pylist(), own), *(how if own == fitted else ()))

    def codes(a: pa.Table, v: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        seen: dict = {}
        return tuple(np.array([seen.setdefault(x, len(seen)) for x in t["label"].to_pylist()], int) for t in (a, v))

    best_kind = "q_at long, anchor_id long, positive_id long, positive_score long"

    def near(a: pa.Table, v: pa.Table) -> pa.Table:
        out: list = []
        if len(a) and len(v):
            (la, lv), ids = codes(a, v), v["vec_id"].to_numpy()
            qid, q_at = a["vec_id"].to_numpy(), a["at"].to_numpy()

            def keeps(i, at, low, high):
                mine = (lv[at] == la[i]) & (ids[at] != qid[i])
                return mine & (high >= at_least(low[mine], positives))

            for i, at, scores in surviving(side(a), side(v), keeps):
                top = best(scores, ids[at], positives)
                out += [(q_at[i], qid[i], j, s) for j, s in zip(ids[at][top], scores[top])]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["q_at", "anchor_id", "positive_id", "positive_score"])

    lists = tiles(rows.where("anchor"), near, best_kind)
    rank = F.row_number().over(Window.partitionBy("q_at").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = lists.withColumn("_n", rank).where(F.col("_n") <= positives)
    chosen = materialise(chosen.groupBy("q_at").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pos")), "positives")
    armed = rows.where("anchor").join(chosen.withColumnRenamed("q_at", "at"), "at")
    found_kind = "q_at long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def hard(a: pa.Table, v: pa.Table) -> pa.Table:
        out: list = []
        if len(a) and len(v):
            (la, lv), ids = codes(a, v), v["vec_id"].to_numpy()
            qid, q_at, pos = a["vec_id"].to_numpy(), a["at"].to_numpy(), a["pos"].to_pylist()

            def keeps(i, at, lows, highs):
                other, some = (lv[at] != la[i]) & (ids[at] != qid[i]), np.zeros(len(at), bool)
                for score in {p["positive_score"] for p in pos[i]}:
                    least, most = score * (low / 100) - 1, score * (high / 100) + 1
                    may = other & (highs >= least) & (lows <= most)
                    sure = other & (lows >= least + 2) & (highs <= most - 2)
                    some |= may & (highs >= at_least(lows[sure], negatives))
                return some

            for i, at, scores in surviving(side(a), side(v), keeps):
                # a hundred times a score must fit
                whole = scores if -(2**56) < scores.min(initial=0) and scores.max(initial=0) < 2**56 else scores.astype(object)
                for p in pos[i]:
                    score = p["positive_score"]
                    inside = np.flatnonzero((100 * whole >= low * score) & (100 * whole <= high * score)) if len(whole) and score >= 0 else np.zeros(0, int)
                    top = inside[best(scores[inside], ids[at][inside], negatives)]
                    out += [(q_at[i], qid[i], p["positive_id"], score, j, s) for j, s in zip(ids[at][top], scores[top])]
        cols = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in found_kind.split(", ")])

    found = tiles(armed, hard, found_kind)
    rank = F.row_number().over(Window.partitionBy("q_at", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
