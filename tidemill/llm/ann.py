"""Nearest neighbours of a query set by inner product: a block matrix join on int8 tiles with exact bounds.

Every vector is rounded to int8 once, against its largest component, and goes on with that form, its scale, and the
norms of the rounded vector and of what rounding took away.  Queries and vectors are cut into blocks of bounded size,
and each pair of blocks is one tile, to which only the int8 forms travel.  A tile's product gives each pair's nearness
with bounds: a candidate whose upper bound lies under the k-th best lower bound, of its tile and then of all tiles, is
surely out.  Heaps merge the tiles' lists, first within groups of tiles, then over all of them.  The few pairs that
survive are recomputed from the original components in double precision, and a last heap ranks them.  No neighbour is
lost: recall is 1.  Of equal vectors only the k + 1 with the least ids can be among k neighbours, so only they are
candidates, and a vector that a third of all rows share costs no more than that.

Nulls, ties and repeats: vectors that are null, empty, zero or hold a null or non-finite component take no
part, neither as query nor as candidate; vectors of other lengths are not compared.  Equal scores go to the
smaller ``vec_id``.  Rows that repeat a ``vec_id`` and its vector count once; other rows with a query's own id
are not its neighbours.  A null ``vec_id`` takes no part.  Pairs whose product may leave the range of doubles are not
bounded but recomputed; a product that is no number ranks last.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.scratch import materialise

#: Rows of a block of queries and of a block of vectors; a tile holds four matrices of doubles of their product at a time, 64 MB, beside its rows.
QUERY_BLOCK, VECTOR_BLOCK = 256, 8192
#: float32 sums of int8 products are exact up to this many components.
EXACT = 1024
#: Tiles of one query whose lists are merged in the first step.
MERGE = 64
#: Products of two scales within these can be bounded in doubles.
LEAST, MOST = 1e-290, 1e290

FORM = "`at` long, vec_id long, dim int, form binary, scale double, norm double, lost double"
PAIR = "query_id long, q_at long, v_at long, low double, high double"


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def rounded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as (int8 form, scale, norm of the rounded row, norm of what rounding took away), norms in units of the scale; the scale is the largest component."""
    scale = np.abs(m).max(axis=1)
    unit = m / scale[:, None]
    form = np.rint(unit * 127).astype(np.int8)
    back = form / 127.0
    return form, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def bounds(q: tuple, v: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): what the inner products of rounded queries and vectors surely lie between."""
    (q8, qs, qn, qe), (v8, vs, vn, ve) = q, v
    near = np.zeros((len(q8), len(v8)))
    for d in range(0, q8.shape[1], EXACT):
        near += q8[:, d : d + EXACT].astype(np.float32) @ v8[:, d : d + EXACT].astype(np.float32).T
    near /= 127.0**2
    # |q.v - q'.v'| <= |q'||ev| + |eq||v'| + |eq||ev|, with room for the rounding of doubles
    slack = (qe * (1 + 1e-9))[:, None] * (vn + ve)
    slack += (qn * (1 + 1e-9))[:, None] * ve
    slack += (1e-12 * (qn + qe))[:, None] * (vn + ve)
    low, high = near - slack, near
    high += slack
    with np.errstate(over="ignore", under="ignore"):
        scale = np.multiply(qs[:, None], vs, out=slack)
        low *= scale
        high *= scale
        wild = (scale < LEAST) | (scale > MOST / q8.shape[1])
    low[wild], high[wild] = -np.inf, np.inf
    return low, high


def survivors(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which of a query's candidates may be among its ``k`` nearest."""
    return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)


def _forms(rows: DataFrame) -> DataFrame:
    """``rows`` (at, vec_id, embedding, dim) with the int8 form instead of the components."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat, ends = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                form, scale, norm, lost = rounded(flat[(ends[at] - d)[:, None] + np.arange(d)])
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("vec_id"), part.column("dim"), pa.array([r.tobytes() for r in form], pa.binary()), pa.array(scale), pa.array(norm), pa.array(lost)], ["at", "vec_id", "dim", "form", "scale", "norm", "lost"])

    return rows.select("at", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "dim").mapInArrow(run, FORM)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``vectors`` (vec_id, embedding) for the rows that ``is_query`` picks."""
    rows = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select("vec_id", "embedding", is_query.alias("q"), F.size("embedding").alias("dim")).distinct()
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "vectors")
    least = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    cands = materialise(_forms(rows.withColumn("_n", least).where(F.col("_n") <= k + 1)), "candidates")
    queries = materialise(_forms(rows.where("q")), "queries")
    n, n_queries = cands.count(), queries.count()
    q_blocks, v_blocks = -(-n_queries // QUERY_BLOCK) or 1, -(-n // VECTOR_BLOCK) or 1
    block = F.xxhash64("vec_id", "at")
    mine = queries.withColumn("qb", F.pmod(block, F.lit(q_blocks))).withColumn("vb", F.explode(F.expr(f"sequence(0L, {v_blocks - 1}L)")))
    all_rows = cands.withColumn("vb", F.pmod(block, F.lit(v_blocks))).withColumn("qb", F.explode(F.expr(f"sequence(0L, {q_blocks - 1}L)")))

    def forms(table: pa.Table, side: str) -> tuple:
        form = np.frombuffer(b"".join(table[f"{side}_form"].to_pylist()), np.int8).reshape(len(table), -1)
        return form, *(table[f"{side}_{c}"].to_numpy() for c in ("scale", "norm", "lost"))

    def pairs(parts: list) -> pa.Table:
        names = [(c.split()[0].strip("`"), np.int64 if c.endswith("long") else np.float64) for c in PAIR.split(", ")]
        return pa.table({name: np.concatenate([p[i] for p in parts]).astype(t) if parts else np.zeros(0, t) for i, (name, t) in enumerate(names)})

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            low, high = bounds(forms(left, "q"), forms(right, "v"))
            vid, v_at = right["v_vec_id"].to_numpy(), right["v_at"].to_numpy()
            for i, (qid, q_at) in enumerate(zip(left["q_vec_id"].to_pylist(), left["q_at"].to_pylist())):
                other = np.flatnonzero(vid != qid)
                other = other[survivors(low[i, other], high[i, other], k)]
                parts.append((np.full(len(other), qid), np.full(len(other), q_at), v_at[other], low[i, other], high[i, other]))
        return pairs(parts)

    def merge(table: pa.Table) -> pa.Table:
        low = table["low"].to_numpy()
        least = min(heapq.nlargest(k, low.tolist()), default=0.0) if len(low) > k else -np.inf
        return table.filter(pa.array(table["high"].to_numpy() >= least))

    def heap(table: pa.Table) -> pa.Table:
        found = list(dict.fromkeys(zip(table["vec_id"].to_pylist(), table["score"].to_pylist())))
        top = heapq.nsmallest(k, found, key=lambda x: (x[1] != x[1], -x[1], x[0]))
        query = table["query_id"][0].as_py() if len(table) else 0
        return pa.table({"query_id": pa.array([query] * len(top), pa.int64()), "rank": pa.array(range(1, len(top) + 1), pa.int32()), "vec_id": pa.array([x[0] for x in top], pa.int64()), "score": pa.array([x[1] for x in top], pa.float64())})

    cells = [df.select([F.col(c).alias(f"{name}_{c}") for c in ("dim", "qb", "vb", "vec_id", "at", "form", "scale", "norm", "lost")]).groupBy(f"{name}_dim", f"{name}_qb", f"{name}_vb") for name, df in (("q", mine), ("v", all_rows))]
    lists = cells[0].cogroup(cells[1]).applyInArrow(tile, PAIR)
    if v_blocks > MERGE:
        lists = lists.groupBy("q_at", F.pmod(F.xxhash64("v_at"), F.lit(-(-v_blocks // MERGE)))).applyInArrow(lambda key, t: merge(t), PAIR)
    left = materialise(lists.groupBy("q_at").applyInArrow(merge, PAIR), "survivors").select("query_id", "q_at", "v_at")
    one, two = (rows.select(F.col("at").alias(a), F.col("embedding").alias(e), *more) for a, e, more in (("q_at", "_q", []), ("v_at", "_v", ["vec_id"])))
    product = F.aggregate(F.zip_with("_q", "_v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    exact = left.join(two, "v_at").join(one, "q_at").select("query_id", F.col("vec_id").cast("long").alias("vec_id"), product.alias("score"))
    return exact.groupBy("query_id").applyInArrow(heap, "query_id long, rank int, vec_id long, score double")
