"""Connected components of an edge table by contraction, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.scratch import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every vertex of ``edges`` (a, b: long); label is the least id of its component.

    Each round points every vertex at its least neighbour, follows the pointers twice, and contracts the edges, until
    none is left; at least half of the vertices that still have edges go each round.  The pointers of the rounds are
    written, and followed one after another at the end.  Loops (a = b) and rows with a null name no vertex.
    """
    real = edges.where("a <> b").select("a", "b")
    left = materialise(real.union(real.select("b", "a")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        up = left.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        twice = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.a"), "left").select(F.col("x.a").alias("v"), F.coalesce("y.p", "x.p").alias("p"))
        twice = materialise(twice, "pointers")
        rounds.append(twice)
        before = left
        left = left.join(twice.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(twice.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        left = materialise(left.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        discard(before)
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("label"))
    names = rounds[0].select(F.col("v").alias("id"), F.col("p").alias("label"))
    for later in rounds[1:]:
        names = names.join(later, F.col("label") == F.col("v"), "left").select("id", F.coalesce("p", "label").alias("label"))
    out = materialise(names, "components")
    discard(left, *rounds)
    return out
