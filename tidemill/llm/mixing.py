"""Mixing sources to target weights with a low-discrepancy schedule.

1. Every document gets a size in words; every source a total and, by water-filling, a target.
2. Inside a source the documents are shuffled by a seeded digest and laid end to end; the resulting stream of
   words is cut into blocks of equal length.  Offsets come from a two-level prefix sum (digest range, then rows
   of one range), so a source with a third of all rows is still spread over many tasks.
3. A golden-ratio sequence of points in [0, 1) is mapped through the cumulative shares of the sources: point n
   says which source slot n draws from, so that every stretch of the mix is near its shares.  The rank of a slot among its source's slots says which block it takes,
   going round the stream again once all blocks are used.
4. Slots join blocks, blocks join the pieces of documents in them.

Nulls, ties and repeats: a null text has size 0, a null source is a source of its own that sorts last, a null
``doc_id`` hashes as the empty string, beside the text.  Repeated rows are separate rows of the stream.  Documents of size 0 are
returned with nothing taken.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: floor(2**40 / golden ratio), made odd: multiples of it modulo 2**40 are the golden-ratio sequence, which repeats after 2**40 slots.
GOLDEN_BITS, GOLDEN = 40, 679535556991
CHUNK = 1 << 16


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per source: sid, source, n, source_size, target.

    ``share`` of all words is split by weight; no target passes ``limit`` times its source's size, and what a
    capped source leaves is split again among the others.  In order of cap by weight the capped sources come
    first, so the level at which the rest fill is found with two running sums.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("sid", F.row_number().over(by_name)).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - before) / rest)
    t = t.withColumn("fill", F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(every))
    return t.select("sid", "source", "n", "source_size", F.coalesce(F.least(F.col("cap"), F.col("fill") * F.col("w")), F.col("cap")).alias("target"))


def laid_out(sizes: DataFrame, sources: DataFrame, rows_per_range: int = 4096) -> DataFrame:
    """``sizes`` (with ``key``, a hex digest) with sid and start, the offset of each row in its source's shuffled stream."""
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranges = F.least(F.ceil(F.col("n") / F.lit(rows_per_range)), F.lit(1 << 20)).cast("long")
    src = sources.select("sid", F.col("source").alias("_s"), "n")
    rows = sizes.join(src, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rng", F.floor(place * ranges / F.lit(float(1 << 32))).cast("long")).drop("_s", "n")
    in_source = Window.partitionBy("sid").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("sid", "rng").agg(F.sum("size").alias("_z")).select("sid", "rng", F.coalesce(F.sum("_z").over(in_source), F.lit(0)).alias("base"))
    in_range = Window.partitionBy("sid", "rng").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_b", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    return rows.join(bases, ["sid", "rng"]).withColumn("start", F.col("base") + F.col("_b")).drop("_b", "base", "rng")


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """The slots of the mix in order: slot, sid, epoch, block, take (words taken from the front of the block)."""
    spark = sources.sparkSession
    b = F.lit(block_words)
    s = sources.where(F.col("source_size") > 0).withColumn("want", F.floor(F.col("target") + F.lit(0.5)).cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / b).cast("long"))
    s = s.withColumn("rounds", F.expr("want div source_size")).withColumn("rest", F.expr("want % source_size"))
    s = s.withColumn("need", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long"))
    s = s.withColumn("hi", F.sum("need").over(Window.orderBy("sid"))).withColumn("lo", F.col("hi") - F.col("need"))
    s = materialise(s.select("sid", "source_size", "blocks", "rounds", "rest", "need", "lo", "hi"), "mix-needs")
    slots, n_sources = s.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    bins = max(1024, n_sources)
    total = F.lit(float(max(slots, 1)))
    n = F.col("slot")
    # slot * GOLDEN modulo 2**40, in two halves so that no product passes 2**63
    half, all_bits = (1 << GOLDEN_BITS // 2) - 1, (1 << GOLDEN_BITS) - 1
    low = n.bitwiseAND(F.lit(half)) * F.lit(GOLDEN)
    high = F.shiftleft((F.shiftright(n, GOLDEN_BITS // 2).bitwiseAND(F.lit(half)) * F.lit(GOLDEN)).bitwiseAND(F.lit(half)), GOLDEN_BITS // 2)
    point = (low.bitwiseAND(F.lit(all_bits)) + high).bitwiseAND(F.lit(all_bits)) / F.lit(float(1 << GOLDEN_BITS)) * total
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", point)
    points = points.withColumn("bin", F.floor(F.col("x") / total * bins).cast("long"))
    spans = s.where("need > 0").select("sid", "need", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / total * bins).cast("long"), F.least(F.floor(F.col("hi") / total * bins).cast("long"), F.lit(bins - 1)))).alias("bin"))
    hit = points.join(spans, "bin").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "sid", "need", F.expr(f"slot div {CHUNK}").alias("chunk"))
    so_far = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = hit.groupBy("sid", "chunk").agg(F.count("*").alias("_n"))
    bases = per_chunk.select("sid", "chunk", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("base"))
    here = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("_r", here).join(bases, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("_r")).alias("rank"), "need")
    ranked = ranked.where(F.col("rank") < F.col("need")).select("slot", "sid", "rank")
    # the sequence may leave a source a few slots short; they follow at the end
    drawn = per_chunk.groupBy("sid").agg(F.sum("_n").alias("got"))
    short = s.join(drawn, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    short = short.select("sid", "lo", F.explode(F.expr("sequence(got, need - 1)")).alias("rank")).select((F.lit(slots) + F.col("lo") + F.col("rank")).alias("slot"), "sid", "rank")
    out = ranked.unionByName(short).join(s.drop("lo", "hi", "need"), "sid")
    out = out.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    left = F.when(F.col("epoch") < F.col("rounds"), F.col("source_size")).otherwise(F.col("rest")) - F.col("block") * b
    return out.select("slot", "sid", "epoch", "block", F.least(b, left).alias("take"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0, block_words: int = 4096, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, slots, sources) of the mix of ``docs`` (doc_id, text, source).

    ``rows``: doc_id, source, size, sid, start, taken, first_slot (the first slot that takes words of it, null if none does); ``slots``: see :func:`schedule`; ``sources``: see
    :func:`source_targets`.  A reader of the mix takes the slots in order and, for each, words
    [block * block_words, block * block_words + take) of the source's stream.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    sizes = materialise(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), key.alias("key")), "mix-sizes")
    sources = materialise(source_targets(sizes, weights, share, limit), "mix-sources")
    rows = materialise(laid_out(sizes, sources), "mix-rows")
    slots = materialise(schedule(sources, block_words), "mix-slots")
    b = block_words
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
    takes = slots.groupBy("sid", "block", "take").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("take")) - F.greatest(F.col("start"), F.col("block") * b))
    words = overlap * F.coalesce("times", F.lit(0))
    drawn = pieces.join(takes, ["sid", "block"], "left").groupBy("sid", "start", "doc_id", "source", "size").agg(F.sum(F.coalesce(words, F.lit(0))).cast("long").alias("taken"), F.min(F.when(overlap > 0, F.col("slot"))).alias("first_slot"))
    empty = rows.where("size = 0").select("sid", "start", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return drawn.unionByName(empty), slots, sources
