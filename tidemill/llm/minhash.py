"""Near-duplicates by circulant MinHash: banded candidates, exact Jaccard links, connected components.

A document's set is its distinct word shingles.  Two permutations make the whole signature: the first scatters
the shingles over 2**32 places, the second is shifted circularly by k for coordinate k, and the coordinate is
the least value of the shifted permutation over the set.  Bands of four coordinates put documents in buckets.

Documents with equal sets are one class throughout, so copies cost one row.  Each class is first held against
the least class of its likeliest bucket, which joins most of a group of near copies in one exact test per class.
What is still apart though it shares a bucket is compared inside that bucket, in tiles of two blocks of bounded
size: first by sketches, then, for the rows that have a likely partner there, by full sets.  A pair that shares
several buckets is compared in the first of them only, and pairs that are already in one component not at all.
Tasks compare many pairs but hand on only what connects: a tile gives a spanning forest of its links.  No bucket
is capped, no bucket is listed as all its pairs, and rows of a large bucket are not shuffled by it.
A pair is set aside without the exact test only if set sizes rule it out or 128 coordinates agree so rarely that
a Jaccard of 0.75 would show it once in about a million pairs.

Nulls, ties and repeats: a null or blank text has an empty set and is linked with nothing; equal texts are
linked; rows with equal ids are separate rows; ``component_id`` is the least non-null id reachable, null where all
are null.  An empty table gives an empty result.  Extra columns of the input are ignored by :func:`near_duplicates`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textbytes
from tidemill.operators.components import components
from tidemill.scratch import materialise

COORDINATES, BAND = 128, 4
#: Of 128 agreeing coordinates, 96 are expected at Jaccard 0.75 with a deviation of 4.9.
AGREE = 72
#: Most rows and shingles of a block; a tile is two blocks of one bucket.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Most candidate classes whose ids are sent to every executor (at most 40 MB); more are joined by shuffle.
SEND_ROWS = 500_000
#: A bucket of more classes is large: what is known of it goes to its rows, which stay where they are.
LARGE = 1024


def _scatter32(x: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The circulant signature: least shifted-permutation value of the set, for each of the shifts."""
    places = _scatter32((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(COORDINATES, dtype=np.uint32)[:, None]
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 1024):
        np.minimum(least, _scatter32(places[None, i : i + 1024] + shifts).min(axis=1), out=least)
    return least


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return b"".join((textbytes.mix64(shingles ^ c).sum(dtype=np.uint64) + np.uint64(len(shingles))).tobytes() for c in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)))


def text_mark(text: str = "text") -> Column:
    """The hash of a text by which rows that share an id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, mark (of its text), n_shingles, set_key, bands (array of bucket keys), sketch (low bytes of the signature), per row of ``docs``."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, keys, bands, sketches = [], [], [], []
            for s in textbytes.shingle_sets(batch.column("text"), width):
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), sketches.append(None)
                    continue
                sig = signature(s)
                keys.append(set_key(s))
                sketches.append(sig.astype(np.uint8).tobytes())
                rows = sig.reshape(-1, BAND).astype(np.uint64)
                h = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
                for k in range(BAND):
                    h = textbytes.mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
                bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "mark", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select("doc_id", "text", text_mark().alias("mark")).mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, want: DataFrame, width: int) -> DataFrame:
    """(nid, shingles) for the classes of ``want`` (nid, set_key, doc_id, mark), from the text of one of their documents; other texts of that id are not read."""

    def run(batches):
        for batch in batches:
            sets = list(textbytes.shingle_sets(batch.column("text"), width))
            same = [len(s) > 0 and set_key(s) == k for s, k in zip(sets, batch.column("set_key").to_pylist())]
            flat = pa.array([s.view(np.int64) for s, ok in zip(sets, same) if ok], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("nid").filter(pa.array(same, pa.bool_())), flat], ["nid", "shingles"])

    want = materialise(want.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), "wanted")
    if want.count() <= SEND_ROWS:
        want = F.broadcast(want)
    rows = docs.select("doc_id", "text", text_mark().alias("mark")).join(want, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("nid", "set_key", "text")
    return rows.mapInArrow(run, "nid long, shingles array<long>").dropDuplicates(["nid"])


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``est``, their agreeing coordinates, without those that cannot or hardly can be linked."""

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("ka").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            y = np.frombuffer(b"".join(batch.column("kb").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            est = (x == y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est, pa.int32())], ["a", "b", "est"]).filter(pa.array(est >= AGREE))

    a = nodes.select(F.col("nid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka"))
    b = nodes.select(F.col("nid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb"))
    close = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    return pairs.join(a, "a").join(b, "b").where(close).select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long, est int")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, …) whose ``sets`` are similar enough, by exact Jaccard."""
    a = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("_sa"))
    b = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    near = F.lit(100) * both >= F.lit(percent) * (F.size("_sa") + F.size("_sb") - both)
    return pairs.join(a, "a").join(b, "b").where(near).select(pairs.columns)


class _Union:
    """Joins of small integers; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            self.up[x] = self.up[y]
            x = y

    def join(self, a: int, b: int) -> bool:
        a, b = (int(self.roots(np.array([v]))[0]) for v in (a, b))
        self.up[max(a, b)] = min(a, b)
        return a != b


def _numbered(label: np.ndarray) -> tuple[np.ndarray, int]:
    names, number = np.unique(label, return_inverse=True)
    return number, len(names)


def _tile_rows(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, right if len(right) else left


def _pair_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])


def _partners(table: pa.Table, percent: int):
    """Of a tile (bk, side, nid, label, n_shingles, sketch, bands): each row with the rows it may be linked with, if this is the first bucket they share."""
    side, n = (table.column(c).to_numpy() for c in ("side", "n_shingles"))
    bk = table.column("bk")[0].as_py() if len(table) else 0
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    left, right = _tile_rows(side)
    label = table.column("label").to_numpy()
    for i in left:
        js = right[(label[right] != label[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        js = js[(sketch[js] == sketch[i]).sum(axis=1) >= AGREE]
        if len(js):
            shared = bands[js] == bands[i]
            yield i, js[bands[js, shared.argmax(axis=1)] == bk]


def _suspects(percent: int):
    """The rows of a tile that have a likely partner in it."""

    def run(table: pa.Table) -> pa.Table:
        has = np.zeros(len(table), bool)
        for i, js in _partners(table, percent):
            has[js] = True
            has[i] |= len(js) > 0
        return table.filter(pa.array(has))

    return run


def _link_forest(percent: int):
    """Of a tile of suspects with their ``shingles``: links that connect its components, found by exact Jaccard, as pairs of labels."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("label").to_numpy()
        label, n_labels = _numbered(names)
        lists = table.column("shingles").combine_chunks()
        flat, at = lists.flatten().to_numpy(), np.r_[0, np.cumsum(pa.compute.list_value_length(lists).to_numpy())]
        flat, n_flat = _numbered(flat)
        size = np.diff(at)
        joined, out = _Union(n_labels), []
        mark = np.zeros(n_flat, bool)
        for i, js in _partners(table, percent):
            js = js[joined.roots(label[js]) != joined.roots(label[[i]])[0]]
            if not len(js):
                continue
            mine = flat[at[i] : at[i + 1]]
            mark[mine] = True
            if len(js) > 16:
                both = np.add.reduceat(mark[flat].astype(np.int64), at[:-1])[js]
            else:
                both = np.array([np.count_nonzero(mark[flat[at[j] : at[j + 1]]]) for j in js])
            mark[mine] = False
            for j in js[100 * both >= percent * (size[js] + size[i] - both)]:
                if joined.join(label[i], label[j]):
                    out.append((names[i], names[j]))
        return _pair_table(out)

    return run


def _by_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` (bk, …) with the columns of ``facts`` (a row per bk, with its count m); rows of large buckets are not shuffled by bk."""
    large = facts.where(F.col("m") > LARGE)
    if not 0 < large.limit(SEND_ROWS + 1).count() <= SEND_ROWS:
        return rows.join(facts, "bk")
    small = rows.join(F.broadcast(large.select("bk")), "bk", "left_anti").join(facts.where(F.col("m") <= LARGE), "bk")
    return small.unionByName(rows.join(F.broadcast(large), "bk"))


def _blocks(named: DataFrame) -> DataFrame:
    """bk, m and blocks (own, at) of the buckets of ``named`` (bk, nid, label, n_shingles) that hold several labels.

    Blocks are bounded by rows and shingles.  A label with half a block or more has blocks of its own, which never meet
    each other; the small labels share pooled blocks (own is -1), each label in one of them.
    """
    sizes = named.groupBy("bk", "label").agg(F.count("*").alias("c"), F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)).alias("n"))
    own = F.col("n") * 2 >= 1
    facts = sizes.groupBy("bk").agg(
        F.sum("c").alias("m"), F.count("*").alias("labels"),
        F.ceil(F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0.0))).alias("pool"),
        F.collect_list(F.when(own, F.struct(F.col("label").alias("own"), F.ceil("n").alias("n")))).alias("big"),
    )
    pooled = "if(pool > 0, transform(sequence(0L, pool - 1), at -> named_struct('own', -1L, 'at', at)), array())"
    owned = "flatten(transform(big, x -> transform(sequence(0L, x.n - 1), at -> named_struct('own', x.own, 'at', at))))"
    return facts.where("labels > 1").select("bk", "m", F.expr(f"concat({pooled}, {owned})").alias("blocks"))


def _tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (bk, nid, label, blocks, …) dealt to tiles (bk, i, j, side) that hold each pair of rows of a bucket with different labels together in one tile."""
    owns = F.expr("size(filter(blocks, x -> x.own = label))")
    pool = F.expr("size(filter(blocks, x -> x.own = -1))")
    mine = F.when(owns > 0, F.struct(F.col("label").alias("own"), F.pmod(F.xxhash64("nid"), F.greatest(owns, F.lit(1))).alias("at"))).otherwise(F.struct(F.lit(-1).cast("long").alias("own"), F.pmod(F.xxhash64("label"), F.greatest(pool, F.lit(1))).alias("at")))
    met = rows.withColumn("block", mine).withColumn("other", F.explode(F.expr("filter(blocks, x -> x.own <> block.own OR x.own = -1)"))).drop("blocks")
    name = lambda c: F.concat_ws(":", f"{c}.own", f"{c}.at")
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    return met.withColumn("i", name("i")).withColumn("j", name("j")).drop("block", "other")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, mark (of its text), n_shingles, component_id, kept and component (a number of the group, null for empty sets) for every row of ``docs`` (doc_id, text)."""
    prints = materialise(fingerprints(docs, width), "prints")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("one")
    nodes = prints.where("n_shingles > 0").groupBy("set_key", "n_shingles", "sketch", "bands").agg(one).select("set_key", "n_shingles", "sketch", "bands", "one.doc_id", "one.mark")
    nodes = materialise(nodes.withColumn("nid", F.monotonically_increasing_id()), "classes")
    small = nodes.select("nid", "n_shingles", "sketch")
    rows = nodes.select("nid", "n_shingles", F.explode("bands").alias("bk"))
    shared = materialise(rows.groupBy("bk").agg(F.min("nid").alias("rep"), F.count("*").alias("m")).where("m > 1"), "buckets")
    members = materialise(_by_bucket(rows, shared), "members")

    # one exact test per class: against the likeliest of its buckets' least classes
    star = members.where("nid <> rep").select(F.col("rep").alias("a"), F.col("nid").alias("b")).distinct()
    star = materialise(_likely(star, small, percent), "likely")
    best = materialise(star.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).select("m.a", "b"), "best")
    named_sets = lambda ids: materialise(_sets(docs, nodes.select("nid", "set_key", "doc_id", "mark").join(ids, "nid"), width), "sets")
    ends = lambda pairs: pairs.select(F.col("a").alias("nid")).union(pairs.select("b"))
    sets = named_sets(ends(best).distinct())
    labels = components(_linked(best, sets, percent)).withColumnRenamed("id", "nid")

    # buckets of three and more that still hold different components, and their other least classes
    named = members.where("m > 2").select("bk", "nid", "n_shingles").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    named = materialise(named, "named")
    blocks = materialise(_blocks(named), "blocks")
    open_rows = materialise(_by_bucket(named, blocks).drop("m").join(nodes.select("nid", "sketch", "bands"), "nid"), "open")
    tile = "bk long, i string, j string, side int, nid long, label long, n_shingles long, sketch binary, bands array<long>"
    columns = [c.split()[0] for c in tile.split(", ")]
    suspects = materialise(_tiles(open_rows).select(columns).groupBy("bk", "i", "j").applyInArrow(_suspects(percent), tile), "suspects")
    side = lambda x: labels.select(F.col("nid").alias(x), F.col("label").alias(f"l{x}"))
    stars = star.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b")).where("la <> lb")
    stars = materialise(stars, "stars")
    rest = suspects.select("nid").union(ends(stars)).distinct().join(sets.select("nid"), "nid", "left_anti")
    sets = sets.unionByName(named_sets(rest))
    found = suspects.join(sets, "nid").groupBy("bk", "i", "j").applyInArrow(_link_forest(percent), "a long, b long")
    joined = components(found.unionByName(_linked(stars, sets, percent).select(F.col("la").alias("a"), F.col("lb").alias("b"))))

    named = nodes.select("nid", "set_key", "doc_id").join(labels, "nid", "left").withColumn("_l", F.coalesce("label", "nid")).drop("label")
    named = named.join(joined.select(F.col("id").alias("_i"), F.col("label").alias("_j")), F.col("_l") == F.col("_i"), "left").withColumn("component", F.coalesce("_j", "_l"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = materialise(named.join(least, "component").select(F.col("set_key").alias("_k"), "component", "component_id"), "of-class")
    out = prints.select("doc_id", "mark", "n_shingles", "set_key").join(of_class, F.col("set_key") == F.col("_k"), "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), "component").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates: that with the least id (nulls last), then the least hash of its text.

    Texts without words are in no group and stay.  A kept row is known by its id and a hash of its text, so a row that
    repeats both goes too.
    """
    named = near_duplicates(docs.select("doc_id", "text"), width, percent)
    cells = materialise(named.groupBy("doc_id", "mark").agg(F.max("component").alias("component"), F.count("*").alias("n")), "cells")
    first = cells.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")).alias("m")).select("m.doc_id", "m.mark", "m.n")
    kept = materialise(first.unionByName(cells.where("component IS NULL").drop("component")).withColumnRenamed("doc_id", "id"), "kept")
    out = docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.id")) & (text_mark("d.text") == F.col("k.mark")), "left_semi")
    if not kept.where("n > 1").isEmpty():
        mark = "mark " * (1 + max(map(len, docs.columns)))
        out = out.withColumn(mark, text_mark()).dropDuplicates(["doc_id", mark]).drop(mark)
    return out
