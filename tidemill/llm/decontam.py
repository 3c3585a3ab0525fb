"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become arrays of token hashes (lower-cased runs of letters, marks and digits).  A mask picks some of the
tokens of a span and ignores the rest; equal hashes under a mask are a hit, which fixes how a benchmark text
would lie over the document.  The two masks are chosen so that any 16 tokens of which at least 13 agree hold a
hit of one of them, and so for items of 13 to 15 tokens; items of 8 to 12 tokens have a shorter mask that any of
their allowed patterns holds, and items of fewer are hashed whole.  Only masks that the benchmark has items for are
laid over the documents.  Around each hit the two texts are then compared token by token: a document is
contaminated by an item if, somewhere along that alignment, 16 successive places hold at least 13 equal tokens
(13/16 of the item's tokens if it has fewer than 16, all of them if it has fewer than eight).  Items of fewer than
``least`` tokens are left out.

Nulls, ties and repeats: null and empty texts have no tokens and match nothing; equal benchmark texts are
matched once and reported for each of their item ids; a row is known by its id and a hash of its text, so rows that
share an id are compared each for itself, and reported once for their id with the best match of all; null ids are
ids like any other.  Either table may be empty; columns other than the ids and texts are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.scratch import materialise

#: Each covers six tokens; ``1`` counts, ``0`` is ignored.
MASKS = ("11010111", "11100010011")
WINDOW, EQUAL, LEAST = 16, 13, 8
#: The mask of items of LEAST to SHORT tokens.
SHORT, SHORT_MASK = 12, "11101"
#: (mask, least and most tokens of its items), for items of one token and more.
SIZED = (*((m, SHORT + 1, 2**31 - 1) for m in MASKS), (SHORT_MASK, LEAST, SHORT), *(("1" * n, n, n) for n in range(1, LEAST)))
TOKEN = r"[\p{L}\p{M}\p{N}]+"
#: Most rows of seed hashes or candidates that are sent to every executor (24 and 32 bytes each); beyond it both sides are shuffled.
SEND_ROWS = 400_000


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def seeds(rows: DataFrame, key: str, numbers: Sequence[int], items: bool = False) -> DataFrame:
    """``rows`` (key, t) as (key, p, h): the hash under each mask of SIZED that ``numbers`` names at each place; of ``items`` under their own masks only."""
    least = min(len(SIZED[k][0]) for k in numbers)
    placed = rows.where(F.size("t") >= least).select(key, "t", F.explode(F.expr(f"sequence(0, size(t) - {least})")).alias("p"))
    hashes = []
    for k in numbers:
        mask, low, high = SIZED[k]
        h = F.xxhash64(F.lit(k), *[F.get("t", F.col("p") + i) for i, c in enumerate(mask) if c == "1"])
        fits = F.col("p") + len(mask) <= F.size("t")
        hashes.append(F.when(fits & F.size("t").between(low, high) if items else fits, h))
    return placed.select(key, "p", F.stack(F.lit(len(hashes)), *hashes).alias("h")).where("h IS NOT NULL")


def _row(docs: DataFrame) -> Column:
    """What a row of ``docs`` is known by."""
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("mark"))


def _pairs(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """row, item_id, place, equal, item_tokens: every place where a row of ``docs`` holds an item of ``least`` tokens and more."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("t")).where(F.size("t") >= max(least, 1))
    items = materialise(items.groupBy("t").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("nameless")).withColumn("cls", F.monotonically_increasing_id()), "items")
    any_of = items.agg(*[F.coalesce(F.bool_or(F.size("t").between(low, high)), F.lit(False)) for _, low, high in SIZED]).first()
    numbers = [k for k, there in enumerate(any_of) if there] or [0]
    wanted = materialise(seeds(items.select("cls", "t"), "cls", numbers, True).join(items.select("cls", F.size("t").alias("m")), "cls").select("h", "cls", F.col("p").alias("q"), "m"), "seeds")
    found = seeds(docs.select(_row(docs).alias("row"), tokens(F.col("text")).alias("t")), "row", numbers)
    small = wanted.count() <= SEND_ROWS
    hits = found.join(F.broadcast(wanted) if small else wanted, "h").select("row", "cls", "m", (F.col("p") - F.col("q")).alias("place")).distinct()
    # the places of a row go together, so its text is read and cut into tokens once, and only the tokens under an item go on
    near = materialise(hits.groupBy("row").agg(F.collect_list(F.struct("cls", "m", "place")).alias("places")), "hits")
    if near.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("n")).first()["n"] <= SEND_ROWS:
        near = F.broadcast(near)
    # explode of one: what follows reads the tokens and does not form them anew for each place
    once = docs.select(_row(docs).alias("row"), "text").join(near, "row").select("row", "places", F.explode(F.array(tokens(F.col("text")))).alias("d"))
    under = F.expr("transform(places, h -> struct(h.cls, h.place, slice(d, greatest(h.place, 0) + 1, greatest(h.m + least(h.place, 0), 0)) AS part))")
    laid = once.select("row", F.inline(under)).join(items, "cls").withColumn("same", F.expr("transform(t, (x, i) -> if(x = get(part, cast(i + least(place, 0) AS int)), 1, 0))"))
    need = F.expr(f"if(size(t) >= {WINDOW}, {EQUAL}, if(size(t) >= {LEAST}, size(t) - size(t) * {WINDOW - EQUAL} div {WINDOW}, size(t)))")
    best = F.expr(f"array_max(transform(sequence(1, size(t)), i -> aggregate(slice(same, i, {WINDOW}), 0, (a, x) -> a + x)))")
    kept = laid.where(best >= need)
    return kept.select("row", "place", F.size("t").alias("item_tokens"), F.expr("aggregate(same, 0, (a, x) -> a + x)").alias("equal"), F.explode(F.expr("if(nameless, concat(ids, array(null)), ids)")).alias("item_id"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, place (token of the document under the item's first one), equal, item_tokens; a row per pair found, for items of ``least`` tokens (one at least) and more."""
    top = _pairs(docs, benchmark, least).groupBy("row.doc_id", "item_id").agg(F.max(F.struct("equal", (-F.col("place")).alias("back"), "item_tokens")).alias("m"))
    return top.select("doc_id", "item_id", (-F.col("m.back")).alias("place"), F.col("m.equal").alias("equal"), F.col("m.item_tokens").alias("item_tokens"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that are contaminated by an item of any length, whatever their id; clean rows that share an id with one stay."""
    bad = _pairs(docs, benchmark, 1).select(F.col("row").alias("_row")).distinct()
    return docs.join(bad, _row(docs) == F.col("_row"), "left_anti")
