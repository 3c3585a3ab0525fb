"""A search index of sorted terms in ranges, with postings in blocks: a query reads the ranges of its prefixes and no others.

``root/postings/range=<k>`` holds the k-th range of the terms; a row is a term's ids of one block of ``BLOCK`` ids, as differences.  ``root/ranges`` holds
the first and last term of each range.  A term of most rows has a row for each block and may fill several ranges, so none is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.text import search_tokens

#: Ids of a block.
BLOCK = 4096
#: A word that is the beginning of a query token counts if it has this share of its length.
PART = 0.6

POSTINGS = "term string, block long, n int, deltas array<int>, range int"


def build(rows: DataFrame, id_: str, text: str, root: str, ranges: int) -> None:
    """Write the index of ``rows`` under ``root``, in about ``ranges`` ranges.  Null ids and texts are left out; rows that share an id are one text, and repeated words count once."""
    words = rows.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.explode(F.array_distinct(search_tokens(F.col(text)))).alias("term"))
    ids = F.array_sort(F.collect_set((F.col("id") - F.col("block") * BLOCK).cast("int")))
    lists = words.withColumn("block", F.floor(F.col("id") / BLOCK)).groupBy("term", "block").agg(ids.alias("ids")).select("term", "block", F.size("ids").alias("n"), "ids")
    deltas = F.transform("ids", lambda x, i: F.when(i == 0, x).otherwise(x - F.get("ids", i - 1)))
    placed = lists.select("term", "block", "n", deltas.alias("deltas")).repartitionByRange(ranges, "term", "block").sortWithinPartitions("term", "block")
    placed.withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{root}/postings")
    spark = rows.sparkSession
    spark.read.schema(POSTINGS).parquet(f"{root}/postings").groupBy("range").agg(F.min("term").alias("low"), F.max("term").alias("high")).coalesce(1).write.parquet(f"{root}/ranges")


def tokens_of(spark: SparkSession, asked: str) -> list[str]:
    """The tokens of a query, folded as the words are, each once."""
    return sorted(set(spark.range(1).select(search_tokens(F.lit(asked)).alias("t")).first().t))


def hits(spark: SparkSession, root: str, token: str) -> DataFrame:
    """Rows of the postings whose term begins with ``token``, or is itself its beginning and long enough; only ranges that may hold them are read."""
    shorter = [token[:n] for n in range(1, len(token)) if n >= len(token) * PART]
    last = token + "\U0010ffff"
    known = spark.read.parquet(f"{root}/ranges").collect()  # a line a range
    # by bytes, as the terms are sorted
    b = lambda s: s.encode()
    near = [r["range"] for r in known if b(r.low) <= b(last) and b(r.high) >= b(token) or any(b(r.low) <= b(w) <= b(r.high) for w in shorter)]
    begins = (F.col("term") >= token) & (F.col("term") <= last) & F.col("term").startswith(token)
    exact = F.col("term").isin(shorter) if shorter else F.lit(False)
    return spark.read.schema(POSTINGS).parquet(f"{root}/postings").where(F.col("range").isin(near)).where(begins | exact)


def search(spark: SparkSession, root: str, asked: str) -> DataFrame:
    """(id): rows whose words answer every token of ``asked``; a text without tokens asks for nothing.

    Blocks in which a token has no posting are dropped before any list is unpacked.
    """
    tokens = tokens_of(spark, asked)
    if not tokens:
        return spark.createDataFrame([], "id long")
    found = None
    for k, token in enumerate(tokens):
        one = hits(spark, root, token).select(F.lit(k).alias("k"), "term", "block", "deltas")
        found = one if found is None else found.unionByName(one)
    whole = found.groupBy("block").agg(F.count_distinct("k").alias("ks")).where(F.col("ks") == len(tokens)).select("block")
    order = Window.partitionBy("k", "term", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    unpacked = found.join(whole, "block", "left_semi").select("k", "term", "block", F.posexplode("deltas").alias("pos", "d"))
    ids = unpacked.select("k", (F.col("block") * BLOCK + F.sum("d").over(order)).alias("id"))
    return ids.groupBy("id").agg(F.count_distinct("k").alias("ks")).where(F.col("ks") == len(tokens)).select("id")
