"""Sources: checked JSON, feeds, routing and suggestions for misspelt names."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatch, translate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.dates import feed_date


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON files of a declared schema; a record that does not fit ends the read with an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_parts(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, raw text of the records that do not fit), for files of one record per line."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", full, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record"), rows.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds ``<column>_parsed`` and ``broken``: a text that is there but yields nothing."""
    out = rows.withColumn(f"{column}_parsed", F.from_json(column, schema))
    nothing = F.forall(F.array(*[F.col(f"{column}_parsed.{f}").cast("string") for f in T.StructType.fromDDL(schema).names]), lambda x: x.isNull())
    return out.withColumn("broken", F.col(column).isNotNull() & F.coalesce(nothing, F.lit(True)))


class Registry:
    """Schemas by path pattern; the first pattern that fits wins."""

    def __init__(self, entries: Sequence[tuple[str, T.StructType]]):
        self.entries = list(entries)

    def find(self, path: str) -> T.StructType | None:
        return next((s for p, s in self.entries if fnmatch(path, p)), None)

    def suggest(self, path: str, most: int = 3) -> str | None:
        """The registered pattern nearest to an unregistered path, at most ``most`` edits away."""
        near = sorted((edit_distance(path, p), p) for p, _ in self.entries)
        return near[0][1] if near and near[0][0] <= most else None


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def suggest(rows: DataFrame, column: str, known: DataFrame, name: str, most: int) -> DataFrame:
    """Each distinct value with the nearest other known name at most ``most`` edits away.

    Two texts at most k edits apart share one of k + 1 even pieces of the shorter one near its place, so
    candidates come from an equi-join on pieces and not from all pairs.  A value of k characters or fewer has no such
    pieces: it meets the short names that share a character with it, and the least two names of each length up to k,
    of which one is as near as any name that shares none.
    """
    piece = f"""if(length(x) <= {most}, array_distinct(concat(transform(filter(split(x, ''), c -> c <> ''), c -> concat('\u0001', c)), array('\u0002'))), transform(sequence(0, {most}), i -> substring(x, cast(floor(i * length(x) / {most + 1}) as int) + 1, cast(floor((i + 1) * length(x) / {most + 1}) as int) - cast(floor(i * length(x) / {most + 1}) as int))))"""
    grams = "flatten(transform(sequence(1, length(x)), p -> transform(sequence(1, length(x) - p + 1), n -> substring(x, p, n))))"
    short = f"if(length(x) <= {2 * most}, transform(filter(split(x, ''), c -> c <> ''), c -> concat('\u0001', c)), array())"
    a = rows.select(F.col(column).alias("x")).distinct()
    a = a.where("length(x) > 0")
    b = known.select(F.col(name).alias("x")).distinct().where("length(x) > 0")
    least = b.where(F.length("x") <= most).withColumn("_n", F.row_number().over(Window.partitionBy(F.length("x")).orderBy("x"))).where("_n <= 2").select(F.col("x").alias("b"), F.lit("\u0002").alias("g"))
    cut = lambda df, e, n: df.select(F.col("x").alias(n), F.explode(F.array_distinct(F.expr(e))).alias("g"))
    pairs = cut(a, piece, "a").join(cut(b, f"concat({grams}, {short})", "b").unionByName(least), "g").select("a", "b").distinct()
    pairs = pairs.where("a <> b").withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= most)
    return pairs.groupBy(F.col("a").alias(column)).agg(F.min_by("b", F.struct("distance", "b")).alias("nearest"), F.min("distance").alias("distance"))


def registered(rows: DataFrame, column: str, patterns: Sequence[str], most: int = 3) -> DataFrame:
    """``rows`` with pattern, the first of ``patterns`` (globs) that a path fits, and nearest, for a path that fits none: the pattern at most ``most`` edits away."""
    first = F.coalesce(*[F.when(F.col(column).rlike(translate(p).replace(r"\Z", r"\z").replace(r"(?>", "(?:")), p) for p in patterns], F.lit(None).cast("string"))
    edits = F.array_min(F.array(*[F.struct(F.levenshtein(F.col(column), F.lit(p)).alias("n"), F.lit(p).alias("p")) for p in patterns]))
    return rows.withColumn("pattern", first).withColumn("nearest", F.when(first.isNull() & (edits["n"] <= most), edits["p"]))


def route(rows: DataFrame, rules: Sequence[tuple[Column, str]], default: str) -> DataFrame:
    """Adds ``route``: the first rule that holds."""
    out = F.lit(default)
    for when, name in reversed(rules):
        out = F.when(when, F.lit(name)).otherwise(out)
    return rows.withColumn("route", out)


FEED_ITEM = "title string, link string, pubDate string, description string, author array<string>"


def feed_items(rows: DataFrame, xml: str, zone: Column | None = None) -> DataFrame:
    """Items of a feed, one XML text per row: title, link, published, description, author; nothing fits: nulls."""
    item = F.from_xml(F.col(xml), FEED_ITEM)
    at = feed_date(F.col("i.pubDate"), F.lit(None).cast("string") if zone is None else zone)
    return rows.withColumn("i", item).select(*[c for c in rows.columns if c != xml], "i.title", "i.link", at.alias("published"), "i.description", "i.author")


def paged_search(queries: DataFrame, per_source: int) -> DataFrame:
    """Search queries (source, ord, enabled, known, blocked) with ``plan``: the first reason to leave one out, or ``run``, capped per source."""
    from pyspark.sql import Window

    reason = F.when(~F.col("enabled"), "disabled").when(~F.col("known"), "source missing").when(F.col("blocked"), "source blocked")
    out = queries.withColumn("_r", reason).withColumn("_n", F.row_number().over(Window.partitionBy("source", F.col("_r").isNull()).orderBy("ord")))
    return out.withColumn("plan", F.coalesce("_r", F.when(F.col("_n") > per_source, "over cap"), F.lit("run"))).drop("_r", "_n")
