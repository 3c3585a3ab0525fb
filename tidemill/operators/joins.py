"""Interval, mutual-unique, fuzzy and gap joins as equi-joins on keys or time buckets, never as products."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import bare_letters
from tidemill.scratch import materialise


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, seconds: int) -> DataFrame:
    """Pairs with equal keys whose times are at most ``seconds`` apart.

    Right rows are put in three successive buckets of that width, so a hot key is spread over its times.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(seconds * 1_000_000)).cast("long")
    a = left.withColumn("_bucket", bucket(F.col(left_at)))
    b = right.withColumn("_bucket", F.explode(F.array(*[bucket(F.col(right_at)) + i for i in (-1, 0, 1)])))
    close = F.abs(F.unix_micros(F.col(left_at)) - F.unix_micros(F.col(right_at))) <= seconds * 1_000_000
    return a.join(b, [*keys, "_bucket"]).where(close).drop("_bucket")


def met(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, seconds: int, take: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """``left`` with each of ``take`` (F.min or F.max, and of what) over the rows of ``right`` with equal ``keys`` at most ``seconds`` apart; null where there are none.

    No pair is made.  Time is cut into buckets of ``seconds``: a time meets all of its own bucket, the start of the next and the end of the last one, so a window over a bucket,
    and one over the same bucket backwards, tell what every time in reach of it meets.  Work grows with the rows, and a hot key is spread over its times.
    """
    micros, wide = F.unix_micros(F.col(at).cast("timestamp")), seconds * 1_000_000
    # answers hang on keys and time alone
    held = right.groupBy(*keys, micros.alias("_x")).agg(*[f(c).alias(n) for n, (f, c) in take.items()])
    asked = left.where(F.col(at).isNotNull()).select(*keys, micros.alias("_t")).distinct()
    way = lambda b, d, x: F.struct(b.cast("long").alias("_b"), F.lit(d).alias("_d"), x.alias("_o"))
    x, t = F.col("_x"), F.col("_t")
    of = lambda c: F.floor(c / F.lit(wide)).cast("long")
    rows = held.select(*keys, F.explode(F.array(way(of(x), 1, x), way(of(x), -1, -x))).alias("_w"), F.lit(None).cast("long").alias("_t"), *take)
    ends = (way(of(t), 1, F.lit((1 << 63) - 1)), way(of(t) + 1, 1, t + wide), way(of(t) - 1, -1, wide - t))
    probes = asked.select(*keys, F.explode(F.array(*ends)).alias("_w"), "_t")
    every = rows.unionByName(probes, allowMissingColumns=True).select(*keys, "_w.*", "_t", *take)
    # a row comes before what asks at its time
    window = Window.partitionBy(*keys, "_b", "_d").orderBy("_o", F.col("_t").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = every.select(*keys, "_t", *[f(n).over(window).alias(n) for n, (f, _) in take.items()]).where("_t IS NOT NULL").groupBy(*keys, "_t").agg(*[f(n).alias(n) for n, (f, _) in take.items()])
    return left.withColumn("_t", micros).join(told, [*keys, "_t"], "left").drop("_t")


def lone_links(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, seconds: int) -> DataFrame:
    """(a, b): the pairs of ``left`` (a, keys, at) and ``right`` (b, keys, at) with equal ``keys`` at most ``seconds`` apart that are each other's only ones; a row may have several keys.  No other pair is made."""

    def only(rows: DataFrame, others: DataFrame, id_: str, other: str) -> DataFrame:
        # the least and the greatest partner; a row with one has the same twice
        both = met(rows.select(id_, *keys, at), others, keys, at, seconds, {"_l": (F.min, F.col(other)), "_h": (F.max, F.col(other))})
        return both.groupBy(id_).agg(F.min("_l").alias(other), F.max("_h").alias("_h")).where(F.col(other) == F.col("_h")).select(id_, other)

    one = materialise(only(left, right, "a", "b"), "lone")
    back = only(right.join(one.select("b").distinct(), "b", "left_semi"), left, "b", "a")
    return one.join(back, ["a", "b"], "left_semi")


def unique_links(pairs: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """Pairs whose left id (and right id, if named) occurs in no other pair; counted with partial aggregation, not in windows."""
    out = pairs.join(pairs.groupBy(left).count().where("count = 1").select(left), left, "left_semi")
    if right:
        out = out.join(pairs.groupBy(right).count().where("count = 1").select(right), right, "left_semi")
    return out


def gaps(expected: DataFrame, found: DataFrame, keys: Sequence[str], at: str, found_at: str, seconds: int, id_: str) -> DataFrame:
    """Expected rows without a found row of the same keys in reach."""
    hit = within(expected, found, keys, at, found_at, seconds).select(id_).distinct()
    return expected.join(hit, id_, "left_anti")


def range_lookup(rows: DataFrame, value: str, rules: DataFrame, columns: Sequence[str], order: str, on: Sequence[str] = ()) -> DataFrame:
    """Adds the columns of the first rule (from, to, order, …) whose range holds the value; ranges of integers, spread to the values they hold."""
    spread = rules.withColumn(value, F.explode(F.expr("sequence(`from`, `to`)")))
    first = spread.groupBy(*on, value).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r"))
    return rows.join(first, [*on, value], "left").select(*[c for c in rows.columns], *[F.col(f"_r.{c}").alias(c) for c in columns])


def cross_walk(rows: DataFrame, ids: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their mapped ``value`` (null where unmapped), and the distinct unmapped keys."""
    out = rows.join(ids.select(*keys, value), list(keys), "left")
    return out, out.where(F.col(value).isNull()).select(*keys).distinct()


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of a pair, the smaller first."""
    return F.least(a, b), F.greatest(a, b)


def missing_keys(rule: str, rows: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """(rule, key, n): values of ``column`` that ``known`` lacks, with the rows that use them."""
    used = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    return used.join(known.select(F.col(known_column).alias("key")).distinct(), "key", "left_anti").select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"), "n")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, take: Sequence[str], ranges: int = 256) -> DataFrame:
    """Each left row with the columns of the latest right row at or before it; no pairs, and no key in one task.

    The time is cut into ``ranges`` of equal width: inside one a window looks back, and what a range begins with is handed on from the ranges before it, of which there are few for
    a key.  Of right rows at the same time the greatest in ``take`` counts; null times and null keys find nothing.
    """
    instant = lambda c: F.col(c).cast("timestamp").cast("double") if dict(left.dtypes).get(left_at, "").startswith(("timestamp", "date")) else F.col(c).cast("double")
    ends = left.select(instant(left_at).alias("t")).unionByName(right.select(instant(right_at).alias("t"))).agg(F.min("t"), F.max("t")).first()
    low, high = ends[0] or 0.0, ends[1] or 0.0
    cut = lambda c: F.floor((instant(c) - F.lit(low)) * (ranges / ((high - low) or 1.0)))
    held = F.struct(*[F.col(c).alias(c) for c in take])
    kind = right.select(held.alias("h")).schema["h"].dataType
    tagged = left.select("*", F.col(left_at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(kind).alias("_h"), cut(left_at).alias("_c"))
    other = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).groupBy(key, F.col(right_at).alias("_t"), cut(right_at).alias("_c")).agg(F.max(held).alias("_h")).withColumn("_k", F.lit(0))
    both = tagged.unionByName(other, allowMissingColumns=True)
    inside = Window.partitionBy(key, "_c").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    last = both.groupBy(key, "_c").agg(F.max_by("_h", F.when(F.col("_k") == 0, F.col("_t"))).alias("_h"))
    so_far = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(F.col(key).alias("_j"), F.col("_c").alias("_d"), F.last("_h", ignorenulls=True).over(so_far).alias("_b"))
    found = both.withColumn("_m", F.last("_h", ignorenulls=True).over(inside)).where("_k = 1").join(last, F.col(key).eqNullSafe(F.col("_j")) & F.col("_c").eqNullSafe(F.col("_d")), "left")
    found = found.withColumn("_m", F.when(F.col(key).isNotNull() & F.col("_t").isNotNull(), F.coalesce("_m", "_b")))
    return found.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in take])


def name_parts(name: Column) -> Column:
    """The parts of a name: folded, at blanks, dots, commas and hyphens."""
    return F.filter(F.split(bare_letters(name), r"[\s.,-]+"), lambda w: w != "")


def fuzzy_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, basis): names of ``left`` and ``right`` (one column name each) that may be of one person, as distinct lists of parts; :func:`name_parts` of a name gives its list, sorted.

    ``full``: the same parts in any order; ``initial``: parts that differ pair up as a letter and a part that begins with it, and a part of two letters or more
    is the same.  Two such names have the same first letters and share a part, so names meet by each of their parts together with
    all first letters, and each pair only under its rarest shared part; a common family name alone brings nothing together.  Names without a part of two letters match only in full.  Null names match nothing.
    """
    side = lambda df, c: df.select(F.array_sort(name_parts(F.col("name"))).alias(c)).where(F.size(c) > 0).distinct()
    a, b = materialise(side(left, "l"), "left-names"), materialise(side(right, "r"), "right-names")
    letters = lambda c: F.array_join(F.array_sort(F.transform(c, lambda w: F.left(w, F.lit(1)))), "")
    keyed = lambda df, c: df.select(c, letters(c).alias("letters"), F.explode(F.array_distinct(F.filter(c, lambda w: F.length(w) > 1))).alias("part"))
    x, y = keyed(a, "l"), keyed(b, "r")
    often = x.select("part").unionByName(y.select("part")).groupBy("part").agg(F.count("*").alias("often"))
    met = x.join(y, ["letters", "part"]).join(often, "part").groupBy("l", "r").agg(F.min(F.struct("often", "part")).alias("rarest")).select("l", "r")
    # what is left of both without the parts they share, each as often as it occurs
    rest = lambda c, d: F.flatten(F.transform(F.array_distinct(c), lambda w: F.array_repeat(w, F.greatest(F.lit(0), F.size(F.filter(c, lambda v: v == w)) - F.size(F.filter(d, lambda v: v == w))))))
    short = lambda c: F.array_sort(F.filter(c, lambda w: F.length(w) == 1))
    begins = lambda c: F.array_sort(F.transform(F.filter(c, lambda w: F.length(w) > 1), lambda w: F.left(w, F.lit(1))))
    met = met.where(F.size("l") == F.size("r")).withColumns({"_p": rest(F.col("l"), F.col("r")), "_q": rest(F.col("r"), F.col("l"))})
    fits = (short(F.col("_p")) == begins(F.col("_q"))) & (short(F.col("_q")) == begins(F.col("_p")))
    near = met.where((F.size("_p") > 0) & fits).select("l", "r", F.lit("initial").alias("basis"))
    return near.unionByName(a.join(b, F.col("l") == F.col("r")).select("l", "r", F.lit("full").alias("basis")))


def name_match(full: Column, short: Column) -> Column:
    """``full`` if the words are the same in any order, ``initial`` if the last words agree and the first letters do, else null."""
    a, b = (F.array_sort(F.filter(F.split(F.lower(c), r"[\s.]+"), lambda w: w != "")) for c in (full, short))
    x, y = (F.filter(F.split(F.lower(c), r"[\s.]+"), lambda w: w != "") for c in (full, short))
    same_last = F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))
    same_first = F.substring(F.try_element_at(x, F.lit(1)), 1, 1) == F.substring(F.try_element_at(y, F.lit(1)), 1, 1)
    return F.when(a == b, "full").when(same_last & same_first & ((F.length(F.try_element_at(y, F.lit(1))) == 1) | (F.length(F.try_element_at(x, F.lit(1))) == 1)), "initial")


def shared_links(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """(a, b): pairs of ``left`` and ``right`` (id, category, at, teams, players) of one category, at most ``seconds`` apart, that share a player or two teams, and that are in no other such pair.

    A row is found by each player and each pair of its teams, so rows that share nothing never meet.  Null arrays are empty.
    """
    teams = F.array_sort(F.array_distinct(F.coalesce("teams", F.array().cast("array<string>"))))
    two = F.flatten(F.transform(teams, lambda x: F.transform(F.filter(teams, lambda y: y > x), lambda y: F.to_json(F.array(x, y)))))
    players = F.transform(F.coalesce("players", F.array().cast("array<string>")), lambda p: F.concat(F.lit("p:"), p.cast("string")))
    tagged = lambda df, id_: df.select(F.col("id").alias(id_), "category", "at", F.explode(F.array_distinct(F.concat(players, two))).alias("tag"))
    return lone_links(tagged(left, "a"), tagged(right, "b"), ["category", "tag"], "at", seconds)
