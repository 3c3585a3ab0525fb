"""What comes in: items with the reason of their rejection, runs that were published, names shown for others, evaluations of replayed days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import dates, urls
from tidemill.functions.text import bare_letters, clean_summary, clean_title, squeeze
from tidemill.operators.joins import name_parts
from tidemill.operators.select import first_of


def normalised(rows: DataFrame, longest: int = 200) -> DataFrame:
    """``rows`` (title, link, published, summary, source, zone) as id, title, url, at, summary and reason, null where an item is taken.

    Reasons in order: ``no-source``, ``no-title`` (also of blanks and controls only), ``title-too-long`` (over ``longest``), ``bad-link`` (no web address with a host), ``no-date`` (none, or none that can be read; a date without a zone is taken
    in the row's). Rejected items keep what could be read of them.
    """
    link = F.trim("link")
    good = link.rlike(r"(?i)^https?://[^/?#\s]+\.[^/?#\s]+")
    out = rows.withColumns({"_title": clean_title(F.col("title")), "_url": F.when(good, urls.normalise(link)), "_at": dates.feed_date(F.col("published"), F.col("zone")), "_text": clean_summary(F.col("summary"))})
    reason = (
        F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "no-source").when(F.coalesce("_title", F.lit("")) == "", "no-title").when(F.length("_title") > longest, "title-too-long")
        .when(F.col("_url").isNull(), "bad-link").when(F.col("_at").isNull(), "no-date")
    )
    return out.select(F.when(F.col("_url").isNotNull(), urls.url_hash(F.col("_url"))).alias("id"), F.col("_title").alias("title"), F.col("_url").alias("url"), F.col("_at").alias("at"), F.col("_text").alias("summary"), reason.alias("reason"))


def published(env: Column, job: Column, status: Column, sources: Column) -> Column:
    """Whether a run has published: of production, the collecting job, with success or part of it, and at least one of its ``sources`` (ok) was read; nulls are no."""
    some = F.exists(sources, lambda s: F.coalesce(s["ok"], F.lit(False)))
    return F.coalesce((env == "prod") & (job == "collect") & status.isin("success", "partial") & some, F.lit(False))


def display_index(names: DataFrame) -> DataFrame:
    """(key, shown, id): what is shown for a name, of ``names`` (id, written, shown, ord), by its folded key; the first by ``ord`` and id wins.

    A name with a part of one letter is no key, as it may be of many; rows without a written or shown name are left out.
    """
    key = squeeze(F.regexp_replace(bare_letters(F.col("written")), r"[\s.,-]+", " "))
    whole = (F.size(name_parts(F.col("written"))) > 0) & F.forall(name_parts(F.col("written")), lambda p: F.length(p) > 1)
    rows = names.where(F.col("shown").isNotNull() & whole).select(key.alias("key"), "shown", "id", "ord")
    return first_of(rows, ["key"], [F.col("ord"), F.col("id")]).select("key", "shown", "id")


def evaluation(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """day, right, wrong, missing, extra, precision, recall: how the lines ``found`` (day, keys, value) answer the golden ``expected`` ones.

    A line is right if an expected one of its day and keys has its value, wrong if one has another, else extra; an expected line without any is missing.  Lines that repeat day and keys count once, by the least value; null
    values are values.  A share of nothing is null.
    """
    on = ["day", *keys]
    one = lambda df, c: df.groupBy(*on).agg(F.min(F.struct("value")).alias(c))
    both = one(expected, "_e").join(one(found, "_f").select(*[F.col(k).alias(f"_{k}") for k in on], "_f"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on], "full")
    both = both.withColumn("day", F.coalesce("day", "_day"))
    e, f = F.col("_e").isNotNull(), F.col("_f").isNotNull()
    same = e & f & F.col("_e").eqNullSafe(F.col("_f"))
    out = both.groupBy("day").agg(F.count_if(same).alias("right"), F.count_if(e & f & ~same).alias("wrong"), F.count_if(e & ~f).alias("missing"), F.count_if(f & ~e).alias("extra"))
    said, wanted = F.col("right") + F.col("wrong") + F.col("extra"), F.col("right") + F.col("wrong") + F.col("missing")
    return out.withColumns({"precision": F.try_divide("right", said), "recall": F.try_divide("right", wanted)})
