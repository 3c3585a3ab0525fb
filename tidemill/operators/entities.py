"""Names of a dictionary in texts of any script, found by one automaton, and what their context makes of them.

The dictionary is a table.  Its letters are counted before it is sent: up to ``LARGEST`` it goes to the tasks as one
Aho-Corasick automaton, a larger one is cut into parts that go in turns, so no entry and no length of entry is left out.  All
that follows (suffixes, places, evidence, vetoes) is joins of the hits with small tables.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the part of a dictionary that is sent at once (an automaton takes some hundred bytes for each).
LARGEST = 2_000_000
#: What may stand between a name and the word beside it: anything else ends the clause.
BESIDE = r"[\s'\"‘’“”`´·‐‑–-]*"


class _Folds(dict):
    """Characters in lower case and without marks, one for one, so that places stay what they are."""

    def __missing__(self, code: int) -> int:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if "가" <= chr(code) <= "힣" or len(bare) != 1:
            bare = chr(code)
        self[code] = ord(bare)
        return self[code]


_FOLDS = _Folds()


def fold(text: str) -> str:
    """``text`` as it is compared: same length, lower case, no marks."""
    return text.translate(_FOLDS)


def letter_class(c: str) -> str:
    """``H`` Hangul, ``U`` scripts written without blanks, ``L`` other letters and digits, empty for the rest."""
    if "가" <= c <= "힣":
        return "H"
    if "一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "฀" <= c <= "๿":
        return "U"
    return "L" if c.isalnum() else ""


def stands_alone(text: str, start: int, stop: int) -> bool:
    """Whether a hit is a word: no letter of its first character's class before it (``U`` has no words), nor, for ``L``, of its last one's behind it.

    Behind Hangul anything may follow, as particles do.
    """
    first, last = letter_class(text[start]), letter_class(text[stop - 1])
    if first in ("L", "H") and start and letter_class(text[start - 1]) == first:
        return False
    return not (last == "L" and stop < len(text) and letter_class(text[stop]) == "L")


def found(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, int, str]]:
    """(start, stop, folded name) of every name that stands alone in a text."""
    folded = fold(text)
    for end, name in automaton.iter(folded):
        if stands_alone(folded, end + 1 - len(name), end + 1):
            yield end + 1 - len(name), end + 1, name


def _beside(text: str, start: int, stop: int) -> tuple[str | None, str | None]:
    before = re.search(rf"(\w+){BESIDE}$", text[max(0, start - 80) : start])
    after = re.match(rf"{BESIDE}(\w+(?:-\d+)?)", text[stop : stop + 80])
    return before and before[1], after and after[1]


def hits(rows: DataFrame, id_: str, text: str, terms: DataFrame) -> DataFrame:
    """(id, slug, kind, shared, start, stop, said, before, after): names of ``terms`` (term, slug, kind, shared) in the texts of ``rows``.

    Leftmost first and then longest, without overlap; an entry that several slugs or kinds have gives a row for each.  Case and marks
    do not count.  ``before`` and ``after`` are the folded words beside a hit within its clause.  Null and empty texts and terms give nothing; equal rows are
    told apart by their id alone.
    """
    spark = rows.sparkSession
    kind = rows.select(id_).schema[0].dataType.simpleString()
    entries = terms.where("length(term) > 0")
    size = entries.select(F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-size // LARGEST) or 1
    raw = None
    for k in range(parts):
        own = entries.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) if parts > 1 else entries
        sent = spark.sparkContext.broadcast(sorted({fold(r["term"]) for r in own.select("term").distinct().collect()}))

        def run(batches, sent=sent):
            automaton = ahocorasick.Automaton()
            for name in sent.value:
                automaton.add_word(name, name)
            automaton.make_automaton()
            for batch in batches:
                out: list[tuple] = []
                for key, value in zip(batch.column(0), batch.column(1).to_pylist()):
                    if value and sent.value:
                        folded, longest = fold(value), {}
                        for start, stop, name in found(value, automaton):
                            longest[start] = max(longest.get(start, (0, "")), (stop, name))
                        for start, (stop, name) in longest.items():
                            out.append((key, name, start, stop, value[start:stop], *_beside(folded, start, stop)))
                cols = list(zip(*out)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))]], ["id", "name", "start", "stop", "said", "before", "after"])

        found_ = rows.select(rows[id_].alias("id"), rows[text].cast("string").alias("text")).mapInArrow(run, f"id {kind}, name string, start int, stop int, said string, before string, after string")
        raw = found_ if raw is None else raw.unionByName(found_)
    # leftmost longest: each hit's fate hangs on those before it in its text only
    ordered = raw.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("stop")).alias("less"), "name", "said", "before", "after"))).alias("all"))
    kept = F.aggregate("all", F.struct(F.lit(0).alias("end"), F.filter("all", lambda x: F.lit(False)).alias("out")), lambda s, x: F.when(x["start"] >= s["end"], F.struct((-x["less"]).alias("end"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s), lambda s: s["out"])
    single = ordered.select("id", F.explode(kept).alias("h")).select("id", "h.name", "h.start", (-F.col("h.less")).alias("stop"), "h.said", "h.before", "h.after")
    folded = F.pandas_udf(lambda s: s.map(fold, na_action="ignore"), "string")
    named = entries.select(folded(F.col("term")).alias("name"), "slug", "kind", F.coalesce("shared", F.lit(False)).alias("shared")).groupBy("name", "slug", "kind").agg(F.bool_and("shared").alias("shared"))
    return single.join(named, "name").select("id", "slug", "kind", "shared", "start", "stop", "said", "before", "after")


#: Two numbers between two names, or in front of what follows the second of two names joined by a dash.
SCORE = r"^\s*\d{1,2}\s?[-–:]\s?\d{1,2}\s*$"


def judged(found: DataFrame, leagues: DataFrame, texts: DataFrame, sources: DataFrame, suffixes: DataFrame, places: DataFrame, occupations: DataFrame) -> DataFrame:
    """``found`` (of :func:`hits`) with league and reason: null where a tag stands, else the first rule that it fails.

    ``women``: a team in a text with a hit of kind ``women``; ``suffix``: a team before a word of ``suffixes`` (word), a side of its own;
    ``occupation``: a player beside a word of ``occupations`` (word), a namesake.  A shared name, which also means other things,
    must begin with a capital or a letter without case (``lower``), not follow one of ``places`` (word; ``place``), and be borne out (``unproved``) by another team of
    its league that is sure, a hit of kind ``league`` with its league as slug, a source that covers just that league (``sources``: id, league), or
    a score between it and another shared team of its league.  ``leagues``: slug, league; ``texts``: id, text.
    """
    words = lambda table, column, flag: table.select(F.col("word").alias(column)).distinct().withColumn(flag, F.lit(True))
    team, player, shared = F.col("kind") == "team", F.col("kind") == "player", F.col("kind").isin("team", "player") & F.col("shared")
    h = found.join(leagues.select("slug", "league").distinct(), "slug", "left").join(words(suffixes, "after", "_s"), "after", "left").join(words(places, "before", "_p"), "before", "left")
    h = h.join(words(occupations, "before", "_o"), "before", "left").join(words(occupations, "after", "_q"), "after", "left")
    women = found.where("kind = 'women'").select("id").distinct().withColumn("_w", F.lit(True))
    first = F.substring("said", 1, 1)
    early = (
        F.when(team & F.col("_w"), "women").when(team & F.col("_s"), "suffix").when(player & F.coalesce("_o", "_q"), "occupation")
        .when(shared & (first != F.upper(first)), "lower").when(shared & F.col("_p"), "place")
    )
    h = h.join(women, "id", "left").withColumn("_early", early)
    alive = h.where(team & F.col("_early").isNull() & F.col("league").isNotNull())
    sure = alive.where("NOT shared").groupBy("id", "league").agg(F.min("slug").alias("_a"), F.max("slug").alias("_b"))
    said = h.where("kind = 'league'").select("id", F.col("slug").alias("league")).distinct().withColumn("_l", F.lit(True))
    # a source speaks for a league if it covers no other
    only = sources.groupBy("id").agg(F.min("league").alias("league"), F.max("league").alias("_z")).where("league = _z").select("id", "league").withColumn("_f", F.lit(True))
    order = Window.partitionBy("id").orderBy("start", "slug")
    pair = alive.join(texts.select("id", F.col("text").alias("_t")), "id").withColumn("_n", F.lead(F.struct("start", "stop", "slug", "shared", "league")).over(order))
    between, behind = F.expr("substring(_t, stop + 1, _n.start - stop)"), F.expr("substring(_t, _n.stop + 1, 12)")
    scored = between.rlike(SCORE) | (between.rlike(r"^\s?[-–]\s?$") & behind.rlike(r"^\s?\d{1,2}\s?[-–:]\s?\d{1,2}(?!\d)"))
    pair = pair.where(F.col("shared") & F.col("_n.shared") & (F.col("_n.league") == F.col("league")) & (F.col("_n.slug") != F.col("slug")) & scored)
    beside = pair.select("id", F.explode(F.array("start", "_n.start")).alias("start")).distinct().withColumn("_r", F.lit(True))
    h = h.join(sure, ["id", "league"], "left").join(said, ["id", "league"], "left").join(only, ["id", "league"], "left").join(beside, ["id", "start"], "left")
    proof = F.coalesce((F.col("_a") != F.col("slug")) | (F.col("_b") != F.col("slug")), F.lit(False)) | F.coalesce("_l", "_f", "_r", F.lit(False))
    reason = F.coalesce("_early", F.when(shared & ~proof, "unproved"))
    return h.select("id", "slug", "kind", "shared", "start", "stop", "said", "league", reason.alias("reason"))
