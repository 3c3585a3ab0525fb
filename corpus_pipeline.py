"""The corpus pipeline: STAGES over the table documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, minhash, quality, secrets
from tidemill.llm.queries import mix_rows
from tidemill.scratch import materialise
from tidemill.session import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality classifier, learned from ``labels``, does not reject.

    Rows are judged one by one by their text alone, so repeated rows and null ids fare alike; null and empty texts have a score too.  Without labels of both kinds every score is
    the smoothed share of good labels, and all rows stay or go alike.  All columns go on as they are, whatever further ones there are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id (nulls last), then the least hash of its text.

    Texts without words are in no group and stay; a row that repeats both id and text of a kept one goes.  All columns go on.
    """
    return minhash.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What holds no passage of ``benchmark``, items of one token and more.

    A row is known by its id and text, so rows that share an id, or have none, are judged each for itself.  Null and empty texts hold nothing and stay, null items match nothing.  All columns go on.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in angle brackets and ``n_chars`` brought up to date; null texts stay null, of overlapping secrets the first gives its kind."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix over what is left, with the columns of query op1; null and empty texts have size 0 and take no part, a null source is one like any other and comes last."""
    return mix_rows(docs)


STAGES = [("quality", good), ("near_dedup", distinct), ("decontamination", uncontaminated), ("secrets", redacted), ("mixing", mixed)]
#: The stages learn a model and compress texts, which SQL cannot express; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows.  Each stage but the last is written to the shared folder and read again; an empty table goes through empty."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
