"""Corpus pipeline over the documents table: five stages, each written and reread as the next
one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import durable, table
from sievework.llm.decontamination import find_contamination
from sievework.llm.mixing import mixed_documents
from sievework.llm.neardup import keep_one
from sievework.llm.sharding import assign_shards
from sievework.llm.toxicity import learn, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A null text scores like an empty one; texts of any length are scored whole; rows alike in text are
    judged alike, repeated rows each; an empty table stays empty; labels for missing or null ids count for
    nothing, and without labels of both classes all documents share one score. Other columns pass as
    they are, whatever their names."""
    model, share = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, share).filter("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, and one row of it.

    Rows without an id come after all others and are told apart by their text; rows of one id with
    different texts are different documents; rows with a null or empty text stay, but for repeats of an
    id; texts of any length are compared whole; an empty table stays empty. Other columns pass as they
    are; of rows alike in id and text the first by a hash of all columns stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no twentieth or more is benchmark text.

    A null or empty text is clean, as is everything against an empty benchmark; texts of any length are
    searched whole; rows alike in text are judged alike, repeated rows each; an empty table stays empty.
    Other columns pass as they are, whatever their names."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them as a whole, in the order of its shards.

    Ones without words (null, empty) are never read; a null source is a source of its own; a document
    of any length is one row; rows alike in id and text share their places, in any order; an empty
    table stays empty. Other columns pass as they are, whatever their names."""
    return mixed_documents(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it.

    A null text counts 16 bytes and a null id sorts as the text 'null'; a row is never cut, however
    long; repeated rows take consecutive places, in any order; an empty table stays empty. Other
    columns pass as they are; ones named like an output are replaced by it."""
    out = assign_shards(docs)
    return out.select(*[c for c in docs.columns if c in out.columns], *[c for c in ("size", "shard", "slot") if c not in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Compression lengths and learned thresholds have no SQL form; a test holds run() to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
