"""A training corpus from ``documents``: toxic documents go, repeated lines go, one of each group of near copies stays, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Mixing never drops a
document here: rates lie between 1 and MIX_MOST, and a document with a rate over 1 is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparklode.llm import line_dedup, mixing, ngram_join, packing, toxicity
from sparklode.llm._common import fold, stored, table

MIX_TARGETS = {"good": 0.92, "poor": 0.08}
MIX_BUDGET, MIX_MOST = 1.15, 3.0


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go from the texts; a document that is left without a word, a copy of others line by line, goes too."""
    return line_dedup.cleaned(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the expected tokens of each domain match the targets."""
    return mixing.repeated(docs, mixing.domains_of(table(spark, sf_dir, "labels")), MIX_TARGETS, lo=1.0, hi=MIX_MOST, budget=MIX_BUDGET)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express these stages; tests/llm compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, folder = stored(stage(spark, docs, sf_dir), folder)
    return STAGES[-1][1](spark, docs, sf_dir)
