"""Corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents.

Defined cases: a null text counts as empty: it has no toxic words and stays, is one near-copy group with all texts without words,
has nothing to cut and one token. A null id is scored, grouped, cut (after all other ids) and packed like any other. Repeated rows
and ids are decided by row: of equal rows one stays. Long texts count whole. An empty table gives an empty result. Further
columns of documents pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import packing, simhash, suffix_dedup, toxicity
from plinth.llm.common import Scratch
from plinth.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    labels, names = toxicity.chain_labels(table(spark, sf_dir, "labels"))
    return toxicity.score(docs, toxicity.fit(docs, labels, names), drop=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of similar texts (five-word shingles, similarity 0.8)."""
    return simhash.drop_similar(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that also start earlier; n_chars follows the text."""
    out = suffix_dedup.cut_repeats(docs, as_text=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of each document."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix_array", cut_repeats), ("packing", pack)]

#: SQL cannot express the fitted classifier; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
