"""From raw documents to packed sequences: five stages, each one operator over all rows that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame that can be written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch
from quern.llm.jaccard import without_near_copies
from quern.llm.mixing import mixed
from quern.llm.packing import pack
from quern.llm.quality import accepted
from quern.llm.substring import without_repeats
from quern.sources import table

#: Packing, rounding and the classifier are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those whose score for label 1 is below 0.3."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 or more stays: the one with the least doc_id."""
    return without_near_copies(docs, n=5, num=80, den=100)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur anywhere else are cut out of the text; every document stays."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from never to three times."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents; between stages the rows are Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
            if name != STAGES[0][0]:
                scratch.drop(before)
        return STAGES[-1][1](spark, docs, sf_dir)  # packing checkpoints its pieces and reads docs no more
