"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``documents``. Near duplicates are found on five-word shingles.
Mixing spends as many tokens as it gets, in up to two seeded epochs: sources below their target
weight are read up to twice, sources above it are cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.byte_pairs import encoded
from skylattice.llm.common import materialize, table
from skylattice.llm.mixing import mixed
from skylattice.llm.near_duplicates import one_of_each
from skylattice.llm.personal_data import redact
from skylattice.llm.quality_rules import good_documents
from skylattice.llm.queries import WEIGHTS

#: Tokens of the mixture as a share of those that reach it, and how often a document may be read.
PERCENT = 100
EPOCHS = 2

#: SQL cannot express the forest, the sketches and the encoder.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do null, empty and wordless texts. Repeated rows share one verdict."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the smallest id stays, once; a group without ids keeps one row. Wordless texts stay."""
    return one_of_each(docs, k=5, percent=80)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text. Null texts stay null and keep their ``n_chars``."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights; null languages and sources are leaves of their own, wordless texts cost nothing."""
    return mixed(docs, WEIGHTS, PERCENT, epochs=EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text; a null text is empty. Rows of a second epoch are rows of their own."""
    return encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("personal_data", personal), ("mixing", mix), ("byte_pairs", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input. Empty tables give empty results."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
