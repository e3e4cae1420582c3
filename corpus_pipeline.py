"""From raw documents to training tokens: quality, exact copies, near copies, mixture, encoding.

Each stage is one operator of ``tripweave.llm``, applied to all that the stage
before has kept. Stages take (spark, docs, folder of tables); what a stage
returns is written as Parquet and read back as the next one's ``docs``.

Null and empty texts are texts without words in every stage. Null and repeated
ids are as good as others: rows are told apart by numbers of their own. Extra
columns stay, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripweave.llm import bpe, chosen_path, content_sort, mixing, ordinal
from tripweave.llm.common import stored
from tripweave.llm.queries import table

#: Shares of the languages' tokens in the result.
MIXTURE = {"en": 0.60, "fr": 0.15, "de": 0.15, "es": 0.10}


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose chance of the best grade is high enough stay; the model learns from the labelled ones among them.

    Each row is judged alone, a null text as an empty one; without labelled
    rows every row has the same chance.
    """
    model = ordinal.trained(docs, table(spark, folder, "labels"))
    judged = ordinal.scored(docs, model)
    return judged.filter(judged["tail_probability"] >= ordinal.KEEP_FROM).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of equal texts stays, repeated rows included; null texts equal empty ones."""
    return content_sort.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each class of near copies stays: of texts without words one, of repeated rows one."""
    return chosen_path.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents stay with their rate as the chance, so that the languages' tokens come to MIXTURE's shares of all, or as near as single copies allow.

    Each row is drawn on its own, null and repeated ids too; a text without
    words has the languages' shares in the labelled documents.
    """
    return mixing.thinned(docs, mixing.labelled_languages(docs, table(spark, folder, "labels")), MIXTURE)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null text has no tokens."""
    return bpe.encoded_digests(docs)


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("encoding", encoded)]

#: A classifier, sampled paths and a tokenizer are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the table of documents; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
