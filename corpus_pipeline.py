"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrid.llm import bpe, jaccard, language, mixing, pii
from trailgrid.llm.common import Scratch, load


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that even their best language codes much longer than unseen texts of it.

    Null and empty texts go; null ids, sources and languages don't matter; repeated rows stay as often as they are;
    without a labelled row nothing is rejected.
    """
    return language.keep_known(docs, language.learn(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each component of near-duplicates (five words, 0.8).

    Documents with null ids come last in their component, and all stay that have no near copy; different texts under one id
    are documents of their own; of repeated rows of the kept document one stays. Wordless texts are near no other.
    """
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders; no document goes. Null texts stay null, others get their n_chars anew."""
    return _counted(pii.mask(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies documents, or leaves them out, so that sources meet their targets.

    Wordless and null texts are never taken; a null source is a source of its own; null ids and repeated rows are mixed
    like others; the one document of a source that is taken in part keeps its first words.
    """
    return _counted(mixing.apply(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens) of what is left, a row each; a null text has no tokens."""
    return bpe.encode(docs, bpe.vocabulary_path(), keep=("source",)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language ID", known_language), ("near duplicates", one_of_each_group), ("personal data", personal_data), ("mixing", mixture), ("tokens", tokens)]
#: Prediction by a fitted model, random rounding and byte-pair merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = load(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return made
        docs = scratch.keep(made, f"stage{k}")
    return docs
