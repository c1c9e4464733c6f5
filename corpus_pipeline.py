"""A corpus pipeline: quality rules, near duplicates, secrets, mixing, pieces. Each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import read, stored
from cairn.llm.mixing import mixed_documents
from cairn.llm.near_copies import one_of_near_copies
from cairn.llm.piece_codec import encode_pieces
from cairn.llm.repetition import kept_documents
from cairn.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those without text among them; rows are judged one by one, whatever their ids."""
    return kept_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that link at a similarity of 0.8 in runs of five words the document with the smallest id stays; of equal rows one does, rows without an id all do."""
    return one_of_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text give way to their kind in brackets; n_chars stays that of the original. A null text stays null; all rows stay."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times; rows of one id as often as one another, rows without words not at all."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces of each row; an empty text has no pieces."""
    return encode_pieces(docs)


STAGES = [("quality rules", quality), ("near duplicates", dedup), ("secrets", secrets), ("mixing", mix), ("pieces", pieces)]

#: The draw of the mix and the cut into pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
