"""A corpus pipeline: quality rules, near-dedup, secrets, source mixing, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and read again as the next stage's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import mixing, neardup, pieces, quality, secrets
from quadrille.llm.common import table, written
from quadrille.llm.registry import WEIGHTS, vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality.learn_rules(quality.labelled(docs, table(spark, sf_dir, "labels")))
    return quality.accepted(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, found by SimHash and then, for the rest, by prefixes."""
    return neardup.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redacted(docs, secrets.train(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as the sources' target weights ask, in a global random order."""
    return mixing.mixed(docs, WEIGHTS).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document."""
    found = pieces.encode(docs, pieces.Vocabulary.load(vocabulary_path("piece_bpe_32k.model")))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the learned rules, the fingerprints or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, in their order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
