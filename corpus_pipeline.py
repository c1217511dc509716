"""Corpus pipeline: quality rules, language ID, near-duplicates, benchmark passages, then SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it again as the next one's
``docs``. All but the last return the columns of ``documents``.

Defined cases: null and empty texts fail the quality rules; a document without a letter has no language and goes, and so does one of
which too few n-grams are known in any learned language (all with a letter stay if no row names its language); of a group of near-duplicates
the row with the smallest (id, row) stays; tables may be empty; an extra column passes through to the
last stage but one, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavesa.llm import decontaminate, langid, neardup, pieces, quality
from pavesa.llm.common import crc_mod, cut_lineage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy of the rule ledger keeps."""
    return quality.kept(docs, quality.STRICT)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language (``langid.accepted``), by a filter learned from the rows of ``docs`` that aren't held out."""
    return langid.with_language(docs, langid.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, pieces.model_path(), keep=["doc_id", "lang", "source"], verify=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: Learned languages and piece ids are beyond SQL; the tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
