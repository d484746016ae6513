"""From raw documents to packed sequences: quality, lines, near duplicates, personal data, packing.

Each stage takes the documents that its predecessor kept and gives documents back; the last one
gives the pieces of the sequences. Between stages the documents are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise, table
from tidewatch.llm.line_dedup import drop_boilerplate
from tidewatch.llm.ngram_join import BROADCAST_IDS, near_duplicates
from tidewatch.llm.packing import pack
from tidewatch.llm.pii import redact
from tidewatch.llm.quality import keep_quality
from tidewatch.llm.tokens import public_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; documents stay, even if nothing is left of them."""
    return _documents(drop_boilerplate(docs.select(*COLUMNS)))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least doc_id stays.

    Documents without words have no near duplicates. Rows that share a doc_id stay or go together.
    """
    groups = near_duplicates(docs)
    dropped = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    dropped = materialise(dropped, "pipeline-dropped")
    few = dropped.count() <= BROADCAST_IDS
    return docs.select(*COLUMNS).join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _documents(redact(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, public_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicate_removal),
    ("pii", personal_data),
    ("packing", packing),
]

#: SQL cannot train a classifier or encode tokens; the operators are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
