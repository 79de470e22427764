"""The corpus pipeline: quality classifier, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents, with whatever else the table has; the last returns the packed pieces.
Nulls, ties, empty and long texts and repeated rows are treated as the stages' operators say. An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, packing, quality
from tessera.llm.common import documents, save


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 6) doesn't reject. Null and empty texts score 0.5 and stay."""
    model = quality.fit(docs, documents(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (operator 7; five words, similarity 0.8), of the smallest doc_id in it. Rows
    are told apart by doc_id and text; those without words all stay."""
    return neardup.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources (operator 5) in training order: documents that it doesn't take go, and those that it takes
    twice stand there twice. Documents are taken whole."""
    return mixing.mix(docs, keep=docs.columns).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids (operator 2): a row for each piece and its place."""
    return packing.packed_rows(docs)


STAGES = [("quality classifier", classify), ("near duplicates", deduplicate), ("mix", mix), ("packing", pack)]
#: A learned classifier can't be put in SQL; tests hold every stage against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name.replace(" ", "_"))
    return docs
