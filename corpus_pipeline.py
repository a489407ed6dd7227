"""A corpus in, training sequences out: five stages, each one operator over all of its input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again before the next one.  All but the last return the columns of ``documents``.

Null texts count as empty and are scored like empty ones; rows without a doc_id stay where
the operators keep them; rows that are equal but for white space are one after the second
stage; other columns are carried along, whatever their names.  An empty table gives no
rows.  Texts may be of any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from barloom.llm.common import checkpoint_folder, delete_table, scratch, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the one with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the one with the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at each budget's end cut."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_to_weights),
    ("best-fit packing", pack_sequences),
]

#: The classifier, components and the packing have no SQL form; tests hold each stage
#: against a plain version on the stage's own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder.

    What a stage keeps there for itself, and its input, goes when its output is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete_table(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
