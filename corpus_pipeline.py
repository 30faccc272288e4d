"""A training-data pipeline over ``documents``: classify, clean, deduplicate, mask, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultbench.llm import packing, pii, quality_cnn, quality_rules, simhash
from faultbench.llm.common import read_table, written
from faultbench.session import remove_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the byte-level network, fitted to the labels, scores 0.7 or more."""
    net = quality_cnn.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_cnn.accepted(docs, net, threshold=0.7)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules, without lines that are too frequent on their host.

    Lines of any length count; a group of what near_dedup takes for copies is one document of its host."""
    return quality_rules.cleaned(docs, quality_rules.LineLimits(near=4))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component."""
    return simhash.one_of_each(docs, shingle=4, max_distance=4, seed=42)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the texts replaced by its kind."""
    return pii.masked(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", clean_lines),
    ("simhash_near_dedup", near_dedup),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: Network, hash and vocabulary have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            remove_folder(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads its input at once and checkpoints what it needs
    remove_folder(spark, before)
    return packed
