"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns the packed
pieces. Stages are written to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, lines, packing, similar, toxicity
from ledgerloom.session import stored
from ledgerloom.sources.tables import table


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the chain rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 and more: later repeated runs of three lines, or of fewer with 50 words, go; documents stay."""
    return lines.dedupe_lines(docs, long=lines.LONG)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 and more: pairs that its fingerprints or MinHash keys link are checked on their five-word shingles;
    one document of each group stays whose shingles are alike by 0.8 or more."""
    return similar.drop_similar(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: what is left, as pieces with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", clean_toxicity),
    ("line_dedup", dedupe_lines),
    ("simhash_near_dedup", dedupe_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("best_fit_packing", pack_sequences),
]

# The first stage is a trained model, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
