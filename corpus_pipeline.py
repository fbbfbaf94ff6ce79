"""The corpus pipeline: each stage reads what its predecessor kept, as Parquet.

All stages take rows with nulls in any column, empty and very long texts, repeated rows, further columns of other names and an empty
table (which gives none); what each does with them is said below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import decontam, packing, quality, secrets, simhash
from sievelight.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go. Null texts are judged as empty ones, rows without a doc_id like any other; equal
    texts are judged alike; texts are read whole. Without labels of both sides every row stays."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (links of a Jaccard similarity of 0.8 at least, of different five-word shingles) stays:
    the one with the smallest doc_id. Null, empty and word-less texts are copies of each other; a text of fewer than five words is one
    shingle. Of rows with one doc_id one text stays; rows without a doc_id stay. Texts are read whole."""
    return simhash.one_of_each(docs, shingle=5, radius=60, lanes=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item (all words of a shorter one) go. Null and empty texts stay, also rows
    without a doc_id, which are judged by their text. Texts are searched whole."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), size=10)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind and n_chars is counted anew; no row goes, and null texts stay null. Texts are
    searched whole."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens. A null text is an empty one: its end id alone. Rows
    are packed as often as they come; a longer document is cut into pieces, none is dropped."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: No SQL: a trained classifier, fingerprints by XXH64 and a tokenizer are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
